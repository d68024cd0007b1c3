"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, stored, whole_text

#: A line on so many distinct sites is boilerplate.
LEAST_SITES = 8
#: Estimates within this factor of LEAST_SITES, either way, are replaced by exact counts.
NEAR = 2.0
#: Log2 of a sketch's registers.
SKETCH_LOG2 = 10


def line_key(line: Column) -> Column:
    """16 bytes that stand for a line; lines are compared trimmed, blank ones have no key."""
    trimmed = F.trim(line)
    return F.when(trimmed != "", F.unhex(F.md5(trimmed.cast("binary"))))


def boilerplate_lines(docs: DataFrame, least_sites: int = LEAST_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """key, sites, n: the lines on at least `least_sites` distinct sites, and the rows that hold them.

    Sketches of the sites of each line merge by aggregation, on the map side first. Lines whose estimate is near
    the threshold are counted exactly: their (line, site) pairs are made distinct before they are counted, so a
    line's sites, not its rows, meet in one task.
    """
    text = whole_text(text_col)
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("line")).select("site", line_key(F.col("line")).alias("key")).where("key is not null and site is not null")
    spread = stored(lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2))).alias("sites"), F.count("*").alias("n")).where(F.col("sites") >= least_sites / NEAR))
    near = spread.where(F.col("sites") < least_sites * NEAR).select("key")
    pairs = lines.join(near, "key", "left_semi").groupBy("key", "site").agg(F.count("*").alias("n"))
    exact = pairs.groupBy("key").agg(F.count("*").alias("sites"), F.sum("n").alias("n"))
    return spread.where(F.col("sites") >= least_sites * NEAR).unionByName(exact).where(F.col("sites") >= least_sites)


def clean_lines(docs: DataFrame, least_sites: int = LEAST_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, text (without boilerplate lines).

    A line is what line feeds separate, compared without the spaces around it; blank lines are never removed. It
    is boilerplate on at least `least_sites` distinct values of the site column; rows without a site count as
    no site, but are cleaned too. What remains is joined by line feeds, as it was.

    Lines that go are gathered by document, which a document's own lines bound, and taken out of the text in one
    pass; a very common line's rows are dealt in parts. A document without a text has one blank line. Documents are
    told apart by a hash of the id, or of the text where there is no id: rows that share one share the boilerplate lines
    of any of them, which each of them would lose alone. Other columns are not read. An empty table gives an empty
    result.
    """
    found = stored(boilerplate_lines(docs, least_sites, text_col, site_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"))
    rows = rows.withColumn("who", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("body")))
    own = rows.select("who", F.explode(F.array_distinct(F.split("body", "\n", -1))).alias("line")).select("who", line_key(F.col("line")).alias("key")).where("key is not null")
    gone = spread_join(own, found.select("key"), ["key"], hot_keys(found, ["key"], "n"), F.col("who"))
    drops = gone.groupBy("who").agg(F.collect_set("key").alias("drop"))
    joined = rows.join(drops, "who", "left").withColumn("lines", F.split("body", "\n", -1))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("drop"), line_key(x)), F.lit(False))))
    return joined.withColumn("kept", kept).select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
