"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, one_row_each, spread_join, stored, whole_text

#: Ways a group of copies is spread before its winners meet.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Three combines, each grouping by digest and full content, so that texts which merely share a digest stay
    apart: the map side of the first deduplicates each partition, its reduce side merges salted digest groups,
    and the last combines the salts' winners. A group of copies sends at most `salts` rows from each map task,
    and at most `salts` of its rows meet in the end. Documents then find their group by the digest, which is
    exact as the groups of a digest with several texts are kept apart and found by digest and text; the rows of a
    large group are dealt in parts for that too.

    Null text counts as empty, and empty texts are copies of each other. The largest id of a group stays; a null
    id is never the largest unless all are null. Rows that repeat an id and its text are one document and share
    its fate. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")).select("doc_id", "body", digest(F.col("body")).alias("digest"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Dealt by the digest alone, so that counting a digest's texts needs no further exchange.
    winners = salted.repartition("digest").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = stored(winners.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))

    keys = rows.select("doc_id", "digest", sha256(F.col("body")).alias("sha"))
    found = spread_join(keys, groups.where("texts = 1").drop("texts"), ["digest"], hot_keys(groups, ["digest"], "group_size"), F.col("doc_id"))
    crowded = groups.where("texts > 1").select("digest")
    if not crowded.isEmpty():
        apart = winners.join(crowded, "digest", "left_semi")
        found = found.unionByName(rows.withColumn("sha", sha256(F.col("body"))).join(apart, ["digest", "body"]).drop("body"))
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each text, with all its columns: that of the largest id. Of rows that repeat that id too, the least by a hash of all columns stays."""
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_sha256").distinct()
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256) == gone["text_sha256"])
    return one_row_each(docs.join(gone, same, "left_anti"), docs, id_col, text_col)
