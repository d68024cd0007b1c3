"""Scene, dialogue and result tables derived from the TPC-H-like ones, in Spark and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOMS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, room, label, centroid cx cy cz, box x0..z1."""
    e = lambda i: F.col("embedding")[i].cast("double")
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("object_id"), (F.col("vec_id") % ROOMS).alias("room"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"),
        *((e(i) * 4).alias(c) for i, c in enumerate(("cx", "cy", "cz"))), *((F.lit(0.05) + F.abs(e(i + 3))).alias(h) for i, h in enumerate(("hx", "hy", "hz"))),
    )
    low = [(F.col(f"c{a}") - F.col(f"h{a}")).alias(f"{a}0") for a in "xyz"]
    high = [(F.col(f"c{a}") + F.col(f"h{a}")).alias(f"{a}1") for a in "xyz"]
    return base.select("object_id", "room", "label", "cx", "cy", "cz", *low, *high)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, idx, x, y, z."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % ROOMS).alias("object_id"), F.col("vec_id").alias("idx"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, frame_id, position, micros."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sequence_id"), F.col("event_id").alias("frame_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("position"), micros.alias("micros"), "event_type", "value",
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, object_id, frame: one row per sighting."""
    f = frames(spark, sf_dir)
    room = F.col("sequence_id") % ROOMS
    return f.select(room.alias("room"), ((F.col("frame_id") % 25) * ROOMS + room).alias("object_id"), F.col("position").alias("frame"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, turn, role, text, room, frame."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), "turn", "role", "text", (F.col("conv_id") % ROOMS).alias("room"), (F.col("turn") * 30).alias("frame"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, slot, bucket, turn."""
    room = F.col("user_id") % ROOMS
    return table(spark, sf_dir, "events").select(((F.col("event_id") % 25) * ROOMS + room).alias("object_id"), F.col("event_type").alias("slot"), (F.floor("value") % 5).alias("bucket"), F.col("event_id").alias("turn"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, label, cents (a score in hundredths), seq (order of arrival)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object_id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("cents"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, family, session, and correctness in two runs: a, b (null where a run lacks the query)."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("query_id"), F.concat(F.lit("mc_query_"), F.lower(F.regexp_replace("o_orderpriority", r"[^A-Za-z]", ""))).alias("family"), F.month("o_orderdate").cast("long").alias("session"),
        F.when(key % 11 != 0, key % 7 < 4).alias("a"), F.when(key % 13 != 0, key % 7 < 5).alias("b"), F.col("o_orderstatus") != "P",
    ).toDF("query_id", "family", "session", "a", "b", "official")


def links(spark: SparkSession, sf_dir: str, gold: bool) -> DataFrame:
    """episode, turn, object_id, fact_bearing, source, phrase: gold links, or learned ones that differ from them."""
    t = turns(spark, sf_dir).where("role <> 'system'")
    k = F.col("episode") * 7 + F.col("turn") * 3
    picked = t.where((k % 4 != 0) if gold else (k % 5 != 0))
    pick = F.when((k % 6 == 0) & F.lit(not gold), (k + 1) % 25).otherwise(k % 25) * ROOMS + F.col("room")
    return picked.select("episode", "turn", pick.alias("object_id"), (k % 3 != 0).alias("fact_bearing"), F.element_at(F.array(F.lit("log"), F.lit("compiled"), F.lit("evidence")), (k % 3 + 1).cast("int")).alias("source"), F.split("text", " ")[0].alias("phrase"))


# The same tables in SQL.
_E = "CAST(embedding[{}] AS DOUBLE)"
SQL = {
    "b_objects": "SELECT vec_id AS object_id, vec_id % 20 AS room, 'class_' || CAST(label AS VARCHAR) AS label, " + ", ".join(f"{_E.format(i + 1)} * 4 AS c{a}" for i, a in enumerate("xyz")) + ", " + ", ".join(f"{_E.format(i + 1)} * 4 - (0.05::DOUBLE + abs({_E.format(i + 4)})) AS {a}0" for i, a in enumerate("xyz")) + ", " + ", ".join(f"{_E.format(i + 1)} * 4 + (0.05::DOUBLE + abs({_E.format(i + 4)})) AS {a}1" for i, a in enumerate("xyz")) + " FROM embeddings",
    "b_points": f"SELECT vec_id % 20 AS object_id, vec_id AS idx, {_E.format(1)} AS x, {_E.format(2)} AS y, {_E.format(3)} AS z FROM embeddings",
    "b_frames": "SELECT user_id AS sequence_id, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, epoch_us(ts) AS micros, event_type, value FROM events",
    "b_sightings": "SELECT sequence_id % 20 AS room, (frame_id % 25) * 20 + sequence_id % 20 AS object_id, position AS frame FROM b_frames",
    "b_turns": "SELECT conv_id AS episode, turn, role, text, conv_id % 20 AS room, turn * 30 AS frame FROM conversations",
    "b_facts": "SELECT (event_id % 25) * 20 + user_id % 20 AS object_id, event_type AS slot, CAST(floor(value) AS BIGINT) % 5 AS bucket, event_id AS turn FROM events",
    "b_votes": "SELECT l_partkey AS object_id, l_returnflag || l_linestatus AS label, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS cents, l_orderkey * 8 + l_linenumber AS seq FROM lineitem",
    "b_results": "SELECT o_orderkey AS query_id, 'mc_query_' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS family, CAST(month(o_orderdate) AS BIGINT) AS session, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 < 4 END AS a, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 7 < 5 END AS b, o_orderstatus <> 'P' AS official FROM orders",
}
for _name, _rest, _gold in (("b_gold", 4, "FALSE"), ("b_learned", 5, "TRUE")):
    SQL[_name] = f"SELECT episode, turn, (CASE WHEN k % 6 = 0 AND {_gold} THEN (k + 1) % 25 ELSE k % 25 END) * 20 + room AS object_id, k % 3 <> 0 AS fact_bearing, ['log', 'compiled', 'evidence'][k % 3 + 1] AS source, split_part(text, ' ', 1) AS phrase FROM (SELECT *, episode * 7 + turn * 3 AS k FROM b_turns WHERE role <> 'system') WHERE k % {_rest} <> 0"
_NEEDS = {"b_sightings": ["b_frames"], "b_gold": ["b_turns"], "b_learned": ["b_turns"]}


def with_bridges(query: str) -> str:
    """The query with the bridge tables that it names as common table expressions."""
    used: list[str] = []
    for name in SQL:
        if name in query:
            used += [*(n for n in _NEEDS.get(name, []) if n not in used), *([name] if name not in used else [])]
    if not used:
        return query
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in dict.fromkeys(used))
    body = query.strip()
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
