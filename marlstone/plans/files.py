"""Readers and writers as queries: the driver's tables, written as the source files they stand for, and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import objects, scoring
from ..sources import bridge, readers, segmentation
from ..sources.shared import new_place, written
from .catalog import query

#: Bytes of JSON in a file that holds a list of rows, but for a longer row.
LIST_BYTES = 4 << 20


def as_files(df: DataFrame, under: str = "") -> str:
    """One JSON file for each row, in a new folder of the shared place."""
    path = f"{new_place(df.sparkSession)}{under}"
    df.write.option("maxRecordsPerFile", 1).json(path)
    return path


def as_lists(df: DataFrame) -> str:
    """JSON files, each a list of rows of about LIST_BYTES, in a new folder of the shared place: so that files don't grow in number with small rows."""
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch["value"].to_pylist():
                if held and size + len(row) > LIST_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held)}]"]})
                    held, size = [], 0
                held.append(row)
                size += len(row)
        if held:
            yield pa.RecordBatch.from_pydict({"value": [f"[{','.join(held)}]"]})

    path = new_place(df.sparkSession)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lists, "value string").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT 'mcep_1' AS episode, episode || ':' || turn AS global_turn_id, turn AS global_turn_index, frame AS local_frame, role AS speaker, md5(text) AS text_md5 FROM b_turns")
def transcript_turns(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    turn = F.struct(F.concat_ws(":", "episode", "turn").alias("global_turn_id"), F.col("turn").alias("global_turn_index"), F.lit(0).alias("session_index"), F.col("frame").alias("local_frame"), F.lit(1).alias("day"), F.col("role").alias("speaker"), "text")
    path = as_files(t.groupBy("room").agg(F.collect_list(turn).alias("turns")).select("turns"), "/shard_0/task/mcep_1")
    return readers.read_transcripts(spark, path).select("episode", "global_turn_id", "global_turn_index", "local_frame", "speaker", F.md5("text").alias("text_md5"))


def scenes(spark, sf_dir) -> DataFrame:
    """Scene records of the rooms, written and read."""
    o, s = bridge.objects(spark, sf_dir), bridge.sightings(spark, sf_dir)
    entry = F.struct("label", F.array(*(F.col(f"c{a}") for a in "xyz")).alias("centroid"), F.array(*(F.col(f"{a}0") for a in "xyz")).alias("aabb_min"), F.array(*(F.col(f"{a}1") for a in "xyz")).alias("aabb_max"))
    key = F.col("object_id").cast("string")
    boxes = o.groupBy("room").agg(F.map_from_entries(F.collect_list(F.struct(key, entry))).alias("objects"))
    seen = s.groupBy("room", "object_id").agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    maps = seen.groupBy("room").agg(F.map_from_entries(F.collect_list(F.struct(key, "frames"))).alias("sightings"))
    return readers.read_scenes(spark, as_files(boxes.join(maps, "room", "left").withColumnRenamed("room", "scene_id")))


_MILLI = "CAST(floor(({}) * 1000 + 0.5) AS BIGINT)"


@query("SELECT CAST(room AS VARCHAR) AS room, object_id, label, " + ", ".join(f"{_MILLI.format(c)} AS {c}" for c in ("cx", "cy", "cz", "x0", "z1")) + " FROM b_objects")
def scene_record_objects(spark, sf_dir):
    rows = readers.scene_objects(scenes(spark, sf_dir))
    return rows.select("room", "object_id", "label", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("cx", "cy", "cz", "x0", "z1")))


@query("SELECT DISTINCT CAST(s.room AS VARCHAR) AS room, s.object_id, s.frame FROM b_sightings s WHERE EXISTS (SELECT 1 FROM b_objects o WHERE o.room = s.room AND o.object_id = s.object_id)")
def scene_record_sightings(spark, sf_dir):
    return readers.scene_sightings(scenes(spark, sf_dir))


@query("SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, CAST(position AS BIGINT) AS position, CAST(frame_id AS VARCHAR) AS frame_id, CAST(position * 6 AS BIGINT) AS source_frame_index FROM b_frames")
def manifest_frames(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    frame = F.struct("position", F.struct(F.col("frame_id").cast("string").alias("frame_id"), (F.col("position") * 6).cast("long").alias("source_frame_index"), (F.col("position") / 5).alias("timestamp_seconds")).alias("f"))
    whole = f.groupBy(F.col("sequence_id").cast("string").alias("sequence_id")).agg(F.transform(F.sort_array(F.collect_list(frame)), lambda x: x["f"]).alias("frames")).withColumn("schema_version", F.lit(1))
    return readers.read_manifest(spark, as_lists(whole)).select("sequence_id", F.col("position").cast("long").alias("position"), "frame_id", "source_frame_index")


@query("SELECT object_id, CASE WHEN label IN ('class_0', 'class_1') THEN 'furniture' ELSE label END AS label, label IN ('class_0', 'class_1') AS mapped FROM b_objects")
def label_mapping_file(spark, sf_dir):
    path = new_place(spark)
    spark.createDataFrame([('{"class_0": "furniture", "class_1": "furniture"}',)], "value string").write.text(path)
    return readers.mapped_labels(bridge.objects(spark, sf_dir).select("object_id", "label"), readers.read_label_mapping(spark, path))


@query("SELECT object_id, idx FROM b_points WHERE idx % 20 IN (object_id % 20, (object_id + 1) % 20)")
def annotated_vertices(spark, sf_dir):
    """Each object is a scene whose vertices lie in 20 segments, two of which make the annotated object."""
    p = bridge.points(spark, sf_dir)
    names = p.select("object_id").distinct()
    ranked = p.select(F.col("object_id").cast("string").alias("room"), "idx", (F.col("idx") % 20).alias("segment"))
    k = F.col("object_id")
    group = F.struct(k.alias("objectId"), F.lit("thing").alias("label"), F.array(k % 20, (k + 1) % 20).alias("segments"))
    path = as_files(names.select(k.cast("string").alias("sceneId"), F.array(group).alias("segGroups")))
    groups = readers.read_groups(spark, path, "*.json")
    return readers.grouped_vertices(ranked, groups).select("object_id", "idx")


@query("SELECT turn, object_id, slot, min(v) AS value FROM (SELECT turn, object_id, slot, CAST(bucket AS VARCHAR) AS v FROM b_facts) GROUP BY turn, object_id, slot, v")
def evidence_facts(spark, sf_dir):
    f = bridge.facts(spark, sf_dir)
    fact = F.struct(F.concat(F.lit("t"), "object_id").alias("track_id"), F.lit("c").alias("clip_id"), F.col("object_id").cast("string").alias("object_id"), F.col("turn").cast("string").alias("established_global_turn_id"), "slot", F.col("bucket").cast("string").alias("value"))
    twice = f.unionByName(f)  # facts that repeat are one
    rows = twice.groupBy((F.col("turn") % 50).alias("g")).agg(F.collect_list(fact).alias("facts")).select(F.col("g").cast("string").alias("query_id"), F.struct("facts").alias("memory_snapshot"))
    path = f"{new_place(spark)}/shard_0/task/mcep_1"
    rows.write.json(path)
    read = readers.read_facts(spark, path)
    return read.select(F.col("established_global_turn_id").cast("long").alias("turn"), F.col("object_id").cast("long").alias("object_id"), "slot", "value")


@query("SELECT 'shard_' || episode % 3 AS shard, 'mcep_' || episode AS episode, CAST(turn AS VARCHAR) AS turn, object_id AS object, fact_bearing, source FROM b_gold")
def link_files(spark, sf_dir):
    rows = bridge.links(spark, sf_dir, gold=True).select(F.concat(F.lit("shard_"), F.col("episode") % 3).alias("shard"), F.lit("task").alias("task"), F.concat(F.lit("mcep_"), "episode").alias("episode"), F.col("turn").cast("string").alias("turn"), F.lit("s").alias("scene"), F.col("object_id").alias("object"), "phrase", "fact_bearing", "source")
    path = new_place(spark)
    readers.write_links(rows, path)
    return readers.read_links(spark, path).select("shard", "episode", "turn", "object", "fact_bearing", "source")


@query("SELECT query_id FROM b_results WHERE query_id % 3 <> 0 OR query_id % 17 = 0")
def resumed_run(spark, sf_dir):
    """Results of a third of the queries are appended in two parts, some of them errors; the rest is to do."""
    r = bridge.results(spark, sf_dir).select("query_id")
    done = r.where("query_id % 3 = 0").withColumn("raw", F.when(F.col("query_id") % 17 == 0, "ERROR 429").otherwise("{}"))
    path = new_place(spark)
    for half in (0, 1):
        readers.append_results(done.where(F.col("query_id") % 2 == half), path)
    return scoring.to_do(r, spark.read.schema(done.schema).json(path))


@query("SELECT query_id FROM b_results WHERE official")
def official_queries(spark, sf_dir):
    r = bridge.results(spark, sf_dir)
    return readers.official_view(r.select("query_id"), r.where("official").select("query_id"))


@query("SELECT CAST(0 AS BIGINT) AS differing FROM (SELECT 1)")
def store_fingerprints(spark, sf_dir):
    """A store's fingerprint is the same in any order of its files, and another when a size changes."""
    files = bridge.objects(spark, sf_dir).select(F.concat(F.lit("scene_"), "object_id").alias("path"), F.col("object_id").alias("length"))
    one, other = (readers.store_fingerprint(x).first().fingerprint for x in (files, files.repartition(3, "length")))
    changed = readers.store_fingerprint(files.withColumn("length", F.when(F.col("length") == 1, 0).otherwise(F.col("length")))).first().fingerprint
    return spark.createDataFrame([(int(one != other) + int(one == changed),)], "differing long")


@query("SELECT l_suppkey AS frame, l_suppkey || ':' || (l_partkey % 50 - 1) AS observation_id, 'class_' || (l_partkey % 50 - 1) % 7 AS label, count(*) AS n FROM lineitem WHERE l_partkey % 50 <> 0 GROUP BY ALL")
def mask_observations(spark, sf_dir):
    """Each line is a pixel of its supplier's frame."""
    pixels = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 50).alias("value"))
    things = spark.range(49).select(F.col("id").alias("object_id"), F.concat(F.lit("class_"), F.col("id") % 7).alias("label"))
    return segmentation.mask_observations(pixels, things).select("frame", "observation_id", "label", "n")


@query("""WITH s AS (SELECT l_partkey AS query, sum(CASE WHEN l_quantity > 25 THEN 1 / (1 + exp(-(l_quantity - 25.0) / 8)) ELSE 0.0 END) / (count(*) FILTER (WHERE l_quantity > 25) + 1e-6) AS m, count(*) FILTER (WHERE l_quantity > 25) AS covered FROM lineitem GROUP BY l_partkey)
SELECT query, covered, CAST(floor(1e6 * greatest(p_size, 50 - p_size) / 100.0 * m + 0.5) AS BIGINT) AS score_ppm FROM s JOIN part ON p_partkey = query WHERE covered > 12 AND p_size <> 50""")
def query_scores(spark, sf_dir):
    """A part is a query, and its lines are its pixels; parts of one size are surely no object."""
    size = F.when(F.col("p_size") == 50, 0.0).otherwise(1.0)
    p = bridge.table(spark, sf_dir, "part").select(F.lit(0).alias("chunk"), F.col("p_partkey").alias("query"), F.array(size * F.col("p_size") / 100.0, size * (50 - F.col("p_size")) / 100.0, F.lit(1.0)).alias("probabilities"))
    pixels = bridge.table(spark, sf_dir, "lineitem").select(F.lit(0).alias("chunk"), F.col("l_partkey").alias("query"), ((F.col("l_quantity").cast("double") - 25.0) / 8).alias("logit"))
    return segmentation.query_scores(p, pixels, least_pixels=12).select("query", "covered", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_ppm"))


@query("""WITH p AS (SELECT vec_id AS query, i - 1 AS i, abs(CAST(embedding[i] AS DOUBLE)) AS p FROM embeddings, range(1, 64) r(i)), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p DESC, i) AS n, max(p) OVER (PARTITION BY query) AS top FROM p)
SELECT query, max(CASE WHEN n = 1 THEN 'c' || i END) AS label, string_agg('c' || i || '=' || CAST(floor(1e6 * p / top + 0.5) AS BIGINT), ',' ORDER BY n) FILTER (WHERE n > 1) AS others FROM k WHERE n <= 5 AND query % 5 <> 0 GROUP BY query""")
def decoded_queries(spark, sf_dir):
    """Embeddings as probabilities of 63 classes; each fifth has too low a score."""
    k = F.col("vec_id")
    rows = bridge.table(spark, sf_dir, "embeddings").select(F.lit(0).alias("chunk"), k.alias("query"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("probabilities"), F.when(k % 5 == 0, 0.049).otherwise(0.05).alias("score"))
    out = segmentation.decoded_queries(rows, [f"c{i}" for i in range(63)])
    other = F.transform("label_candidates", lambda x: F.concat(x["label"], F.lit("="), F.floor(x["score"] * 1e6 + 0.5).cast("long")))
    return out.select("query", "label", F.array_join(other, ",").alias("others"))


@query("SELECT frame_id, frame_id || ':' || event_type AS observation_id, event_type AS label, value AS confidence FROM b_frames")
def stored_observations(spark, sf_dir):
    """An observation in each frame, stored and read for the same frames."""
    f = bridge.frames(spark, sf_dir)
    listed = f.select(F.struct("sequence_id", "position").alias("position"), "frame_id", F.lit(3).alias("h"), F.lit(5).alias("w"))
    rows = f.select(F.concat_ws(":", "frame_id", "event_type").alias("observation_id"), "frame_id", F.col("event_type").alias("label"), F.col("value").alias("confidence"), F.lit(None).cast("string").alias("track_hint"), F.array(F.struct(F.lit("other").alias("label"), F.lit(0.5).alias("score"))).alias("label_candidates"), F.unhex(F.lit("ffff")).alias("bits"))
    path = new_place(spark)
    segmentation.write_observations(listed, rows, path)
    return segmentation.read_observations(listed, path).select("frame_id", "observation_id", "label", "confidence")


@query("SELECT object_id, label, n FROM (SELECT object_id, any_value(label) AS label FROM b_objects GROUP BY object_id) JOIN (SELECT object_id, count(*) AS n FROM b_sightings GROUP BY object_id) USING (object_id)")
def stored_objects(spark, sf_dir):
    """Objects and their sightings as observations, stored and read; unseen objects are none."""
    s = bridge.sightings(spark, sf_dir).select("object_id", F.monotonically_increasing_id().alias("observation_id"))
    s = written(s)
    things = bridge.objects(spark, sf_dir).join(s.select("object_id").distinct(), "object_id", "left_semi")
    members = s.join(things.select("object_id"), "object_id", "left_semi")
    path = new_place(spark)
    objects.write_objects(things, s.select("observation_id"), members, s.where("false").select("observation_id", F.lit("no points").alias("reason")), path)
    saved = objects.read_objects(spark, path)
    return saved["objects"].join(saved["members"], "object_id").groupBy("object_id", "label").agg(F.count("*").alias("n"))
