"""Readers and writers of episodes, scenes, geometry and results.

Files are opened by Spark's readers, so any store it reaches will do; only recorded streams, which outgrow one value,
are read in place by Arrow. Written tables refuse to overwrite and
end with a _SUCCESS marker.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import scene_of

TURNS = "array<struct<global_turn_id string, global_turn_index long, session_index long, local_frame long, day long, speaker string, text string>>"
SESSIONS = "session_index long, clip_id string, day long, room_gloss string"
QUERIES = "query_id string, global_turn_id string, turn long, session_index long"
ANSWERS = "query_id string, answer_interface struct<scoreability: struct<answer_type: string, officially_scoreable: boolean>, canonical_answer: string, accepted_answers: array<long>>"
EVIDENCE = "query_id string, program struct<program_id: string>, memory_snapshot struct<facts: array<struct<track_id: string, clip_id: string, object_id: string, established_global_turn_id: string, slot: string, value: string>>>"
LINKS = "turn string, scene string, object long, phrase string, fact_bearing boolean, source string"
RESULTS = "episode string, query_id string, turn string, session long, family string, answer_type string, officially_scoreable boolean, key string, accepted array<long>, key_object string, pred string, correct boolean, work_true long, correct_from_work boolean, prompt_tokens long, completion_tokens long, reasoning_tokens long, seconds double, context_chars long, cached boolean, raw string"
EPISODE = r"(shard_[^/]+)/([^/]+)/(mcep_[^/]+)"


def with_episode(df: DataFrame) -> DataFrame:
    """With shard, task and episode from the file's path."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(path, EPISODE, i + 1).alias(n) for i, n in enumerate(("shard", "task", "episode"))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return with_episode(spark.read.schema(schema).json(path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per turn of every transcript file."""
    whole = with_episode(spark.read.option("multiLine", True).schema(f"turns {TURNS}").json(path))
    return whole.select("shard", "task", "episode", F.inline("turns"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Distinct facts of the evidence files: episode, track_id, clip_id, object_id, turn, slot, value."""
    rows = read_jsonl(spark, path, EVIDENCE).select("shard", "task", "episode", F.explode("memory_snapshot.facts").alias("f")).select("shard", "task", "episode", "f.*")
    return rows.dropDuplicates(["shard", "task", "episode", "track_id", "established_global_turn_id", "slot", "value"])


def read_label_mapping(spark: SparkSession, path: str) -> DataFrame:
    """raw_label, canonical_label from a JSON object of names."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("raw_label", "canonical_label")).distinct()


def mapped_labels(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """With label by the mapping; a label that is not in it stays, and `mapped` says so."""
    rows = objects.join(mapping, objects["label"] == mapping["raw_label"], "left")
    return rows.select(*(objects[c] for c in objects.columns if c != "label"), F.coalesce("canonical_label", objects["label"]).alias("label"), F.col("canonical_label").isNotNull().alias("mapped"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene records: scene_id, objects (map), sightings (map), camera (map), frame_rate."""
    point = "array<double>"
    schema = f"scene_id string, frame_rate double, frame_step long, objects map<string, struct<label: string, label_alternatives: array<string>, raw_label: string, centroid: {point}, aabb_min: {point}, aabb_max: {point}, vertex_count: long>>, sightings map<string, array<long>>, camera map<string, {point}>"
    return spark.read.option("multiLine", True).schema(schema).json(path)


def scene_objects(scenes: DataFrame) -> DataFrame:
    rows = scenes.select("scene_id", F.explode("objects").alias("id", "o"))
    cols = [F.col(f"o.{f}")[i].alias(n.format(a)) for f, n in (("centroid", "c{}"), ("aabb_min", "{}0"), ("aabb_max", "{}1")) for i, a in enumerate("xyz")]
    return rows.select(F.col("scene_id").alias("room"), F.col("id").cast("long").alias("object_id"), "o.label", F.coalesce("o.label_alternatives", F.array().cast("array<string>")).alias("alternatives"), *cols)


def scene_sightings(scenes: DataFrame) -> DataFrame:
    """room, object_id, frame; sightings of unknown objects are dropped."""
    rows = scenes.select(F.col("scene_id").alias("room"), "objects", F.explode("sightings").alias("id", "frames")).where(F.map_contains_key("objects", F.col("id")))
    return rows.select("room", F.col("id").cast("long").alias("object_id"), F.explode("frames").alias("frame"))


def scene_cameras(scenes: DataFrame) -> DataFrame:
    rows = scenes.select(F.col("scene_id").alias("room"), F.explode("camera").alias("frame", "p"))
    return rows.select("room", F.col("frame").cast("long").alias("frame"), *(F.col("p")[i].alias(c) for i, c in enumerate("xyz")))


def read_frame_folder(spark: SparkSession, path: str, sequence_id: str, fps: float = 30.0) -> DataFrame:
    """frame_id, position, timestamp_seconds, rgb_path of images named 000000.jpg and on; a gap is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path")
    at = F.regexp_extract("path", r"(\d{6})\.jpg$", 1).cast("long")
    rows = files.select(F.lit(sequence_id).alias("sequence_id"), at.alias("position"), F.col("path").alias("rgb_path"))
    whole = F.count("*").over(W.partitionBy("sequence_id"))
    last = F.max("position").over(W.partitionBy("sequence_id"))
    checked = F.when((whole == last + 1) & F.col("position").isNotNull(), F.col("position")).otherwise(F.raise_error(F.lit("frame names are not contiguous")).cast("long"))
    return rows.withColumn("position", checked).select("sequence_id", F.concat_ws(":", "sequence_id", F.col("position").cast("string")).alias("frame_id"), "position", (F.col("position") / fps).alias("timestamp_seconds"), "rgb_path")


def parsed_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], pd.DataFrame], schema: str, glob: str = "*") -> DataFrame:
    """Rows that a function makes of each file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield parse(name, bytes(data))

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, schema)


# Fixed values of recorded streams: the version, and the code of JPEG colour.
SENS_VERSION, SENS_JPEG = 4, 2
SENS_BATCH = 16

PLY_TYPES = {"float": "f4", "float32": "f4", "double": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "short": "i2", "ushort": "u2"}


def parse_ply(path: str, data: bytes) -> pd.DataFrame:
    """idx, x, y, z of a little-endian binary PLY's vertices."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode("ascii").splitlines()
    if "format binary_little_endian 1.0" not in lines:
        raise ValueError(f"{path} is not a little-endian binary PLY")
    at = next(i for i, x in enumerate(lines) if x.startswith("element vertex"))
    fields = []
    for line in lines[at + 1 :]:
        if not line.startswith("property"):
            break
        _, kind, name = line.split()
        fields.append((name, "<" + PLY_TYPES[kind]))
    rows = np.frombuffer(data, np.dtype(fields), int(lines[at].split()[-1]), end)
    return pd.DataFrame({"path": path, "idx": np.arange(len(rows)), **{c: rows[c].astype(float) for c in "xyz"}})


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return parsed_files(spark, path, parse_ply, "path string, idx long, x double, y double, z double", "*.ply")


def opened(path: str):
    """A stream of one file, read in place, in any store that Arrow opens."""
    store, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(place)


def recorded(path: str, images: bool) -> Iterator[tuple[str, int, list[float] | None, bytes | None]]:
    """path, position, camera_to_world (16; null if it is not finite) and, if asked, the JPEG of each frame of a recorded stream.

    One frame is held at a time. Streams of another version than 4, images that are no whole JPEG, and streams that end
    before their last frame are errors.
    """
    with opened(path) as stream:
        def fields(layout: str) -> tuple:
            data = stream.read(struct.calcsize(layout))
            if len(data) < struct.calcsize(layout):
                raise ValueError(f"{path} ends early")
            return struct.unpack(layout, data)

        version, name = fields("<IQ")
        if version != SENS_VERSION:
            raise ValueError(f"{path} has version {version}")
        stream.seek(name + 4 * 64, 1)
        kind = fields("<2I4If")[0]
        if images and kind != SENS_JPEG:
            raise ValueError(f"{path} has colour of kind {kind}, not JPEG")
        for i in range(fields("<Q")[0]):
            *pose, _, _, colour, depth = fields("<16f4Q")
            image = None
            if images:
                image = stream.read(colour)
                if not (image.startswith(b"\xff\xd8") and image.endswith(b"\xff\xd9")):
                    raise ValueError(f"{path}: frame {i} is not a whole JPEG")
            end = stream.tell() + depth + (0 if images else colour)
            if end > stream.size():
                raise ValueError(f"{path} ends early")
            stream.seek(end)
            yield path, i, pose if np.isfinite(pose).all() else None, image


def read_sens(spark: SparkSession, path: str, images: bool) -> DataFrame:
    """path, position, camera_to_world, image: the frames of recorded streams, a stream at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                rows = recorded(name, images)
                while some := list(islice(rows, SENS_BATCH)):
                    yield pd.DataFrame(some, columns=["path", "position", "camera_to_world", "image"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sens").load(path).select("path")
    return files.mapInPandas(run, "path string, position long, camera_to_world array<double>, image binary")


def read_sens_poses(spark: SparkSession, path: str) -> DataFrame:
    return read_sens(spark, path, False).drop("image")


def read_sens_images(spark: SparkSession, path: str) -> DataFrame:
    """path, position, name (`000000.jpg`, from 0 on), image: the colour frames byte for byte as they were recorded."""
    return read_sens(spark, path, True).select("path", "position", F.format_string("%06d.jpg", "position").alias("name"), "image")


def parse_depth(path: str, data: bytes) -> pd.DataFrame:
    """position, row, col, depth, confidence of one frame's archive of arrays `depth` and `conf`."""
    arrays = np.load(io.BytesIO(data))
    depth, conf = arrays["depth"], arrays["conf"]
    if depth.shape != conf.shape or depth.ndim != 2:
        raise ValueError(f"{path}: depth and confidence differ in shape")
    row, col = np.indices(depth.shape)
    at = int(re.search(r"(\d+)\.npz$", path)[1])
    return pd.DataFrame({"position": at, "row": row.ravel(), "col": col.ravel(), "depth": depth.ravel().astype(float), "confidence": conf.ravel().astype(float)})


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    return parsed_files(spark, path, parse_depth, "position long, row long, col long, depth double, confidence double", "*.npz")


def read_pose_text(spark: SparkSession, path: str) -> DataFrame:
    """position, camera_to_world (16): one pose a line, in order within each file."""

    def parse(name: str, data: bytes) -> pd.DataFrame:
        rows = [[float(v) for v in x.split()] for x in data.decode().splitlines() if x.strip()]
        if any(len(r) != 16 for r in rows):
            raise ValueError(f"{name}: a pose has 16 numbers")
        return pd.DataFrame({"path": name, "position": range(len(rows)), "camera_to_world": rows})

    return parsed_files(spark, path, parse, "path string, position long, camera_to_world array<double>", "*.txt")


def parse_segments(path: str, data: bytes) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "idx": range(len(s := json.loads(data)["segIndices"])), "segment": s})


def read_segments(spark: SparkSession, path: str, glob: str = "*segs.json") -> DataFrame:
    """path, idx, segment: the segment of each vertex."""
    return parsed_files(spark, path, parse_segments, "path string, idx long, segment long", glob)


def grouped_vertices(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """room, object_id, label, idx: the vertices of each annotated object; a segment may be in several. segments: room, idx, segment."""
    return groups.join(segments, ["room", "segment"]).select("room", "object_id", "label", "idx")


def read_axis_alignment(spark: SparkSession, path: str) -> DataFrame:
    """path, alignment (16 numbers): the `axisAlignment = ...` line of scene text files; the identity where there is none."""
    number = F.regexp_extract("value", r"(?m)^\s*axisAlignment\s*=\s*(.*)$", 1)
    parsed = F.transform(F.filter(F.split(F.trim(number), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    identity = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    checked = F.when(F.size(parsed) == 0, identity).when(F.size(parsed) == 16, parsed).otherwise(F.raise_error(F.lit("an alignment has 16 numbers")).cast("array<double>"))
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), checked.alias("alignment"))


def read_groups(spark: SparkSession, path: str, glob: str = "*aggregation.json") -> DataFrame:
    """object_id, label, segment: the segments of each annotated object."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", glob).schema("sceneId string, segGroups array<struct<objectId long, label string, segments array<long>>>").json(path)
    return rows.select("sceneId", F.explode("segGroups").alias("g")).select(F.col("sceneId").alias("room"), F.col("g.objectId").alias("object_id"), "g.label", F.explode("g.segments").alias("segment"))


def parse_masks(path: str, data: bytes) -> pd.DataFrame:
    """frame, object_id, pixels of every instance PNG in an archive; a pixel is the object's id plus 1. Needs Pillow."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("reading PNG masks needs Pillow") from e
    rows = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in archive.namelist():
            if m := re.search(r"(\d+)\.png$", name):
                values, counts = np.unique(np.array(Image.open(archive.open(name))), return_counts=True)
                rows += [(int(m[1]), int(v) - 1, int(n)) for v, n in zip(values, counts) if v]
    return pd.DataFrame(rows, columns=["frame", "object_id", "pixels"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id, position, frame_id, source_frame_index, timestamp_seconds of version 1 manifests; a file has one, or a list of them."""
    schema = "schema_version long, sequence_id string, frames array<struct<frame_id string, source_frame_index long, timestamp_seconds double>>"
    whole = spark.read.option("multiLine", True).schema(schema).json(path)
    version = F.when(F.col("schema_version") == 1, F.col("sequence_id")).otherwise(F.raise_error(F.lit("unknown manifest version")))
    return whole.select(version.alias("sequence_id"), F.posexplode("frames").alias("position", "f")).select("sequence_id", "position", "f.*")


def manifest_differences(manifest: DataFrame, frames: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows in which a manifest and a sequence differ, by position."""
    m, f = manifest.alias("m"), frames.alias("f")
    both = m.join(f, ["sequence_id", "position"], "full")
    same = (F.col("m.frame_id") == F.col("f.frame_id")) & (F.col("m.source_frame_index") == F.col("f.source_frame_index")) & (F.abs(F.col("m.timestamp_seconds") - F.col("f.timestamp_seconds")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False))).select("sequence_id", "position", F.col("m.frame_id").alias("manifest_frame"), F.col("f.frame_id").alias("sequence_frame"))


def packed_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask.ravel()).tobytes()


def read_mask_cells(masks: DataFrame) -> DataFrame:
    """observation_id, frame_id, row, col of the set cells of packed masks (observation_id, frame_id, h, w, bits)."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                on = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.h * r.w).reshape(r.h, r.w)
                row, col = np.nonzero(on)
                yield pd.DataFrame({"observation_id": r.observation_id, "frame_id": r.frame_id, "row": row, "col": col})

    return masks.mapInPandas(cells, "observation_id string, frame_id string, row long, col long")


def cache_faults(observations: DataFrame) -> DataFrame:
    """fault, key: what breaks a segmentation cache's rules; an empty table is a sound cache."""
    ids = observations.groupBy("observation_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("observation id is repeated").alias("fault"), F.col("observation_id").alias("key"))
    hints = observations.where("track_hint is not null").groupBy("frame_id", "track_hint").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("hint is repeated in a frame").alias("fault"), F.col("frame_id").alias("key"))
    labels = observations.where("coalesce(label, '') = ''").select(F.lit("label is empty").alias("fault"), F.col("observation_id").alias("key"))
    own = observations.where(F.exists("label_candidates", lambda c: c["label"] == F.col("label"))).select(F.lit("a candidate repeats the label").alias("fault"), F.col("observation_id").alias("key"))
    return ids.unionByName(hints).unionByName(labels).unionByName(own)


def write_once(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path, partitionBy=list(partition_by) or None)


def write_links(links: DataFrame, path: str) -> None:
    """One JSON line a link (LINKS, episode), in folders shard and task, an episode's in one file; read_links reads them back.

    Episodes are no folders: their number would be that of the files.
    """
    links.repartition("shard", "task", "episode").sortWithinPartitions("shard", "task", "episode", "turn", "object").write.mode("errorifexists").partitionBy("shard", "task").json(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of write_links; episodes may be folders too."""
    return spark.read.schema(f"{LINKS}, shard string, task string, episode string").json(path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)


def check_config(existing: dict, now: dict, keys: tuple[str, ...]) -> None:
    """Refuse to resume a run with another configuration."""
    changed = [k for k in keys if existing.get(k) != now.get(k)]
    if changed:
        raise ValueError(f"the run was made with other settings: {', '.join(changed)}")


def store_fingerprint(files: DataFrame) -> DataFrame:
    """One row, fingerprint: a hash of all files' names and sizes (path, length), whatever their order; partial sums, no list."""
    h = F.xxhash64("path", "length")
    sums = files.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    return sums.select(F.sha2(F.concat_ws("\n", "n", "x", F.col("s").cast("string")), 256).alias("fingerprint"))


def world_state_objects(states: DataFrame) -> DataFrame:
    """room, object_id, label, alternatives from packaged clips (clip_id, objects).

    Alternatives are the aliases if the package has them, else the second and third label by count; never the label.
    """
    rows = states.select(scene_of(F.col("clip_id")).alias("room"), F.explode("objects").alias("o"))
    counted = F.transform(F.slice(F.reverse(F.array_sort(F.transform(F.map_entries("o.label_counts"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))), 2, 2), lambda e: e["k"])
    names = F.filter(F.coalesce("o.label_aliases", counted), lambda x: x != F.col("o.label"))
    return rows.select("room", F.substring_index("o.id", ":", -1).cast("long").alias("object_id"), "o.label", names.alias("alternatives"))


def packaged(clips: DataFrame, objects: DataFrame) -> DataFrame:
    """episode_id, complete, clips, pending: an episode's clips with their objects; clips without a run are pending."""
    made = objects.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "label"))).alias("objects"))
    rows = clips.join(made, "clip_id", "left")
    entry = F.struct("session_index", "clip_id", "day", "room_gloss", "objects")
    out = rows.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.when(F.col("objects").isNotNull(), entry))).alias("clips"), F.sort_array(F.collect_list(F.when(F.col("objects").isNull(), F.col("clip_id")))).alias("pending"))
    return out.select("episode_id", (F.size("pending") == 0).alias("complete"), "clips", "pending")


def official_view(queries: DataFrame, official: DataFrame) -> DataFrame:
    """Queries of the official evaluation; an official id without a query is an error."""
    missing = official.join(queries, "query_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("official queries are missing from the release")
    return queries.join(official, "query_id", "left_semi")
