"""Observations of single frames: mask pixels, query chunks and the stored table of a sequence's observations."""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .readers import cache_faults, parsed_files, write_once
from .shared import put_file

# What a query must reach to be kept, and what a kept one must to be an observation.
LEAST_PROBABILITY, LEAST_PIXELS = 0.001, 200
LEAST_SCORE, LEAST_MASK, RUNNERS_UP = 0.05, 0.4, 4
MARKER = "run_complete.json"


def mask_observations(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """frame, observation_id, object_id, label, track_hint, confidence, n: the annotated objects in each frame's mask.

    pixels: frame, value, one row a pixel; 0 is nothing, others are an object's id plus 1. A value without an object is
    an error. objects: object_id, label.
    """
    seen = pixels.where("value <> 0").groupBy("frame", "value").agg(F.count("*").alias("n"))
    known = seen.withColumn("object_id", F.col("value").cast("long") - 1).join(objects.select("object_id", F.col("label").alias("_l")), "object_id", "left")
    label = F.coalesce("_l", F.raise_error(F.concat(F.lit("no object has the mask value "), F.col("value").cast("string"))))
    name = F.col("object_id").cast("string")
    return known.select("frame", F.concat_ws(":", F.col("frame").cast("string"), name).alias("observation_id"), "object_id", label.alias("label"), name.alias("track_hint"), F.lit(1.0).alias("confidence"), "n")


def query_scores(queries: DataFrame, pixels: DataFrame, pixel_sigmoid: float = 0.5, least: float = LEAST_PROBABILITY, least_pixels: int = LEAST_PIXELS) -> DataFrame:
    """The kept rows of `queries` (chunk, query, probabilities) with score and covered.

    The last probability is that of no object. The score is the best other one times the mean sigmoid of the pixels with
    a positive logit; covered counts pixels with a sigmoid above `pixel_sigmoid`. pixels: chunk, query, logit.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    inside = F.col("logit") > 0
    sums = pixels.groupBy("chunk", "query").agg((F.sum(F.when(inside, p).otherwise(0.0)) / (F.count(F.when(inside, 1)) + 1e-6)).alias("_mean"), F.count(F.when(p > pixel_sigmoid, 1)).alias("covered"))
    best = F.array_max(F.slice("probabilities", F.lit(1), F.size("probabilities") - 1))
    rows = queries.join(sums, ["chunk", "query"]).withColumn("_best", best)
    return rows.where((F.col("_best") >= least) & (F.col("covered") > least_pixels)).select(*queries.columns, (F.col("_best") * F.col("_mean")).alias("score"), "covered")


def decoded_queries(queries: DataFrame, classes: list[str], least_score: float = LEAST_SCORE, runners_up: int = RUNNERS_UP) -> DataFrame:
    """chunk, query, score, label, label_candidates (label, share of the label's probability), of queries of enough score.

    Equal probabilities go by the order of classes. A query without a positive one is an error.
    """
    pairs = F.transform(F.slice("probabilities", F.lit(1), F.size("probabilities") - 1), lambda p, i: F.struct((-p.cast("double")).alias("p"), i.alias("i")))
    rows = queries.where(F.col("score") >= least_score).withColumn("_r", F.array_sort(pairs))
    names = F.array(*map(F.lit, classes))
    top = F.when(F.col("_r")[0]["p"] < 0, -F.col("_r")[0]["p"]).otherwise(F.raise_error(F.lit("a query has no positive probability")).cast("double"))
    rows = rows.withColumn("_top", top)
    others = F.transform(F.slice("_r", 2, runners_up) if runners_up else F.slice("_r", 1, 0), lambda x: F.struct(F.get(names, x["i"]).alias("label"), (-x["p"] / F.col("_top")).alias("score")))
    return rows.select("chunk", "query", "score", F.get(names, F.col("_r")[0]["i"]).alias("label"), others.alias("label_candidates"))


def decoded_cells(maps: DataFrame, queries: DataFrame, frames: DataFrame, sequence_id: str, least: float = LEAST_MASK) -> DataFrame:
    """frame_id, observation_id, track_hint, chunk, query, row, col: mask cells of decoded queries.

    maps: chunk, query, position, row, col, value (0 to 255), of the frames' own size; frames: position, frame_id. Hints
    hold within a chunk, as queries do.
    """
    on = maps.where(F.col("value") > least * 255).join(queries.select("chunk", "query"), ["chunk", "query"], "left_semi").join(frames.select("position", "frame_id"), "position")
    hint = F.concat_ws(":", F.lit(sequence_id), F.lit("chunk"), F.col("chunk").cast("string"), F.lit("query"), F.col("query").cast("string"))
    return on.select("frame_id", F.concat_ws(":", hint, F.col("position").cast("string")).alias("observation_id"), hint.alias("track_hint"), "chunk", "query", "row", "col")


def range_faults(ranges: DataFrame, frames: int) -> DataFrame:
    """chunk, start, end, fault: chunks that do not cover positions 0 to `frames` in order, without gap or overlap."""
    w = W.orderBy("chunk")  # a sequence's chunks, not its frames
    rows = ranges.withColumn("_due", F.lag("end", 1, 0).over(w)).withColumn("_last", F.lead("chunk").over(w).isNull())
    fault = F.when(F.col("start") >= F.col("end"), "chunk is empty").when(F.col("start") > F.col("_due"), "gap before the chunk").when(F.col("start") < F.col("_due"), "chunk overlaps").when(F.col("_last") & (F.col("end") != frames), "chunks do not end with the frames")
    return rows.withColumn("fault", fault).where("fault is not null").select("chunk", "start", "end", "fault")


def read_query_chunks(spark: SparkSession, path: str, query_count: int, classes: int) -> DataFrame:
    """chunk, query, probabilities, score, positions of archives `chunk_000.npz` and on; wrong kinds, shapes or ids are errors."""

    def parse(name: str, data: bytes) -> pd.DataFrame:
        with np.load(io.BytesIO(data), allow_pickle=False) as saved:
            a = {k: saved[k] for k in ("positions", "queries", "probabilities", "score", "maps")}
        n = len(a["queries"])
        kinds = {"queries": "int64", "probabilities": "float16", "score": "float32", "maps": "uint8"}
        shapes = {"queries": (n,), "probabilities": (n, classes + 1), "score": (n,)}
        odd = [k for k, v in kinds.items() if a[k].dtype != v] + [k for k, v in shapes.items() if a[k].shape != v]
        odd += [k for k in ("probabilities", "score") if not np.isfinite(a[k]).all()]
        if a["maps"].ndim != 4 or a["maps"].shape[:2] != (n, len(a["positions"])):
            odd.append("maps")
        ids = a["queries"].tolist()
        if len(set(ids)) != n or any(not 0 <= q < query_count for q in ids):
            odd.append("queries")
        if odd:
            raise ValueError(f"{name}: wrong {', '.join(sorted(set(odd)))}")
        chunk = int(re.search(r"chunk_(\d+)\.npz$", name)[1])
        return pd.DataFrame({"chunk": chunk, "query": ids, "probabilities": a["probabilities"].astype(float).tolist(), "score": a["score"].astype(float), "positions": [a["positions"].tolist()] * n})

    return parsed_files(spark, path, parse, "chunk long, query long, probabilities array<double>, score double, positions array<long>", "chunk_*.npz")


def observation_faults(frames: DataFrame, observations: DataFrame) -> DataFrame:
    """fault, key: what keeps observations from being stored; an empty table is sound.

    frames: position, frame_id, h, w; observations: observation_id, frame_id, label, confidence, track_hint,
    label_candidates (label, score), bits (packed rows of the mask).
    """
    finite = F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") < float("inf"))
    sized = observations.join(frames.select("frame_id", "h", "w"), "frame_id", "left")
    fault = F.when(F.coalesce("observation_id", F.lit("")) == "", "observation id is empty").when(F.col("h").isNull(), "frame is not of the sequence").when(~finite, "confidence is not finite")
    fault = fault.when(F.coalesce(F.length("bits"), F.lit(-1)) != F.ceil(F.col("h") * F.col("w") / 8), "mask has another size").when(F.size(F.array_distinct("label_candidates.label")) != F.size("label_candidates"), "a candidate is repeated")
    own = sized.select(fault.alias("fault"), F.col("observation_id").alias("key")).where("fault is not null")
    return own.unionByName(cache_faults(observations))


def write_observations(frames: DataFrame, observations: DataFrame, path: str) -> None:
    """Store a sequence's frames and observations; the marker of completion comes last, and what exists is not overwritten."""
    spark = frames.sparkSession
    if fault := observation_faults(frames, observations).first():
        raise ValueError(f"{fault.fault}: {fault.key}")
    write_once(frames, f"{path}/frames")
    write_once(observations, f"{path}/observations")
    count = spark.read.parquet(f"{path}/frames").count()
    put_file(spark, f"{path}/{MARKER}", json.dumps({"frame_count": count}).encode())


def read_observations(frames: DataFrame, path: str) -> DataFrame:
    """The observations stored for just these frames, in this order; others, or an unfinished store, are an error."""
    spark = frames.sparkSession
    saved = spark.read.parquet(f"{path}/frames")
    marked = json.loads(spark.read.text(f"{path}/{MARKER}", wholetext=True).first().value)
    if marked["frame_count"] != saved.count() or not frame_differences(saved, frames).isEmpty():
        raise ValueError("the stored observations are of other frames")
    return spark.read.parquet(f"{path}/observations")


def frame_differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """position, one, other: positions at which two ordered lists of frames (position, frame_id) differ."""
    both = one.select("position", F.col("frame_id").alias("one")).join(other.select("position", F.col("frame_id").alias("other")), "position", "full")
    return both.where(~F.col("one").eqNullSafe(F.col("other")))
