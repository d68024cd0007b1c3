"""Ordered operators over frames, poses, sightings and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import slerp

# Fixed values, in frames.
LINK_WINDOW = 60
FRAME_STEP, HALF_STEP = 6, 3


def first_in_bins(frames: DataFrame, key: str, time: str, width: int, order: list[str]) -> DataFrame:
    """The first row of each bin of a whole-numbered time; bins start at the sequence's first time, and may be empty."""
    start = F.min(time).over(W.partitionBy(key))
    ranked = frames.withColumn("bin", F.floor((F.col(time) - start) / F.lit(width))).withColumn("_n", F.row_number().over(W.partitionBy(key, "bin").orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def sample_frames(frames: DataFrame, fps: float = 5.0, key: str = "sequence_id", time: str = "timestamp_seconds") -> DataFrame:
    """The first frame in each of the bins floor((t - t0) * fps + 1e-9)."""
    start = F.min(time).over(W.partitionBy(key))
    ranked = frames.withColumn("bin", F.floor((F.col(time) - start) * fps + 1e-9)).withColumn("_n", F.row_number().over(W.partitionBy(key, "bin").orderBy(time, "frame_id")))
    return ranked.where("_n = 1").drop("_n")


def chunked(frames: DataFrame, size: int = 50, key: str = "sequence_id", position: str = "position") -> DataFrame:
    """sequence_id, chunk, first, end, n: consecutive blocks of so many frames; the last one may be short."""
    rows = frames.groupBy(key, F.floor(F.col(position) / size).alias("chunk")).agg(F.min(position).alias("first"), (F.max(position) + 1).alias("end"), F.count("*").alias("n"))
    return rows


def chunk_gaps(chunks: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Chunks whose end is not where the next one starts."""
    return chunks.withColumn("next", F.lead("first").over(W.partitionBy(key).orderBy("first"))).where("next is not null and next <> end")


def widened(sightings: DataFrame, step: int = FRAME_STEP, half: int = HALF_STEP) -> DataFrame:
    """Each processed frame stands for [max(0, f - half), f + step - half): distinct (room, object_id, frame)."""
    return sightings.select("room", "object_id", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame") - half), F.col("frame") + (step - half - 1))).alias("frame")).distinct()


def widened_cameras(cameras: DataFrame, step: int = FRAME_STEP, half: int = HALF_STEP) -> DataFrame:
    """room, frame, source: the camera of each widened frame; the later processed frame wins."""
    rows = cameras.select("room", F.col("frame").alias("source"), F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame") - half), F.col("frame") + (step - half - 1))).alias("frame"))
    return rows.groupBy("room", "frame").agg(F.max("source").alias("source"))


def observation_grid(turns: DataFrame, step: int = 30, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Distinct frames to observe: every `step` up to the last turn's frame, and every user turn's own frame."""
    last = turns.groupBy(*keys).agg(F.max("frame").alias("last"))
    grid = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(step).cast("long"))).alias("frame"))
    return grid.union(turns.where("role = 'user'").select(*keys, "frame")).distinct()


def held_pose(frames: DataFrame, anchor: Column, values: list[str], key: str = "sequence_id", time: str = "micros") -> DataFrame:
    """Each frame with its pose by two-sided as-of lookup: method measured, interpolated or held, and the values.

    Anchors' own values are measured; before the first and after the last the nearest is held; between two anchors
    values are linear in time. A sequence without an anchor has null values and method.
    """
    back = W.partitionBy(key).orderBy(time, "frame_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(key).orderBy(time, "frame_id").rowsBetween(W.currentRow, W.unboundedFollowing)
    row = F.when(anchor, F.struct(F.col(time).alias("t"), *values))
    out = frames.withColumn("_p", F.last(row, ignorenulls=True).over(back)).withColumn("_n", F.first(row, ignorenulls=True).over(ahead))
    method = F.when(anchor, "measured").when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), "interpolated").when(F.col("_p").isNotNull() | F.col("_n").isNotNull(), "held")
    share = (F.col(time) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    cols = [F.when(method == "interpolated", F.col(f"_p.{v}") + (F.col(f"_n.{v}") - F.col(f"_p.{v}")) * share).otherwise(F.coalesce(f"_p.{v}", f"_n.{v}")).alias(f"pose_{v}") for v in values]
    return out.select(*frames.columns, method.alias("method"), *cols)


def interpolated_pose(frames: DataFrame, key: str = "sequence_id", time: str = "t") -> DataFrame:
    """held_pose with rotation: frames has x, y, z and quaternion qx, qy, qz, qw, null where not measured.

    Rotations follow the shorter arc at constant speed.
    """
    values = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    back = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(key).orderBy(time).rowsBetween(W.currentRow, W.unboundedFollowing)
    row = F.when(F.col("qw").isNotNull(), F.struct(F.col(time).alias("t"), *values))
    out = frames.withColumn("_p", F.last(row, ignorenulls=True).over(back)).withColumn("_n", F.first(row, ignorenulls=True).over(ahead))
    between = F.col("_p").isNotNull() & F.col("_n").isNotNull() & (F.col("_n.t") > F.col("_p.t"))
    share = (F.col(time) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    turn = slerp([F.col(f"_p.q{c}") for c in "xyzw"], [F.col(f"_n.q{c}") for c in "xyzw"], share)
    place = [F.when(between, F.col(f"_p.{v}") + (F.col(f"_n.{v}") - F.col(f"_p.{v}")) * share).otherwise(F.coalesce(f"_p.{v}", f"_n.{v}")).alias(v) for v in "xyz"]
    spin = [F.when(between, q).otherwise(F.coalesce(f"_p.q{c}", f"_n.q{c}")).alias(f"q{c}") for c, q in zip("xyzw", turn)]
    method = F.when(F.col("qw").isNotNull(), "measured").when(between, "interpolated").when(F.coalesce("_p", "_n").isNotNull(), "held")
    return out.select(key, "frame_id", time, method.alias("method"), *place, *spin)


def visible_at(asked: DataFrame, sightings: DataFrame) -> DataFrame:
    """Rows of `asked` (room, frame, ...) with each object sighted at that very frame."""
    return asked.join(sightings.select("room", "frame", "object_id").distinct(), ["room", "frame"])


def in_view_band(asked: DataFrame, sightings: DataFrame, window: int = LINK_WINDOW) -> DataFrame:
    """Rows of `asked` with each object sighted within `window` frames, as an equi-join on frame bins."""
    bins = F.floor(F.col("frame") / window)
    seen = sightings.select("room", "object_id", F.col("frame").alias("seen"), bins.alias("bin")).distinct()
    rows = asked.select("*", F.explode(F.array(bins - 1, bins, bins + 1)).alias("bin"))
    return rows.join(seen, ["room", "bin"]).where(F.abs(F.col("frame") - F.col("seen")) <= window).select(*asked.columns, "object_id").distinct()


def first_sightings(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("room", "object_id").agg(F.min("frame").alias("first_frame"), F.count("*").alias("n"))


def frame_faults(frames: DataFrame, key: str = "sequence_id", time: str = "timestamp_seconds") -> DataFrame:
    """Rows that break a sequence: a time that is null, not finite, or not after the one before it, or a repeated id."""
    before = F.lag(time).over(W.partitionBy(key).orderBy("position"))
    odd = F.col(time).isNull() | F.isnan(F.col(time).cast("double")) | (F.abs(F.col(time).cast("double")) == float("inf"))
    repeated = F.count("*").over(W.partitionBy(key, "frame_id")) > 1
    fault = F.when(odd, "time is not finite").when(F.col(time) <= before, "time does not increase").when(repeated, "id is repeated")
    return frames.withColumn("fault", fault).where("fault is not null")


def first_user_turns(turns: DataFrame, frames: int) -> DataFrame:
    """episode, minute, turn: the first turn of a user in each span of so many frames."""
    return turns.where("role = 'user'").groupBy("episode", F.floor(F.col("frame") / frames).alias("minute")).agg(F.min("turn").alias("turn"))


def renamed_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns with `mapped`: the other id that `ids` (episode, turn, other) has for them, else their own."""
    return turns.join(ids, ["episode", "turn"], "left").withColumn("mapped", F.coalesce("other", "turn")).drop("other")


def anchors(frames: DataFrame, most: int) -> DataFrame:
    """sequence_id, position: at most so many positions of each sequence, evenly spread from the first to the last."""
    n = frames.groupBy("sequence_id").agg(F.count("*").alias("n")).withColumn("m", F.least("n", F.lit(most)))
    rows = n.select("sequence_id", "n", "m", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).alias("i"))
    return rows.select("sequence_id", F.floor(F.col("i") * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("m") - 1)).alias("position")).distinct()


def standing_points(sightings: DataFrame, cameras: DataFrame) -> DataFrame:
    """room, object_id, first_frame, px, py, pz: where the camera stood when it first saw an object; no row without a pose there.

    cameras: room, frame, x, y, z.
    """
    first = first_sightings(sightings).select("room", "object_id", "first_frame")
    poses = cameras.select("room", F.col("frame").alias("first_frame"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    return first.join(poses, ["room", "first_frame"]).select("room", "object_id", "first_frame", "px", "py", "pz")


def seen_either_way(detected: DataFrame, in_sight: DataFrame) -> DataFrame:
    """room, object_id, frame: sightings by a detection, or by a free line of sight."""
    columns = ["room", "object_id", "frame"]
    return detected.select(*columns).unionByName(in_sight.select(*columns)).distinct()
