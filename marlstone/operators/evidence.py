"""Aggregation of points, labels and observations into objects."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import squared_distance
from . import spatial

# Fixed values.
MOST_ALIASES, LEAST_ALIAS_SCORE, LEAST_ALIAS_SHARE = 2, 2.0, 0.10
VOXEL = 0.05
LOW, HIGH = 0.005, 0.995
NEIGHBOURS, SIGMAS, LEAST_INLIERS = 12, 1.0, 8
LEAST_PIXELS, LEAST_AREA_SHARE = 50, 0.005
LEAST_VERTICES, LEAST_EXTENT = 200, 0.05
LEAST_OBSERVATIONS = 4
SURFACE_SIDE = 1.0
#: Cells of masks that Python works on at once, but for those of one frame, and bytes of the grids that they lie on.
FRAME_CELLS, MASK_BYTES = 1 << 19, 1 << 25
# Room structure, for scenes and for masks.
SCENE_STRUCTURE = ("wall", "floor", "ceiling", "door", "doorframe", "window", "remove", "unannotated", "otherstructure", "floor mat")
MASK_STRUCTURE = ("wall", "floor", "ceiling", "door", "window", "doorframe", "floor mat")
# Furniture that no single view can hold.
LARGE_SURFACES = ("table", "desk", "counter", "cabinet", "couch", "bed", "shelf", "bookshelf", "dresser", "nightstand", "tv stand", "bench", "ottoman", "wardrobe", "curtain")


def boxes(points: DataFrame, key: str = "object_id") -> DataFrame:
    """Mean, extremes and count of each object's points."""
    stats = [f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("c", F.avg), ("lo", F.min), ("hi", F.max))]
    return points.groupBy(key).agg(F.count("*").alias("n"), *stats)


def percentile_boxes(points: DataFrame, low: float = LOW, high: float = HIGH, key: str = "object_id") -> DataFrame:
    """Per-axis percentiles with linear interpolation, and the mean over all points."""
    cuts = [F.percentile(a, F.array(F.lit(low), F.lit(high))).alias(f"_{a}") for a in "xyz"]
    rows = points.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c{a}") for a in "xyz"), *cuts)
    return rows.select(key, "n", "cx", "cy", "cz", *(F.col(f"_{a}")[i].alias(f"{a}{i}") for a in "xyz" for i in (0, 1)))


def voxel_reduced(points: DataFrame, size: float = VOXEL, key: str = "object_id") -> DataFrame:
    """The first point, by idx, of each object's grid cell."""
    cell = [F.floor(F.col(a) / size) for a in "xyz"]
    return points.withColumn("_n", F.row_number().over(W.partitionBy(key, *cell).orderBy("idx"))).where("_n = 1").drop("_n")


def neighbour_means(points: DataFrame, neighbours: int = NEIGHBOURS, key: str = "object_id") -> DataFrame:
    """Points with spread: the mean distance to the nearest others of the object; null for a point that has no other."""
    places = points.select(key, "idx", "x", "y", "z")
    found = spatial.nearest_join(places, places, [key], neighbours, "idx", names=("x", "y", "z"))
    pairs = found.select(F.col(f"a.{key}").alias(key), F.col("a.idx").alias("idx"), F.sqrt(squared_distance("a", "b", ("x", "y", "z"))).alias("gap"))
    spread = pairs.groupBy(key, "idx").agg(F.avg("gap").alias("spread"))
    return points.join(spread, [key, "idx"], "left").select(*points.columns, "spread")


def tightened(points: DataFrame, neighbours: int = NEIGHBOURS, sigmas: float = SIGMAS, key: str = "object_id") -> DataFrame:
    """Points within mean + sigmas * population deviation of their object's spreads.

    Objects of too few points, or that would keep under LEAST_INLIERS, keep all.
    """
    spread = neighbour_means(points, neighbours, key)
    w = W.partitionBy(key)
    marked = spread.withColumn("inside", F.col("spread") <= F.avg("spread").over(w) + sigmas * F.stddev_pop("spread").over(w))
    enough = (F.count("*").over(w) > neighbours + 1) & (F.sum(F.col("inside").cast("int")).over(w) >= LEAST_INLIERS)
    return marked.withColumn("_keep", F.coalesce(F.col("inside"), F.lit(False)) | ~F.coalesce(enough, F.lit(False))).where("_keep").select(*points.columns)


def label_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("object_id", "label").agg(F.count("*").alias("n"))


def label_scores(votes: DataFrame, score: str, order: str) -> DataFrame:
    """object_id, label, score (sum), first_seq (arrival of the label)."""
    return votes.groupBy("object_id", "label").agg(F.sum(score).alias("score"), F.min(order).alias("first_seq"))


def observation_scores(candidates: DataFrame) -> DataFrame:
    """object_id, label, score from observations: 1 for the primary label, the best relative score for each other.

    candidates: object_id, observation_id, label, score (relative), is_primary.
    """
    each = candidates.groupBy("object_id", "observation_id", "label").agg(F.max(F.when(F.col("is_primary"), F.lit(1.0)).otherwise(F.col("score"))).alias("score"))
    return each.groupBy("object_id", "label").agg(F.sum("score").alias("score"))


def ranked_labels(scores: DataFrame, most: int = MOST_ALIASES, least: float | Column = LEAST_ALIAS_SCORE, share: float = LEAST_ALIAS_SHARE) -> DataFrame:
    """object_id, label (most score, then first seen), aliases, candidates (label, support).

    Runners-up have positive scores and go by score, then by arrival. Aliases are the first of those that reach
    `least` and a share of the winner's score. Objects without a positive score give no row.
    """
    w = W.partitionBy("object_id")
    order = w.orderBy(F.desc("score"), "first_seq", "label")
    rows = scores.withColumn("rank", F.row_number().over(order)).withColumn("top", F.max("score").over(w)).withColumn("total", F.sum("score").over(w)).where("top > 0 and score > 0")
    entry = F.struct("rank", "label", (F.col("score") / F.col("total")).alias("support"))
    good = (F.col("rank") > 1) & (F.col("score") >= F.greatest(F.lit(least), F.col("top") * share))
    grouped = rows.groupBy("object_id").agg(
        F.min_by("label", "rank").alias("label"), F.sort_array(F.collect_list(F.when(good, entry))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("rank") > 1, entry))).alias("c"),
    )
    return grouped.select("object_id", "label", F.transform(F.slice("a", 1, most), lambda x: x["label"]).alias("aliases"), F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["support"].alias("support"))).alias("candidates"))


def renumbered(objects: DataFrame, observations: str, least: int = LEAST_OBSERVATIONS, order: str = "object_id") -> DataFrame:
    """Objects of enough observations, with new_id `object:NNNN` by their order.

    Numbers are counted within ranges of the order first, so no task sorts all objects.
    """
    kept = objects.where(F.col(observations) >= least)
    bucket = F.floor(F.col(order) / 4096)
    before = kept.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_c")).select("_b", (F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).alias("_before"))
    rows = kept.withColumn("_b", bucket).withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy(order)))
    return rows.join(before, "_b").withColumn("new_id", F.format_string("object:%04d", F.col("_before") + F.col("_n") - 1)).drop("_b", "_n", "_before")


def visible_pixels(counts: DataFrame, area: str = "area") -> DataFrame:
    """Instances that cover enough pixels of a frame."""
    return counts.where(F.col("n") >= F.greatest(F.lit(float(LEAST_PIXELS)), F.lit(LEAST_AREA_SHARE) * F.col(area)))


def not_structure(objects: DataFrame, structure: tuple[str, ...] = SCENE_STRUCTURE) -> DataFrame:
    return objects.where(~F.col("label").isin(*structure))


def mean_directions(descriptors: DataFrame, key: str = "object_id") -> DataFrame:
    """Normalised mean of each object's descriptor vectors."""
    dims = descriptors.select(key, F.posexplode("vector").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("m"))
    rows = dims.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v)) + 1e-9
    return rows.select(key, F.transform("m", lambda v: v / norm).alias("direction"))


def seen_together(sightings: DataFrame) -> DataFrame:
    """a_object, b_object: pairs of a room that some frame shows together, a < b."""
    s, t = sightings.alias("s"), sightings.alias("t")
    on = (F.col("s.room") == F.col("t.room")) & (F.col("s.frame") == F.col("t.frame")) & (F.col("s.object_id") < F.col("t.object_id"))
    return s.join(t, on).select(F.col("s.object_id").alias("a_object"), F.col("t.object_id").alias("b_object")).distinct()


def never_together(pairs: DataFrame, sightings: DataFrame) -> DataFrame:
    """The pairs (a_object < b_object) that no frame shows together."""
    return pairs.join(seen_together(sightings), ["a_object", "b_object"], "left_anti")


def apart_pairs(objects: DataFrame, sightings: DataFrame, size: int = 512) -> DataFrame:
    """a_object, b_object: pairs of a room, a < b, that no frame shows together.

    Each object takes along those seen with it, so that pairs leave the task that makes them only as results; rooms are
    dealt by blocks of about `size` objects.
    """
    rooms = objects.groupBy("room").agg(F.ceil(F.count("*") / size).alias("_parts"))
    together = seen_together(sightings).groupBy(F.col("a_object").alias("object_id")).agg(F.collect_set("b_object").alias("_seen"))
    a = objects.select("room", "object_id").join(rooms, "room").join(together, "object_id", "left").select("room", F.col("object_id").alias("a_object"), "_seen", F.pmod(F.xxhash64("object_id"), F.col("_parts")).alias("_part"))
    b = objects.select("room", "object_id").join(rooms, "room").select("room", F.col("object_id").alias("b_object"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    a, b = (side.repartition(spatial.TASKS, "room", "_part") for side in (a, b))
    pairs = a.join(b.hint("shuffle_hash"), ["room", "_part"]).where("a_object < b_object")
    return pairs.where(F.col("_seen").isNull() | ~F.array_contains("_seen", F.col("b_object"))).select("a_object", "b_object")


def look_alikes(vectors: DataFrame, least: float, key: str = "room", name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """a_object, b_object: pairs of a key, a < b, whose vectors' dot product in array order reaches `least`.

    Blocks are multiplied as matrices; a product too close to `least` for that is summed again in order.
    """
    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        sides = [[t["object_id"].to_numpy(), t["vector"].combine_chunks()] for t in (left, right)]
        for length in np.intersect1d(*(pc.unique(pc.list_value_length(v)).to_numpy() for _, v in sides)):
            (ids, a), (others, b) = ((names[own], v.filter(pa.array(own)).flatten().to_numpy().astype(float).reshape(-1, length)) for names, v in sides for own in (pc.list_value_length(v).to_numpy() == length,))
            slack = 1e-9 * max(1.0, float(np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * length)
            for at in range(0, len(a), 256):
                product = a[at : at + 256] @ b.T
                i, j = np.nonzero((product >= least - slack) & (ids[at : at + 256, None] < others))
                close = np.flatnonzero(np.abs(product[i, j] - least) <= slack)
                exact = np.zeros(len(close))
                for k in range(length):
                    exact = exact + a[at + i[close], k] * b[j[close], k]
                kept = np.ones(len(i), bool)
                kept[close] = exact >= least
                yield pa.table({"a_object": ids[at + i[kept]], "b_object": others[j[kept]]})

    rows = vectors.select(F.col(key).alias("key"), F.col(name).alias("object_id"), F.col(vector).alias("vector"))
    whole = rows.where(F.col("object_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull()))
    kind = vectors.schema[name].dataType.simpleString()
    return spatial.block_pairs(whole, whole, ["key"], work, f"a_object {kind}, b_object {kind}")


def one_surface(left: str, right: str) -> Column:
    """Whether two objects with these prefixes (label, side) may be pieces of a surface that no view holds."""
    same = (F.col(f"{left}.label") == F.col(f"{right}.label")) & F.col(f"{left}.label").isin(*LARGE_SURFACES)
    return F.coalesce(same & (F.greatest(F.col(f"{left}.side"), F.col(f"{right}.side")) >= SURFACE_SIDE), F.lit(False))


def merge_edges(overlaps: DataFrame, sightings: DataFrame, vectors: DataFrame, sides: DataFrame | None = None, hints: DataFrame | None = None, least_overlap: float = 0.5, least_cosine: float = 0.5) -> DataFrame:
    """a_object, b_object: pairs that overlap enough, share a track or look alike, and are never seen in one frame.

    overlaps: a_object, b_object, n_points, n_near, of which rows with a < b count. sides (object_id, label, side)
    exempts pieces of one large surface from the veto by frames, and from nothing else; hints (object_id, hint)
    confirms pairs that share one.
    """
    from ..functions.geometry import cosine

    pairs = overlaps.where((F.col("a_object") < F.col("b_object")) & (F.col("n_near") >= least_overlap * F.col("n_points"))).select("a_object", "b_object")
    looks = vectors.select("object_id", "vector")
    confirmed = pairs.join(looks.toDF("a_object", "u"), "a_object").join(looks.toDF("b_object", "v"), "b_object").where(cosine(F.col("u"), F.col("v")) >= least_cosine).select("a_object", "b_object")
    if hints is not None:
        own = hints.select("object_id", "hint").distinct()
        confirmed = confirmed.unionByName(pairs.join(own.toDF("a_object", "hint"), "a_object").join(own.toDF("b_object", "hint"), ["b_object", "hint"]).select("a_object", "b_object")).distinct()
    free = never_together(confirmed, sightings)
    if sides is None:
        return free
    of = sides.select("object_id", "label", "side")
    large = confirmed.alias("p").join(of.alias("a"), F.col("p.a_object") == F.col("a.object_id")).join(of.alias("b"), F.col("p.b_object") == F.col("b.object_id")).where(one_surface("a", "b"))
    return free.unionByName(large.select("a_object", "b_object")).distinct()


def confident(pixels: DataFrame, column: str, least: float) -> DataFrame:
    """Rows whose confidence reaches the threshold; nulls and NaN do not."""
    return pixels.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) >= least))


def valid_pixels(pixels: DataFrame, depth: str, confidence: str, least: float, most: float = float("inf")) -> DataFrame:
    """Rows of a positive depth below `most` and of enough confidence."""
    return confident(pixels, confidence, least).where(F.col(depth).isNotNull() & ~F.isnan(depth) & (F.col(depth) > 0) & (F.col(depth) < most))


def strided(points: DataFrame, most: int, key: str = "object_id", order: str = "idx") -> DataFrame:
    """Every k-th point of each object, k the least whole number that leaves at most `most`."""
    w = W.partitionBy(key)
    rows = points.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")


def runners_up(scores: DataFrame, most: int = 4) -> DataFrame:
    """object_id, label, rank (from 2), share of the winner's score: the next labels after the winner."""
    w = W.partitionBy("object_id")
    ranked = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "first_seq", "label"))).withColumn("_top", F.max("score").over(w))
    return ranked.where((F.col("rank") > 1) & (F.col("rank") <= most + 1) & (F.col("_top") > 0)).select("object_id", "label", F.col("rank").cast("long").alias("rank"), (F.col("score") / F.col("_top")).alias("share"))


def merged_counts(counts: DataFrame, into: Column) -> DataFrame:
    """object_id, counts (map of label to n): label counts of several objects added up under a new id."""
    each = counts.groupBy(into.alias("object_id"), "label").agg(F.sum("n").alias("n"))
    return each.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("counts"))


def eroded(cells: DataFrame, radius: int) -> DataFrame:
    """Mask cells (frame_id, row, col) whose whole square neighbourhood is in the mask."""
    around = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = cells.select("frame_id", "row", "col", around.alias("dr")).select("frame_id", (F.col("row") + F.col("dr")).alias("row"), "col", around.alias("dc")).select("frame_id", "row", (F.col("col") + F.col("dc")).alias("col"))
    full = spread.groupBy("frame_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == (2 * radius + 1) ** 2)
    return full.select("frame_id", "row", "col")


def whole_frames(cells: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, together: bool = False) -> DataFrame:
    """The results of `work` on cells of whole frames: it gets some frames' rows, frame after frame, and a number of the frame for each row.

    Rows are dealt by frame, unless each frame's are `together`: in one partition, one after the other. Python holds the
    cells of one frame, or FRAME_CELLS of them.
    """
    known = cells.where(F.col("frame_id").isNotNull())
    dealt = known if together else known.repartition("frame_id").sortWithinPartitions("frame_id")

    def changes(frames: pa.Array) -> np.ndarray:
        return np.flatnonzero(np.diff(frames.dictionary_encode().indices.to_numpy())) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            frame = np.zeros(len(table), np.int64)
            frame[changes(table["frame_id"].chunk(0))] = 1
            yield from work(table, np.cumsum(frame)).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if sum(map(len, held)) + len(batch) > FRAME_CELLS and len(at := changes(batch["frame_id"])):
                yield from done([*held, batch.slice(0, at[-1])])
                held, batch = [], batch.slice(at[-1])
            if len(batch):
                held.append(batch)
        if held:
            yield from done(held)

    return dealt.mapInArrow(run, schema)


def frame_percentiles(depth: np.ndarray, frame: np.ndarray, n: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Percentiles of each of n frames, with linear interpolation; NaN for a frame without a row. NaN depths are largest."""
    order = np.lexsort((depth, frame))
    count = np.bincount(frame, minlength=n)
    first, ranked, out = np.cumsum(count) - count, depth[order], []
    for share in shares:
        at = np.maximum(count - 1, 0) * share
        low, high = np.floor(at), np.ceil(at)
        below, above = (ranked[np.where(count, first + x.astype(np.int64), 0)] if len(ranked) else np.full(n, np.nan) for x in (low, high))
        value = np.where((low == high) | (below == above), below, (high - at) * below + (at - low) * above)
        out.append(np.where(count > 0, value, np.nan))
    return out


def inner_cells(frame: np.ndarray, row: np.ndarray, col: np.ndarray, radius: int) -> np.ndarray:
    """Whether each cell's square neighbourhood is in the mask of its frame; frames are numbered in order."""
    inside = np.zeros(len(row), bool)
    if not len(row):
        return inside
    first = np.flatnonzero(np.diff(frame, prepend=-1))
    least = [np.minimum.reduceat(x, first)[frame] for x in (row, col)]
    r, c = (x - low + radius for x, low in zip((row, col), least))
    height, width = (int(x.max()) + radius + 1 for x in (r, c))
    step = max(1, MASK_BYTES // (height * width))
    for at in range(0, int(frame[-1]) + 1, step):
        own = slice(*np.searchsorted(frame, (at, at + step)))
        full = np.zeros((min(step, int(frame[-1]) + 1 - at), height, width), bool)
        full[frame[own] - at, r[own], c[own]] = True
        for axis in (1, 2):
            size = full.shape[axis] - 2 * radius
            full = np.logical_and.reduce([np.take(full, range(i, i + size), axis) for i in range(2 * radius + 1)])
        inside[own] = full[frame[own] - at, r[own] - radius, c[own] - radius]
    return inside


def depth_core(cells: DataFrame, radius: int = 2, low: float = 0.05, high: float = 0.95, tolerance: float = 0.1, least: int = 20, together: bool = False) -> DataFrame:
    """Cells (frame_id, row, col, depth) with depths about those of the mask's interior; all cells if it is small. `together`: as in whole_frames."""

    def work(table: pa.Table, frame: np.ndarray) -> pa.Table:
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        depth = table["depth"].to_numpy().astype(float)
        known, n = ~np.isnan(depth) | table["depth"].is_valid().to_numpy(), int(frame[-1]) + 1
        inside = inner_cells(frame, row, col, radius)
        core, whole = (frame_percentiles(depth[m], frame[m], n, (low, high)) for m in (inside & known, known))
        enough = np.bincount(frame[inside], minlength=n) >= least
        least_depth, most_depth = (np.where(enough & ~np.isnan(q), q, w) for q, w in zip(core, whole))
        return table.filter(pa.array((depth >= least_depth[frame] - tolerance) & (depth <= most_depth[frame] + tolerance)))

    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in cells.columns)
    return whole_frames(cells, work, kinds, together)


def coverage(cells: DataFrame, height: int, width: int, rows: int, cols: int, least: float = 0.5) -> DataFrame:
    """frame_id, row, col, share: cells of a coarse grid of which a mask on a fine grid covers at least a share.

    cells: the fine mask (frame_id, row, col) of height x width; the coarse grid has rows x cols. Weights are
    overlaps of intervals on either axis, and add up in arrays by batch, then in one aggregation.
    """
    def spread(fine: np.ndarray, size: float, coarse: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.floor(fine / size).astype(np.int64)
        for step in range(math.ceil(1 / size) + 1):
            at = first + step
            shared = np.maximum(0.0, np.minimum((at + 1) * size, fine + 1.0) - np.maximum(at * size, fine * 1.0)) / size
            yield at, np.where((at >= 0) & (at < coarse), shared, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch["frame_id"].dictionary_encode()
            frame, row, col = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (frames.indices, batch["row"], batch["col"]))
            across = list(spread(col, width / cols, cols))
            parts = [(((frame * rows + r) * cols + c)[w > 0], w[w > 0]) for r, v in spread(row, height / rows, rows) for c, u in across for w in (v * u,)]
            keys, weights, most = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts]), len(frames.dictionary) * rows * cols
            if most <= 8 * len(keys):  # few cells of the coarse grid: no need to sort
                share = np.bincount(keys, weights, most)
                found = np.flatnonzero(share)
                share = share[found]
            else:
                found, place = np.unique(keys, return_inverse=True)
                share = np.bincount(place, weights, len(found))
            out = [frames.dictionary.take(pa.array(found // (rows * cols))), pa.array(found // cols % rows), pa.array(found % cols), pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, ["frame_id", "row", "col", "share"])

    known = cells.select("frame_id", "row", "col").dropna(subset=["row", "col"])
    sums = known.mapInArrow(run, f"frame_id {cells.schema['frame_id'].dataType.simpleString()}, row long, col long, share double")
    return sums.groupBy("frame_id", "row", "col").agg(F.sum("share").alias("share")).where(F.col("share") >= least)


def line_of_sight(points: DataFrame, cameras: DataFrame, depths: DataFrame, width: int, height: int, most: int = 300, least_share: float = 0.25, least_area: float = 0.005, tolerance: float = 0.1) -> DataFrame:
    """object_id, frame_id: objects of which enough points project into a frame and are not hidden.

    points: room, object_id, idx, x, y, z, every ceil(n / most)-th of which is used. cameras: room, frame_id, m (world to
    camera, 16 numbers), fx, fy, cx, cy. depths: frame_id, row, col, depth; pixels without a depth hide nothing.
    """
    from ..functions.geometry import applied

    w = W.partitionBy("object_id")
    sampled = points.withColumn("_i", F.row_number().over(w.orderBy("idx")) - 1).withColumn("_n", F.count("*").over(w)).where(F.col("_i") % F.ceil(F.col("_n") / most) == 0)
    seen = sampled.join(cameras, "room")
    x, y, z = applied(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    placed = seen.withColumn("_x", x).withColumn("_y", y).withColumn("_z", z)
    u, v = F.col("fx") * F.col("_x") / F.col("_z") + F.col("cx"), F.col("fy") * F.col("_y") / F.col("_z") + F.col("cy")
    inside = (F.col("_z") > 0) & (F.col("_u") >= 0) & (F.col("_u") < width - 0.5) & (F.col("_v") >= 0) & (F.col("_v") < height - 0.5)
    placed = placed.withColumn("_u", u).withColumn("_v", v).withColumn("in_frame", F.coalesce(inside, F.lit(False)))
    placed = placed.withColumn("row", F.when(F.col("in_frame"), F.bround("_v").cast("int"))).withColumn("col", F.when(F.col("in_frame"), F.bround("_u").cast("int")))
    hidden = F.coalesce(F.col("depth") < F.col("_z") - tolerance, F.lit(False))
    hit = placed.join(depths, ["frame_id", "row", "col"], "left").withColumn("clear", F.col("in_frame") & ~hidden)
    span = lambda c: F.max(F.when(F.col("clear"), F.col(c))) - F.min(F.when(F.col("clear"), F.col(c)))
    stats = hit.groupBy("object_id", "frame_id").agg(F.count("*").alias("n"), F.sum(F.col("clear").cast("int")).alias("k"), (span("_u") * span("_v")).alias("area"))
    return stats.where((F.col("k") >= 2) & (F.col("k") >= least_share * F.col("n")) & (F.col("area") >= least_area * width * height)).select("object_id", "frame_id")
