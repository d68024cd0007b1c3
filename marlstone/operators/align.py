"""Alignment of two scene stores: similarity fit from shared cameras, and one-to-one object assignment."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import settled
from .spatial import iou_or_distance

# Fixed values.
LEAST_SHARED_POSES, POSE_DECIMALS = 10, 5
#: Tasks that rooms are dealt to, and pairs of boxes that are compared at once, but for those of one box.
ROOM_TASKS, AT_ONCE = 256, 1 << 16


def shared_poses(recon: DataFrame, truth: DataFrame, decimals: int = POSE_DECIMALS) -> DataFrame:
    """clip, frame, x y z, u v w: cameras at common frames; of equal rounded reconstructed places the first frame counts.

    Both sides: clip, frame, x, y, z.
    """
    both = recon.join(truth.select("clip", "frame", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), ["clip", "frame"])
    w = W.partitionBy("clip", *(F.round(c, decimals) for c in "xyz")).orderBy("frame")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def similarity_fit(poses: DataFrame, least: int = LEAST_SHARED_POSES) -> DataFrame:
    """clip, scale, rotation (9), shift (3), n, residual: the least-squares similarity from x y z to u v w.

    Sums of products come from one aggregation per clip; only their 3x3 decomposition runs in Python, a row a clip.
    Clips with fewer shared poses give no row.
    """
    sides = ("x", "y", "z"), ("u", "v", "w")
    sums = [F.sum(c).alias(f"s_{c}") for s in sides for c in s] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{b}{a}") for a in sides[0] for b in sides[1]]
    squares = [F.sum(sum((F.col(c) * F.col(c) for c in s), F.lit(0.0))).alias(f"q{i}") for i, s in enumerate(sides)]
    moments = poses.groupBy("clip").agg(F.count("*").alias("n"), *sums, *squares).where(F.col("n") >= least)

    def solve(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                mx, my = (np.array([getattr(r, f"s_{c}") for c in s]) / r.n for s in sides)
                cov = np.array([[getattr(r, f"p_{b}{a}") / r.n - my[j] * mx[i] for i, a in enumerate(sides[0])] for j, b in enumerate(sides[1])])
                left, d, right = np.linalg.svd(cov)
                flip = np.diag([1, 1, np.sign(np.linalg.det(left) * np.linalg.det(right))])
                spread = r.q0 / r.n - mx @ mx
                rotation = left @ flip @ right
                scale = float(np.trace(np.diag(d) @ flip) / spread) if spread > 0 else 1.0
                out.append((r.clip, scale, rotation.ravel().tolist(), (my - scale * rotation @ mx).tolist(), r.n))
            yield pd.DataFrame(out, columns=["clip", "scale", "rotation", "shift", "n"])

    kind = poses.schema["clip"].dataType.simpleString()
    return moments.mapInPandas(solve, f"clip {kind}, scale double, rotation array<double>, shift array<double>, n long")


def transformed(points: DataFrame, fit: DataFrame, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Points of each clip under its fit, in place."""
    rows = points.join(fit.select("clip", "scale", "rotation", "shift"), "clip")
    new = [F.col("scale") * sum((F.col("rotation")[3 * r + c] * F.col(n) for c, n in enumerate(names)), F.lit(0.0)) + F.col("shift")[r] for r in range(3)]
    keep = [c for c in points.columns if c not in names]
    return rows.select(*keep, *(e.alias(n) for e, n in zip(new, names)))


def transformed_boxes(objects: DataFrame, fit: DataFrame) -> DataFrame:
    """Boxes with only their two extreme corners transformed, then put in order on each axis."""
    low = transformed(objects.select("clip", "object_id", "x0", "y0", "z0"), fit, ("x0", "y0", "z0"))
    high = transformed(objects.select("clip", "object_id", "x1", "y1", "z1"), fit, ("x1", "y1", "z1"))
    rows = transformed(objects.select("clip", "object_id", "label", "cx", "cy", "cz"), fit, ("cx", "cy", "cz")).join(low, ["clip", "object_id"]).join(high, ["clip", "object_id"])
    return rows.select("clip", "object_id", "label", "cx", "cy", "cz", *(F.least(f"{a}0", f"{a}1").alias(f"{a}0") for a in "xyz"), *(F.greatest(f"{a}0", f"{a}1").alias(f"{a}1") for a in "xyz"))


def residuals(poses: DataFrame, fit: DataFrame) -> DataFrame:
    """clip, residual: the mean distance between transformed and true cameras."""
    moved = transformed(poses, fit)
    gap = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip("xyz", "uvw")), F.lit(0.0)))
    return moved.groupBy("clip").agg(F.avg(gap).alias("residual"))


def candidate_pairs(left: DataFrame, right: DataFrame, radius: float = 1.0) -> DataFrame:
    """room, i, j, iou, distance, tier: pairs whose boxes intersect or whose centroids are near; intersecting ones come first.

    Found on grid cells: pairs of a room are never all formed. Both sides number their objects apart, so equal ids are a pair too.
    """
    apart = lambda side, sign: side.withColumn("object_id", F.struct("object_id", F.lit(sign).alias("side")))
    pairs = iou_or_distance(apart(left, 0), apart(right, 1), radius)
    tier = F.when(F.col("iou") > 0, 0).otherwise(1)
    return pairs.select("room", F.col("a_id.object_id").alias("i"), F.col("b_id.object_id").alias("j"), "iou", "distance", tier.alias("tier"))


def greedy_assignment(pairs: DataFrame, order: list[str], key: str = "room") -> DataFrame:
    """key, i, j: pairs taken in order if both sides are free, as rounds of mutual best pairs.

    A pair that is the first of both its sides is taken by the sequential rule too, whatever comes between, so each
    round takes all such pairs and drops the pairs of their sides; the order must be total, and i and j end it. Every
    round takes at least the first pair of each key, so rounds end when no pair is left, after as many as the longest
    chain of pairs that wait for each other. Each round's remainder is checkpointed.
    """
    rank = F.struct(*order, "i", "j")
    left = pairs.select(key, "i", "j", *[c for c in order if c not in ("i", "j")])
    rounds: list[DataFrame] = []
    while True:
        best = left.withColumn("_r", rank).withColumn("_i", F.min("_r").over(W.partitionBy(key, "i"))).withColumn("_j", F.min("_r").over(W.partitionBy(key, "j")))
        mutual = settled(best.where((F.col("_r") == F.col("_i")) & (F.col("_r") == F.col("_j"))).select(key, "i", "j"))
        if mutual.isEmpty():
            break
        rounds.append(mutual)
        if len(rounds) == 32:
            rounds = [settled(reduce(DataFrame.unionByName, rounds))]
        left = settled(left.join(mutual.select(key, "i"), [key, "i"], "left_anti").join(mutual.select(key, "j"), [key, "j"], "left_anti"))
    return reduce(DataFrame.unionByName, rounds) if rounds else pairs.select(key, "i", "j").where("false")


def best_first(left: np.ndarray, right: np.ndarray, radius: float, most: int = 32) -> list[tuple[int, int]]:
    """Row numbers i, j of boxes (x0 y0 z0 x1 y1 z1 cx cy cz) of two sides, taken in order if both are free.

    The order is: intersecting ones by falling IoU, then others within the radius; then by distance, i, j. Each row of
    the left keeps its next `most` pairs, and gets as many again, of what is free, when these are taken. The left row
    whose next pair comes first is served first, so pairs are never all held.
    """
    columns, free = np.ascontiguousarray(right.T), np.ones(len(right), bool)
    volume = (columns[3] - columns[0]) * (columns[4] - columns[1]) * (columns[5] - columns[2])

    def following(rows: np.ndarray, at: np.ndarray) -> list[list[tuple]]:
        """The next pairs of some left rows among the right rows `at`, last one first."""
        a, b = left[rows].T[:, :, None], columns[:, at]
        x, y, z = (np.maximum(0.0, np.minimum(a[k + 3], b[k + 3]) - np.maximum(a[k], b[k])) for k in range(3))
        shared = x * y * z
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = shared / ((a[3] - a[0]) * (a[4] - a[1]) * (a[5] - a[2]) + volume[at] - shared)
        dx, dy, dz = (a[k] - b[k] for k in (6, 7, 8))
        square = dx * dx + dy * dy + dz * dz
        touching = (shared > 0) & (iou > 0)
        rank = np.where(touching, -iou, np.where(square <= radius * radius, np.sqrt(square), np.inf))
        last = np.partition(rank, most - 1, axis=1)[:, most - 1] if rank.shape[1] > most else np.full(len(rows), np.inf)
        out = []
        for k, i in enumerate(rows.tolist()):
            own = np.flatnonzero((rank[k] <= last[k]) & (rank[k] < np.inf))
            gap = np.sqrt(square[k, own])
            own, gap = (v[np.lexsort((at[own], gap, rank[k, own]))[::-1]] for v in (own, gap))
            out.append(list(zip(rank[k, own].tolist(), gap.tolist(), [i] * len(own), at[own].tolist())))
        return out

    everything, step = np.arange(len(right)), max(1, AT_ONCE // max(1, len(right)))
    lists = [x for at in range(0, len(left), step) for x in following(np.arange(at, min(at + step, len(left))), everything)]
    heap = [x.pop() for x in lists if x]
    heapq.heapify(heap)
    taken, held, here = [], 0, everything
    while heap:
        _, _, i, j = heap[0]
        if free[j]:
            heapq.heappop(heap)
            free[j] = False
            taken.append((i, j))
            lists[i] = []
            continue
        while lists[i] and not free[lists[i][-1][3]]:
            lists[i].pop()
        if not lists[i]:
            if len(taken) > held:
                here, held = here[free[here]], len(taken)
            lists[i] = following(np.array([i]), here)[0] if len(here) else []
        if lists[i]:
            heapq.heapreplace(heap, lists[i].pop())
        else:
            heapq.heappop(heap)
    return taken


def assigned(left: DataFrame, right: DataFrame, radius: float = 1.0) -> DataFrame:
    """room, i, j: greedy_assignment of candidate_pairs by tier, falling IoU and distance, without making all pairs.

    A room's boxes are in one task, as numbers; the time grows with the product of its sides, the memory with their sum.
    """
    names = [f"{a}{i}" for i in (0, 1) for a in "xyz"] + ["cx", "cy", "cz"]
    sides = [side.select(F.col("room").alias(f"_{n}"), "object_id", *names).dropna().repartition(ROOM_TASKS, f"_{n}").groupBy(f"_{n}") for n, side in enumerate((left, right))]

    def room(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [t.take(pc.sort_indices(t, [("object_id", "ascending")])) for t in (left, right)]
        boxes = [np.stack([t[n].to_numpy().astype(float) for n in names], 1) for t in sides]
        pairs = best_first(*boxes, radius) if min(map(len, sides)) else []
        i, j = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        room = pa.array(sides[0]["_0"].to_pylist()[:1] * len(pairs), sides[0].schema.field("_0").type)
        return pa.table({"room": room, "i": sides[0]["object_id"].take(i), "j": sides[1]["object_id"].take(j)})

    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, df, c in (("room", left, "room"), ("i", left, "object_id"), ("j", right, "object_id")))
    return sides[0].cogroup(sides[1]).applyInArrow(room, kinds)
