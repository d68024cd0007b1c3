"""Leveling of a reconstructed scene: up direction from planes, floor height, heading from walls.

One grouped function per scene, on a cloud that voxel reduction has bounded; planes are found by random samples with
a fixed seed, so results agree with other implementations within a tolerance, not bit for bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SEED, ROUNDS, SAMPLES = 7, 12, 700
PLANE_GAP, LEAST_CLOUD, LEAST_INLIERS, CELL = 0.025, 300, 150, 0.04
LEAST_AREA, MOST_TILT, CAMERA_HEIGHT, MEDIAN_HEIGHT, MOST_BELOW = 1.0, 45.0, 0.5, 2.8, 0.08
WALL_GAP, WALL_ROUNDS, WALL_INLIERS, WALL_EXTENT, WALL_ANGLE = 0.03, 24, 300, 0.8, 30.0
HEADING_AGREEMENT, FLOOR_STEP = 0.35, 0.05


def plane_of(points: np.ndarray, gap: float, samples: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Normal and inliers of the plane with the most points within the gap; the normal is that of the inliers."""
    if len(points) < 3:
        return None
    picks = points[random.integers(0, len(points), (samples, 3))]
    normals = np.cross(picks[:, 1] - picks[:, 0], picks[:, 2] - picks[:, 0])
    size = np.linalg.norm(normals, axis=1)
    normals, origins = normals[size > 1e-9] / size[size > 1e-9, None], picks[size > 1e-9, 0]
    if not len(normals):
        return None
    best, most = None, 0
    for a in range(0, len(normals), 64):
        off = np.abs(points @ normals[a : a + 64].T - (origins[a : a + 64] * normals[a : a + 64]).sum(axis=1)) <= gap
        k = int(off.sum(axis=0).argmax())
        if off[:, k].sum() > most:
            most, best = int(off[:, k].sum()), off[:, k]
    inner = points[best]
    _, _, axes = np.linalg.svd(inner - inner.mean(axis=0), full_matrices=False)
    return axes[2], best


def turned_up(normal: np.ndarray) -> np.ndarray:
    """The shortest rotation that takes a unit vector to +z."""
    axis, c = np.cross(normal, [0.0, 0.0, 1.0]), float(normal[2])
    if c < -1 + 1e-9:
        return np.diag([1.0, -1.0, -1.0])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def extents(points: np.ndarray) -> np.ndarray:
    """The middle 90 percent of a plane's points along its two main axes."""
    centred = points - points.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    return np.ptp(np.percentile(centred @ axes[:2].T, [5, 95], axis=0), axis=0)


def quarter_heading(angles: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The mean of headings that repeat every quarter turn, and how well they agree (0 to 1)."""
    s, c = float((weights * np.sin(4 * angles)).sum()), float((weights * np.cos(4 * angles)).sum())
    return np.arctan2(s, c) / 4, float(np.hypot(s, c) / max(weights.sum(), 1e-12))


def level(points: np.ndarray, cameras: np.ndarray, camera_ups: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, str]:
    """A 4x4 transform that levels the scene, and what gave its up direction: floor, walls or surface."""
    hint = camera_ups.mean(axis=0)
    if np.linalg.norm(hint) < 0.1:
        raise ValueError("cameras do not agree on up")
    hint /= np.linalg.norm(hint)
    if len(points) < LEAST_CLOUD:
        raise ValueError("too few points")
    _, first = np.unique(np.floor(points / CELL).astype(np.int64), axis=0, return_index=True)
    cloud = points[np.sort(first)]
    random = np.random.default_rng(seed)
    rest, floors, surfaces = cloud, [], []
    for _ in range(ROUNDS):
        if len(rest) < LEAST_CLOUD:
            break
        found = plane_of(rest, PLANE_GAP, SAMPLES, random)
        if found is None or found[1].sum() < LEAST_INLIERS:
            break
        normal, inside = found
        normal = normal if normal @ hint >= 0 else -normal
        own, rest = rest[inside], rest[~inside]
        height = (cameras - own.mean(axis=0)) @ normal
        if np.prod(extents(own)) < LEAST_AREA or normal @ hint < np.cos(np.radians(MOST_TILT)) or (height > CAMERA_HEIGHT).mean() < 0.9 or np.median(height) >= MEDIAN_HEIGHT:
            continue
        below = ((cloud - own.mean(axis=0)) @ normal < -2 * PLANE_GAP).mean()
        (floors if below < MOST_BELOW else surfaces).append((int(inside.sum()), normal))
    walls = wall_planes(cloud, random)
    if floors:
        up, source = max(floors, key=lambda x: x[0])[1], "floor"
    else:
        options = [(up, "walls")] if (up := up_from_walls(walls, hint)) is not None else []
        if surfaces:
            options.append((max(surfaces, key=lambda x: x[0])[1], "surface"))
        if not options:
            raise ValueError("nothing tells which way is up")
        up, source = max(options, key=lambda x: x[0] @ hint)
    rotation = turned_up(up)
    headings = [(np.arctan2(n[1], n[0]), w) for w, n in ((w, rotation @ n) for w, n in walls) if abs(n[2]) < np.sin(np.radians(15.0))]
    if len(headings) >= 2:
        mean, agreement = quarter_heading(*(np.array(x) for x in zip(*headings)))
        if agreement >= HEADING_AGREEMENT:
            c, s = np.cos(-mean), np.sin(-mean)
            rotation = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ rotation
    out = np.eye(4)
    out[:3, :3] = rotation
    out[2, 3] = -np.round(np.percentile((points @ rotation.T)[:, 2], 1) / FLOOR_STEP) * FLOOR_STEP
    return out, source


def wall_planes(cloud: np.ndarray, random: np.random.Generator) -> list[tuple[float, np.ndarray]]:
    """(area, normal) of large planes of any direction."""
    rest, out = cloud, []
    for _ in range(WALL_ROUNDS):
        found = plane_of(rest, WALL_GAP, SAMPLES, random) if len(rest) >= LEAST_CLOUD else None
        if found is None or found[1].sum() < WALL_INLIERS:
            break
        own, rest = rest[found[1]], rest[~found[1]]
        if (size := extents(own)).min() >= WALL_EXTENT:
            out.append((float(np.prod(size)), found[0]))
    return out


def up_from_walls(walls: list[tuple[float, np.ndarray]], hint: np.ndarray) -> np.ndarray | None:
    """The direction most nearly in all upright planes, in two passes; None without two walls at an angle."""
    up = hint
    for degrees in (45.0, 15.0):
        upright = [(w, n) for w, n in walls if abs(n @ up) < np.sin(np.radians(degrees))]
        if not any(abs(a[1] @ b[1]) <= np.cos(np.radians(WALL_ANGLE)) for a in upright for b in upright):
            return None
        _, _, axes = np.linalg.svd(np.array([np.sqrt(w) * n for w, n in upright]), full_matrices=True)
        up = axes[2] if axes[2] @ hint >= 0 else -axes[2]
    return up


def leveled(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """scene, transform (16), source; source holds the reason where a scene cannot be leveled.

    points: scene, x, y, z, reduced to voxels of 4 cm beforehand. cameras: scene, x, y, z, ux, uy, uz (up).
    """

    def scene(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        try:
            matrix, source = level(p[["x", "y", "z"]].to_numpy(), c[["x", "y", "z"]].to_numpy(), c[["ux", "uy", "uz"]].to_numpy())
        except ValueError as e:
            matrix, source = None, str(e)
        key = p["scene"].iloc[0] if len(p) else c["scene"].iloc[0]
        return pd.DataFrame([(key, None if matrix is None else matrix.ravel().tolist(), source)], columns=["scene", "transform", "source"])

    kind = points.schema["scene"].dataType.simpleString()
    return points.groupBy("scene").cogroup(cameras.groupBy("scene")).applyInPandas(scene, f"scene {kind}, transform array<double>, source string")


def headings(angles: DataFrame, key: str = "object_id") -> DataFrame:
    """key, heading, agreement: quarter_heading of each key's (angle, weight) rows, as sums."""
    turned = lambda f: F.sum(F.col("weight") * f(4 * F.col("angle")))
    sums = angles.groupBy(key).agg(turned(F.sin).alias("s"), turned(F.cos).alias("c"), F.sum("weight").alias("w"))
    return sums.select(key, (F.atan2("s", "c") / 4).alias("heading"), (F.hypot("s", "c") / F.greatest(F.col("w"), F.lit(1e-12))).alias("agreement"))


def floor_steps(points: DataFrame, key: str = "object_id") -> DataFrame:
    """key, steps: the floor's height, the lowest percentile of z, in whole FLOOR_STEPs."""
    return points.groupBy(key).agg(F.bround(F.percentile("z", F.lit(0.01)) / FLOOR_STEP).cast("long").alias("steps"))
