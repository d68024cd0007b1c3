"""Column functions on points, boxes and rotations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


def col(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}" if side else name)


def squared_distance(a: str, b: str, names: tuple[str, ...] = ("cx", "cy", "cz")) -> Column:
    """Between the points of two aliased sides."""
    return reduce(lambda p, q: p + q, ((col(a, n) - col(b, n)) * (col(a, n) - col(b, n)) for n in names))


def distance(a: str, b: str) -> Column:
    return F.sqrt(squared_distance(a, b))


def overlap(a: str, b: str, axis: str) -> Column:
    """Length shared by two boxes on an axis, not below 0."""
    return F.greatest(F.lit(0.0), F.least(col(a, f"{axis}1"), col(b, f"{axis}1")) - F.greatest(col(a, f"{axis}0"), col(b, f"{axis}0")))


def side(a: str, axis: str) -> Column:
    return col(a, f"{axis}1") - col(a, f"{axis}0")


def volume(a: str) -> Column:
    return side(a, "x") * side(a, "y") * side(a, "z")


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two axis-aligned boxes; 0 where they do not intersect."""
    shared = overlap(a, b, "x") * overlap(a, b, "y") * overlap(a, b, "z")
    return F.when(shared > 0, shared / (volume(a) + volume(b) - shared)).otherwise(F.lit(0.0))


def footprint_overlap(a: str, b: str) -> Column:
    """Share of a's footprint in the xy plane that lies over b's."""
    return overlap(a, b, "x") * overlap(a, b, "y") / (side(a, "x") * side(a, "y"))


def sorted_sides(a: str) -> Column:
    return F.array_sort(F.array(*(side(a, x) for x in AXES)))


def fits_in(a: str, b: str) -> Column:
    """Each of a's sides, by size, is strictly smaller than b's."""
    p, q = sorted_sides(a), sorted_sides(b)
    return (p[0] < q[0]) & (p[1] < q[1]) & (p[2] < q[2])


def longest_side(a: str) -> Column:
    return F.greatest(*(side(a, x) for x in AXES))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in double precision and array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def elevation(target: str, ex: Column, ey: Column, ez: Column) -> Column:
    """Angle at which a target's centroid appears from an eye point."""
    dx, dy = col(target, "cx") - ex, col(target, "cy") - ey
    return F.atan2(col(target, "cz") - ez, F.sqrt(dx * dx + dy * dy))


def applied(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A row-major 4x4 transform on a point."""
    return [matrix[4 * r] * x + matrix[4 * r + 1] * y + matrix[4 * r + 2] * z + matrix[4 * r + 3] for r in range(3)]


def is_rigid(matrix: Column, tolerance: float = 1e-4) -> Column:
    """Sixteen finite numbers, last row 0 0 0 1, orthonormal rotation of determinant 1."""
    m = lambda r, c: matrix[4 * r + c]
    finite = F.forall(matrix, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    last = (m(3, 0) == 0) & (m(3, 1) == 0) & (m(3, 2) == 0) & (m(3, 3) == 1)
    dots = [(sum(m(k, i) * m(k, j) for k in range(3)), float(i == j)) for i in range(3) for j in range(i, 3)]
    square = reduce(lambda p, q: p & q, (F.abs(d - v) <= tolerance for d, v in dots))
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    return F.coalesce((F.size(matrix) == 16) & finite & last & square & (F.abs(det - 1) <= tolerance), F.lit(False))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def inverted(matrix: Column) -> Column:
    """The inverse of a rigid transform: the rotation's transpose, and the shift turned back."""

    def body(m: Column) -> Column:
        rows = [[m[r], m[4 + r], m[8 + r], -(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11])] for r in range(3)]
        return F.array(*(v for row in rows for v in row), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))

    return once(matrix, body)


def composed(first: Column, then: Column) -> Column:
    """The 4x4 transform that does `first`, and `then` after it."""
    entry = lambda m, r, c: reduce(lambda p, q: p + q, (m["then"][4 * r + k] * m["first"][4 * k + c] for k in range(4)))
    return once(F.struct(first.alias("first"), then.alias("then")), lambda m: F.array(*(entry(m, r, c) for r in range(4) for c in range(4))))


def is_leveling(matrix: Column) -> Column:
    """A rigid transform that rotates and lifts, without a horizontal shift."""
    return is_rigid(matrix) & F.coalesce((F.abs(matrix[3]) <= 1e-6) & (F.abs(matrix[7]) <= 1e-6), F.lit(False))


def is_resize(matrix: Column, tolerance: float = 1e-6) -> Column:
    """A row-major 3x3 mapping of pixels that only scales: finite, with a positive diagonal that ends in 1, else zeros."""
    finite = F.forall(matrix, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rest = reduce(lambda p, q: p & q, (F.abs(matrix[i] - float(i == 8)) <= tolerance for i in (1, 2, 3, 5, 6, 7, 8)))
    return F.coalesce((F.size(matrix) == 9) & finite & rest & (matrix[0] > 0) & (matrix[4] > 0), F.lit(False))


def slerp(q0: list[Column], q1: list[Column], t: Column) -> list[Column]:
    """Unit quaternions (x, y, z, w) interpolated along the shorter arc."""
    dot = reduce(lambda p, q: p + q, (a * b for a, b in zip(q0, q1)))
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    close = F.sin(angle) < 1e-9
    w0 = F.when(close, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    w1 = F.when(close, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    mix = [a * w0 + b * w1 for a, b in zip(q0, q1)]
    norm = F.sqrt(reduce(lambda p, q: p + q, (v * v for v in mix)))
    return [v / norm for v in mix]


def unprojected(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Camera coordinates of a pixel at a depth along the optical axis."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]
