"""Operators whose work or memory grew faster than their input: the same rows as by force, and plans that deal the work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import align, evidence, links, objects, scoring, spatial
from marlstone.plans import catalog, files
from marlstone.sources import readers


def masks(random, frames):
    """(frame_id, row, col, depth) of random masks."""
    return [(f, r, c, float(random.choice([1.0, 1.2, 3.0]) + r / 100)) for f in range(frames) for r in range(8) for c in range(7 + f % 3) if random.random() < 0.93]


def core_by_force(cells, radius):
    mask = {(f, r, c) for f, r, c, _ in cells}
    around = range(-radius, radius + 1)
    out = set()
    for f in {x[0] for x in cells}:
        own = [x for x in cells if x[0] == f]
        inner = [d for _, r, c, d in own if all((f, r + i, c + j) in mask for i in around for j in around)]
        low, high = np.percentile(inner if len(inner) >= 20 else [d for *_, d in own], [5, 95])
        out |= {(f, r, c) for _, r, c, d in own if low - 0.1 <= d <= high + 0.1}
    return out


def test_masks_are_dealt_before_they_grow(spark, sf):
    assert catalog.mask_cells(spark, sf).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("radius", [1, 2])
def test_depth_core_by_force(spark, monkeypatch, radius):
    cells = masks(np.random.default_rng(radius), 9)
    rows = spark.createDataFrame(cells, "frame_id long, row int, col int, depth double")
    monkeypatch.setattr(evidence, "FRAME_CELLS", 100)
    monkeypatch.setattr(evidence, "MASK_BYTES", 200)
    for given, together in ((rows.repartition(5), False), (rows.coalesce(1), True)):
        assert {(r.frame_id, r.row, r.col) for r in evidence.depth_core(given, radius, together=together).collect()} == core_by_force(cells, radius)
    assert "Generate" not in evidence.depth_core(rows, radius)._jdf.queryExecution().executedPlan().toString()


def test_merging_looks_at_few_pairs(spark, monkeypatch):
    """Fragments at one place, four a frame: few groups, each of which meets each fragment once."""
    random = np.random.default_rng(3)
    n = 200
    points = [(random.uniform(-0.05, 0.05, (30, 3)) + random.normal(0, 0.1, 3)).ravel() for _ in range(n)]
    table = pa.table({"object_id": range(n), "label": ["cup"] * n, "points": pa.array(points, pa.list_(pa.float64())), "frames": [[i // 4] for i in range(n)], "hints": [[str(i % 2)] for i in range(n)], "look": pa.nulls(n, pa.list_(pa.float64()))})
    looked, plain = [], objects.near_enough
    monkeypatch.setattr(objects, "near_enough", lambda *a: looked.append(1) or plain(*a))
    root = objects.united(table, 0.2, 0.5, 0.5)
    groups = {i: {i} for i in range(n)}
    for i in range(n):
        for j in range(i + 1, n):
            small = [x.reshape(-1, 3) for x in (points[i], points[j])]
            if i % 2 == j % 2 and groups[i] is not groups[j] and not {k // 4 for k in groups[i]} & {k // 4 for k in groups[j]} and objects.near_fraction(*small, 0.2) >= 0.5:
                both = groups[i] | groups[j]
                groups |= dict.fromkeys(both, both)
    assert root.tolist() == [min(groups[i]) for i in range(n)]
    assert len(looked) < n * 10 < n * (n - 1) / 4


def test_association_streams_frames(spark, monkeypatch):
    """A scene of many frames comes in several batches, and none of them is a whole scene; scenes of one task do not mix."""
    cube = [[0.06 * i, 0.06 * j, 0.06 * k] for i in range(8) for j in range(8) for k in range(8)]
    rows = [(s, i // 2, i, "cup", None, [[x + 5.0 * (i % 2), y, z] for x, y, z in cube]) for s in range(3) for i in range(24)]
    lifted = spark.createDataFrame(rows, "scene long, position long, observation_id long, label string, hint string, points array<array<double>>")
    monkeypatch.setattr(objects, "SCENE_TASKS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = objects.associate(lifted)
        got = {(r.scene, r.observation_id): (r.decision, r.object) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(s, i): ("match" if i > 1 else "new", i % 2) for s in range(3) for i in range(24)}
    assert "FlatMapGroupsIn" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 5, 12])
def test_nearest_rows_by_force(monkeypatch, most):
    """Crowds within crowds, repeated places, far points; blocks of few pairs."""
    random = np.random.default_rng(most)
    monkeypatch.setattr(spatial, "PAIRS", 500)
    others = np.concatenate([random.normal(0, 1, (150, 3)), random.normal(3, 1e-3, (150, 3)), np.repeat(random.normal(0, 1, (3, 3)), 4, 0), [[900.0, 0, 0]]])
    points, ids = np.concatenate([others, random.normal(0, 300, (20, 3))]), random.permutation(len(others))
    own = np.concatenate([ids, -1 - np.arange(20)])
    got = [[] for _ in points]
    for i, j in zip(*spatial.nearest_rows(points, others, own, ids, most)):
        got[i].append(int(ids[j]))
    for i, p in enumerate(points):
        gaps = sorted((((p - q) ** 2).sum(), k) for q, k in zip(others, ids.tolist()) if k != own[i])
        assert got[i] == [k for _, k in gaps[:most]]
    assert len(spatial.nearest_rows(points, others[:0], own, ids[:0], most)[0]) == 0


def test_nearest_join_makes_only_its_pairs(spark, monkeypatch):
    """A crowded key is searched in blocks, and no other pair leaves them."""
    monkeypatch.setattr(spatial, "BLOCK", 16)
    random = np.random.default_rng(2)
    rows = spark.createDataFrame([(i % 2, i, *map(float, random.normal(0, 0.1, 3))) for i in range(300)], "room int, object_id long, cx double, cy double, cz double")
    pairs = spatial.nearest_join(rows, rows, ["room"], 3, "object_id")
    assert pairs.count() == 900 and pairs.select("a.object_id").distinct().count() == 300


def test_positions_meet_no_pairs_of_a_room(spark):
    things = spark.createDataFrame([(0, i, "cup" if i % 2 else "Lamp", i * 0.01, 0.0, 0.0) for i in range(40)], "room int, object_id long, label string, cx double, cy double, cz double")
    said = spark.createDataFrame([(1, 1, "day 1 | lamp | [0.10, 0, 0]"), (2, 1, "day 1 | lamp | [0.11, 0, 0]"), (3, 1, "day 1 | stool | [0.07, 0, 0]"), (4, 1, "day 1 | cup | [9, 0, 0]"), (5, 1, "day 2 | cup | [0, 0, 0]")], "query_id long, episode int, pred string")
    sessions = spark.createDataFrame([(1, 1, 0)], "episode int, day long, room int")
    found = scoring.resolved_positions(said, sessions, things)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 10), (2, 0, 10), (3, 0, 7)]
    assert "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString()


def test_assignment_without_all_pairs(spark, monkeypatch):
    """The same pairs as in rounds over all candidates; equal boxes, lists that run out, a side that is longer."""
    monkeypatch.setattr(align, "AT_ONCE", 50)
    random = np.random.default_rng(4)

    def side(n):
        rows = [(int(random.integers(2)), i, *map(float, random.integers(0, 8, 3) / 8), *map(float, random.integers(1, 5, 3) / 8)) for i in range(n)]
        df = spark.createDataFrame(rows, "room long, object_id long, cx double, cy double, cz double, hx double, hy double, hz double")
        return df.select("room", "object_id", "cx", "cy", "cz", *((F.col(f"c{a}") - F.col(f"h{a}")).alias(f"{a}0") for a in "xyz"), *((F.col(f"c{a}") + F.col(f"h{a}")).alias(f"{a}1") for a in "xyz"))

    left, right = side(40).cache(), side(55).cache()
    rounds = align.greedy_assignment(align.candidate_pairs(left, right, 0.6).withColumn("closer", -F.col("iou")), ["tier", "closer", "distance"])
    expected = sorted((r.room, r.i, r.j) for r in rounds.collect())
    for most in (1, 3, 32):
        monkeypatch.setattr(align.best_first, "__defaults__", (most,))
        found = align.assigned(left, right, 0.6)
        assert sorted((r.room, r.i, r.j) for r in found.collect()) == expected
    assert len(expected) > 30


def test_turns_are_searched_once(spark, monkeypatch):
    turns = spark.createDataFrame([(1, k, k % 2, said) for k, said in enumerate(["a Cup here", "two boxes", "the table.", "cupboard", "C++ and cups", None, "a box"])], "episode long, turn long, room int, text string")
    things = spark.createDataFrame([(0, "cup"), (0, "table"), (0, None), (0, "C++"), (1, "box"), (1, "lamp"), (1, "boxe")], "room int, label string")
    pairs = turns.join(things.distinct(), "room").where(text.names_class(F.col("text"), F.col("label"))).select("episode", "turn").distinct()
    expected = sorted(map(tuple, pairs.collect()))
    monkeypatch.setattr(links, "names_class", None)  # no pair of turn and class is searched
    assert sorted(map(tuple, links.mentioned(turns, things).collect())) == expected and len(expected) >= 4


def test_look_alikes_by_force(spark, monkeypatch):
    """Products that rounding alone puts on either side of the threshold are summed in order."""
    random = np.random.default_rng(6)
    vectors = [[float(x) for x in random.choice([0.1, 0.2, 0.3, -0.1], 7)] for _ in range(90)] + [[1.0], [0.5], None]
    rows = [(i % 2, i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "room int, vec_id long, embedding array<double>")
    plain = spatial.block_pairs
    monkeypatch.setattr(spatial, "block_pairs", lambda *a: plain(*a, size=20))

    def product(p, q):
        total = 0.0
        for x, y in zip(p, q):
            total += x * y
        return total

    by_force = {(i, j) for k, i, p in rows for h, j, q in rows if k == h and i < j and p and q and len(p) == len(q) and product(p, q) >= 0.12}
    assert {(r.a_object, r.b_object) for r in evidence.look_alikes(df, 0.12).collect()} == by_force and by_force


def test_smaller_counts_by_force(spark, monkeypatch):
    plain = spatial.block_pairs
    monkeypatch.setattr(spatial, "block_pairs", lambda *a: plain(*a, size=10))
    random = np.random.default_rng(7)
    rows = spark.createDataFrame([(i % 2, i, 0.0, 0.0, 0.0, *map(float, random.integers(1, 9, 3))) for i in range(70)], "room int, object_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    counts = spatial.smaller_counts(rows, rows)
    expected = spatial.smaller_than(rows, rows).groupBy("reference_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, expected.collect()))
    assert "FlatMapCoGroups" in counts._jdf.queryExecution().executedPlan().toString()


def test_apart_pairs_by_force(spark):
    objects_ = spark.createDataFrame([(i % 2, i) for i in range(30)], "room int, object_id long")
    seen = spark.createDataFrame([(i % 2, i, f) for i in range(30) for f in range(5) if i * 7 % 5 == f], "room int, object_id long, frame int")
    found = evidence.apart_pairs(objects_, seen, size=4)
    pairs = spatial.same_room(objects_, objects_, F.col("a.object_id") < F.col("b.object_id")).select(F.col("a.object_id").alias("a_object"), F.col("b.object_id").alias("b_object"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, evidence.never_together(pairs, seen).collect()))
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()


def test_coverage_by_force(spark):
    """Cells in any order and of many frames in a batch; coarser and finer grids than the mask's."""
    random = np.random.default_rng(8)
    cells = [(f, r, c) for f in range(30) for r in range(6) for c in range(5) if random.random() < 0.7]
    df = spark.createDataFrame([cells[i] for i in random.permutation(len(cells))], "frame_id long, row int, col int")
    for rows, cols in ((2, 3), (4, 4), (9, 7)):
        share = lambda x, n, i, m: max(0.0, min((i + 1) * n / m, x + 1) - max(i * n / m, x)) / (n / m)
        full = {(f, i, j): sum(share(r, 6, i, rows) * share(c, 5, j, cols) for g, r, c in cells if g == f) for f in range(30) for i in range(rows) for j in range(cols)}
        found = evidence.coverage(df, 6, 5, rows, cols, 0.3001)
        got = {(r.frame_id, r.row, r.col): r.share for r in found.collect()}
        assert got == pytest.approx({k: v for k, v in full.items() if v >= 0.3001})
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_do_not_grow_with_rows(spark, tmp_path):
    whole = spark.range(40).select(F.lit(1).alias("schema_version"), F.format_string("s%d", "id").alias("sequence_id"), F.array(F.struct(F.lit('a"]').alias("frame_id"), F.lit(3).alias("source_frame_index"), F.lit(0.5).alias("timestamp_seconds"))).alias("frames"))
    path = files.as_lists(whole)
    assert readers.read_manifest(spark, path).select("sequence_id", "frame_id").distinct().count() == 40
    assert spark.read.format("binaryFile").load(path).count() <= whole.rdd.getNumPartitions()
    rows = spark.range(120).select(F.lit("x").alias("shard"), F.lit("t").alias("task"), F.format_string("e%d", F.col("id") % 60).alias("episode"), F.col("id").cast("string").alias("turn"), F.lit("s").alias("scene"), F.col("id").alias("object"), F.lit("p").alias("phrase"), F.lit(True).alias("fact_bearing"), F.lit("log").alias("source"))
    readers.write_links(rows, f"{tmp_path}/links")
    assert sorted(map(tuple, readers.read_links(spark, f"{tmp_path}/links").select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "links").rglob("*.json"))) <= 4


def test_near_pairs_are_dealt(spark):
    rows = spark.createDataFrame([(0, i, i * 0.01, 0.0, 0.0) for i in range(200)], "room int, object_id long, cx double, cy double, cz double")
    pairs = spatial.near_pairs(rows, 1.5)
    assert {(r.a_id, r.b_id) for r in pairs.collect()} == {(i, j) for i in range(200) for j in range(200) if i != j and (i * 0.01 - j * 0.01) ** 2 <= 2.25}
    assert pairs.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).filter(bool).count() > 4
