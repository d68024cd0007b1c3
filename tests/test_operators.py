"""Operators on small tables with known results."""

import json
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstone.functions import geometry, text
from marlstone.operators import align, evidence, leveling, links, objects, scoring, spatial, temporal
from marlstone.sources import readers
from marlstone.streaming import frames as streams


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def frames_at(spark, times):
    return spark.createDataFrame([("s", i, float(t)) for i, t in enumerate(times)], "sequence_id string, frame_id long, timestamp_seconds double")


@pytest.mark.parametrize("times, kept", [([i / 30 for i in range(31)], [0, 6, 12, 18, 24, 30]), ([10, 10.11, 10.19, 10.24, 10.39, 10.44, 11.2], [0, 3, 5, 6])])
def test_sampling(spark, times, kept):
    assert [r.frame_id for r in temporal.sample_frames(frames_at(spark, times)).orderBy("frame_id").collect()] == kept


def quaternion(degrees):
    return 0.0, 0.0, math.sin(math.radians(degrees) / 2), math.cos(math.radians(degrees) / 2)


def poses(spark, rows):
    schema = "sequence_id string, frame_id long, t double, x double, y double, z double, qx double, qy double, qz double, qw double"
    return spark.createDataFrame([("s", i, t, *((x, 0.0, 0.0, *quaternion(a)) if x is not None else (None,) * 7)) for i, (t, x, a) in enumerate(rows)], schema)


def angle(row):
    return math.degrees(2 * math.atan2(row.qz, row.qw)) % 360


@pytest.mark.parametrize(
    "rows, at, method, x, degrees",
    [
        ([(i / 10, {2: 2.0, 4: 4.0}.get(i), 90 * (i == 4)) for i in range(7)], 3, "interpolated", 3.0, 45),
        ([(0.0, 0.0, 0), (0.1, None, 0), (1.0, 10.0, 90)], 1, "interpolated", 1.0, 9),
        ([(0.0, 0.0, 170), (1.0, None, 0), (2.0, 0.0, -170)], 1, "interpolated", 0.0, 180),
        ([(i / 10, {2: 2.0, 4: 4.0}.get(i), 90 * (i == 4)) for i in range(7)], 0, "held", 2.0, 0),
        ([(i / 10, {2: 2.0, 4: 4.0}.get(i), 90 * (i == 4)) for i in range(7)], 6, "held", 4.0, 90),
    ],
)
def test_pose_lookup(spark, rows, at, method, x, degrees):
    row = temporal.interpolated_pose(poses(spark, rows)).where(F.col("frame_id") == at).first()
    assert row.method == method and row.x == pytest.approx(x) and angle(row) == pytest.approx(degrees, abs=1e-6)


def test_rigid(spark):
    eye = [1.0, 0, 0, 2, 0, 1, 0, 3, 0, 0, 1, 4, 0, 0, 0, 1]
    rows = spark.createDataFrame([(0, [float(v) for v in eye]), (1, [2.0, *map(float, eye[1:])]), (2, [float("nan"), *map(float, eye[1:])])], "i int, m array<double>")
    assert values(rows.select("i", geometry.is_rigid(F.col("m")).alias("ok")), "i") == [(0, True), (1, False), (2, False)]


@pytest.mark.parametrize("votes, label, aliases", [([("printer", 56), ("copier", 10), ("paper", 1), ("shelf", 6)], "printer", ["copier", "shelf"]), ([("bag", 21), ("backpack", 21)], "bag", ["backpack"])])
def test_label_ranking(spark, votes, label, aliases):
    scores = spark.createDataFrame([(1, n, float(s), i) for i, (n, s) in enumerate(votes)], "object_id int, label string, score double, first_seq long")
    row = evidence.ranked_labels(scores).first()
    assert row.label == label and row.aliases == aliases and sum(c.support for c in row.candidates) < 1


def test_observation_scores(spark):
    rows = [(1, "a", "chair", 1.0, True), (1, "a", "stool", 0.5, False), (1, "b", "stool", 1.0, True), (1, "b", "chair", 0.25, False)]
    got = evidence.observation_scores(spark.createDataFrame(rows, "object_id int, observation_id string, label string, score double, is_primary boolean"))
    assert {r.label: r.score for r in got.collect()} == {"chair": 1.25, "stool": 1.5}


def cloud(spark, points):
    return spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)], "object_id int, idx long, x double, y double, z double")


def test_percentiles(spark):
    row = evidence.percentile_boxes(cloud(spark, [(v, 0, 0) for v in (0, 1, 2, 3, 100)]), 0.25, 0.75).first()
    assert (row.x1, row.cx) == (3.0, pytest.approx(21.2))


def test_tighten(spark):
    grid = [(i % 4 * 0.1, i // 4 % 4 * 0.1, i // 16 * 0.1) for i in range(32)]
    assert sorted(r.idx for r in evidence.tightened(cloud(spark, [*grid, (3, 3, 3)])).collect()) == list(range(32))
    assert evidence.tightened(cloud(spark, [*grid[:8], (3, 3, 3)])).count() == 9


def test_depth_core(spark):
    cells = [(0, r, c, 6.0 if (r, c) == (0, 0) else 1.0) for r in range(9) for c in range(9)]
    assert evidence.depth_core(spark.createDataFrame(cells, "frame_id int, row long, col long, depth double")).count() == 80


def test_coverage_keeps_half(spark):
    cells = spark.createDataFrame([(0, 0, c) for c in (0, 2, 5)], "frame_id int, row long, col long")
    assert values(evidence.coverage(cells, 1, 6, 1, 3).select("col", "share"), "col") == [(0, 0.5), (1, 0.5), (2, 0.5)]


def test_thin_objects(spark):
    rows = spark.createDataFrame([(0, 4), (1, 2), (2, 5)], "object_id long, n int")
    assert values(evidence.renumbered(rows, "n").select("object_id", "new_id"), "object_id") == [(0, "object:0000"), (2, "object:0001")]


@pytest.mark.parametrize("stray, left", [([(True, False)] * 2, 9), ([(True, False)], 10), ([(False, False)] * 2, 10)])
def test_carving(spark, stray, left):
    points = cloud(spark, [(i % 3, i // 3, 1) for i in range(9)] + [(9, 9, 9)])
    seen = [(1, i, f, *((True, True) if i < 9 else stray[f])) for i in range(10) for f in range(len(stray))]
    votes = objects.point_votes(spark.createDataFrame(seen, "object_id int, idx long, frame_id int, visible boolean, in_mask boolean"))
    assert objects.carved(points, votes).count() == left


def plain_decisions(table):
    """The rule stated step by step: pairs by falling overlap; a row takes a free column it leads by the margin."""
    n, m = table.shape
    pairs = sorted(((r, c) for r in range(n) for c in range(m) if table[r, c] >= 0.15), key=lambda x: -table[x])
    out, used = ["new"] * n, set()
    done = set()
    for r, c in pairs:
        if r in done or c in used:
            continue
        rival = max([table[r, k] for k in range(m) if k != c], default=0.0)
        done.add(r)
        if table[r, c] - rival >= 0.10:
            out[r] = "match"
            used.add(c)
        else:
            out[r] = "drop"
    return out


def test_frame_decisions(spark):
    generator = np.random.default_rng(3)
    tables = [generator.integers(0, 8, (3, 3)) / 10 for _ in range(300)]
    for t in tables:
        assert [d for d, _ in objects.decisions(t)] == plain_decisions(t)
    rows = [("s", i, r, c, float(t[r, c])) for i, t in enumerate(tables[:60]) for r in range(3) for c in range(3)]
    got = objects.frame_decisions(spark.createDataFrame(rows, "scene string, frame int, row int, col int, overlap double"))
    assert [r.decision for r in got.orderBy("frame", "row").collect()] == [d for t in tables[:60] for d, _ in objects.decisions(t)]


def fragments(spark, rows):
    schema = "scene string, object_id long, label string, points array<array<double>>, frames array<long>, hints array<string>, look array<double>"
    return spark.createDataFrame([("s", i, label, [[float(v) for v in p] for p in points], f, h, look) for i, (label, points, f, h, look) in enumerate(rows)], schema)


BLOB = np.random.default_rng(0).uniform(-0.15, 0.15, (40, 3))


@pytest.mark.parametrize("look, roots", [([0.96, 0.28], [0, 0]), ([0.0, 1.0], [0, 1]), (None, [0, 1])])
def test_merge_needs_confirmation(spark, look, roots):
    rows = [("chair", BLOB, [0], [], [1.0, 0.0]), ("chair", BLOB, [1], [], look)]
    assert [r.root for r in objects.merge_fragments(fragments(spark, rows)).orderBy("object_id").collect()] == roots


def test_merge_veto_through_a_bridge(spark):
    rows = [("chair", BLOB, [0], ["t"], None), ("chair", BLOB, [1], ["t"], None), ("chair", BLOB, [0, 2], ["t"], None)]
    roots = [r.root for r in objects.merge_fragments(fragments(spark, rows)).orderBy("object_id").collect()]
    assert roots[0] == roots[1] and roots[2] != roots[0]


def test_association(spark):
    cube = [[float(x) / 10, float(y) / 10, float(z) / 10] for x in range(8) for y in range(8) for z in range(8)]
    far = [[x + 5, y, z] for x, y, z in cube]
    rows = [("s", 0, "a", "chair", None, cube), ("s", 1, "b", "chair", None, cube), ("s", 1, "c", "chair", None, far), ("s", 2, "d", "chair", None, cube[:50])]
    got = objects.associate(spark.createDataFrame(rows, "scene string, position int, observation_id string, label string, hint string, points array<array<double>>"))
    assert values(got.select("observation_id", "decision", "object"), "observation_id") == [("a", "new", 0), ("b", "match", 0), ("c", "new", 1), ("d", "ignored", None)]


def test_identity_needs_hint(spark):
    rows = spark.createDataFrame([("s", 0, "a", "k", 600), ("s", 1, "b", "k", 300), ("s", 0, "c", "m", 300)], "scene string, position int, observation_id string, hint string, n_points int")
    assert values(objects.identities(rows).select("observation_id"), "observation_id") == [("a",), ("b",)]
    with pytest.raises(Exception, match="no identity"):
        objects.identities(rows.withColumn("hint", F.lit(None).cast("string"))).collect()


def test_greedy_assignment(spark):
    generator = random.Random(5)
    rows = [(room, i, j, generator.randint(0, 5)) for room in range(8) for i in range(6) for j in range(6) if generator.random() < 0.7]
    expected = set()
    used = set()
    for room, i, j, cost in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        if (room, "i", i) not in used and (room, "j", j) not in used:
            used |= {(room, "i", i), (room, "j", j)}
            expected.add((room, i, j))
    got = align.greedy_assignment(spark.createDataFrame(rows, "room int, i int, j int, cost int"), ["cost"])
    assert {tuple(r) for r in got.collect()} == expected


def test_similarity_fit(spark):
    generator = np.random.default_rng(1)
    x = generator.normal(size=(30, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    y = 1.5 * x @ turn.T + [1, 2, 3]
    side = lambda p: spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(p)], "clip string, frame long, x double, y double, z double")
    poses_ = align.shared_poses(side(x), side(y))
    fit = align.similarity_fit(poses_).first()
    assert fit.scale == pytest.approx(1.5) and np.allclose(fit.rotation, turn.ravel()) and np.allclose(fit["shift"], [1, 2, 3])
    assert align.residuals(poses_, align.similarity_fit(poses_)).first().residual < 1e-9
    assert align.similarity_fit(poses_.limit(5)).count() == 0


def test_relations(spark):
    schema = "object_id long, room long, label string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    box = lambda i, label, c, h, room=0: (i, room, label, *map(float, c), *(float(a - b) for a, b in zip(c, h)), *(float(a + b) for a, b in zip(c, h)))
    o = spark.createDataFrame([box(0, "table", (0, 0, 0.5), (1, 1, 0.5)), box(1, "cup", (0.2, 0.2, 1.1), (0.1, 0.1, 0.1)), box(2, "lamp", (0, 0, 2), (0.2, 0.2, 0.2)), box(3, "cup", (0, 0, 1), (0.1, 0.1, 0.1), 1)], schema)
    assert values(spatial.on_surface(o), "object_id") == [(0, 1, 0)]
    assert values(spatial.above(o).select("upper_id", "lower_id"), "upper_id", "lower_id") == [(2, 0)]
    assert values(spatial.near_pairs(o, 1.0).select("a_id", "b_id"), "a_id", "b_id") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert (1, 2) in [tuple(r) for r in spatial.smaller_than(o, o.where("object_id = 2")).select("object_id", "reference_id").collect()]
    moved = spatial.moved(o, o.where("label = 'cup' and room = 0"), o.where("label = 'lamp'")).first()
    assert (moved.mx, moved.my, moved.mz) == pytest.approx((0, 0, 2.3))


def test_link_rules(spark):
    o = spark.createDataFrame([(1, 0, "box"), (2, 0, "book"), (3, 0, "chair"), (4, 0, "chair")], "object_id long, room long, label string")
    t = spark.createDataFrame([(0, 0, "The box beside the book", 0), (0, 1, "Two chairs and the boxes", 0), (0, 2, "person the box", 0)], "episode long, turn long, text string, room long")
    got = {(r.turn, r.object_id): r.fact_bearing for r in links.rule_links(t, o).collect()}
    assert got == {(0, 1): True, (0, 2): False, (2, 1): False}
    assert ("chair",) in [tuple(r) for r in links.uncovered_turns(t, o, links.rule_links(t, o)).select("label").collect()]


def test_gold_links_and_merge(spark):
    schema = "episode long, turn long, object_id long, fact_bearing boolean, source string, phrase string"
    rows = [(0, 1, 1, False, "log", "it"), (0, 1, 1, False, "compiled", "that"), (0, 2, 5, True, "evidence", ""), (1, 0, 7, True, "evidence", "")]
    got = {(r.episode, r.turn): (r.fact_bearing, r.source, r.phrase) for r in links.gold_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 1): (True, "log", "it"), (1, 0): (True, "evidence", "")}


def test_linked_episodes(spark):
    o = spark.createDataFrame([(1, 0, "box"), (2, 0, "book")], "object_id long, room long, label string")
    t = spark.createDataFrame([(0, 0, "the box", 0), (0, 1, "a book", 0)], "episode long, turn long, text string, room long")
    prompts = spark.createDataFrame([(0, "p"), (9, "bad")], "episode long, prompt string")

    def provider(prompt):
        if prompt == "bad":
            raise ValueError
        return [{"turn": 0, "object_id": 1, "phrase": "it"}, {"turn": 0, "object_id": 99}]

    got = {(r.turn, r.object_id): r.source for r in links.linked_episodes(t, o, prompts, provider, provider).collect()}
    assert got == {(0, 1): "llm", (1, 2): "rule"}


def test_scores(spark):
    schema = "answer_type string, pred string, key string, low long, high long, want_ref string"
    rows = [("count", "2", None, 2, 3, None), ("count", "3.9", None, 2, 3, None), ("count", "true", None, 1, 1, None), ("bool", None, "false", None, None, None), ("bool", "Yes", "true", None, None, None), ("track", "Scene 0474_03 # 19", None, None, None, "0474_03#19")]
    df = spark.createDataFrame(rows, schema)
    assert [r.correct for r in scoring.scored(df).collect()] == [True] * 6
    assert [r.correct for r in scoring.scored(df, strict=True).collect()] == [True, True, False, False, True, True]


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i % 3 == 0, i % 2 == 0) for i in range(600)], "a boolean, b boolean")
    got = scoring.paired_bootstrap(rows).first()
    d = np.array([int(i % 2 == 0) - int(i % 3 == 0) for i in range(600)])
    means = 100 * np.random.default_rng(3).choice(d, (4000, 600)).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert got.points == pytest.approx(100 * d.mean()) and got.low == pytest.approx(low, abs=1) and got.high == pytest.approx(high, abs=1) and got.n == 600


@pytest.mark.parametrize("reply, answer", [('{"answer": 3}', 3), ('so {"x": {"y": 1}} then {"answer": true}', True), ('{"answer": "a b", broken', "a b"), ("no", None), (None, None), ('{"answer": 1} and {"x": 2}', None), ('{"answer": 1} and {broken}', 1), ('"answer": 2.7, more', 2), ('[1] "answer": 5', 5), ('{"y": 1}', None), ('"answer": -3 "answer": false', False)])
def test_answer_parsing(reply, answer):
    assert text.parse_answer(reply) == answer


def test_text_functions(spark):
    df = spark.createDataFrame([("See the Box now", "box", 7, "scene 0474_03 # 19", ["a", "b"])], "t string, p string, o int, r string, alt array<string>")
    row = df.select(text.mention_mark(F.col("t"), F.col("p"), F.col("o")).alias("m"), text.object_ref(F.col("r")).alias("r"), text.alternatives_suffix(F.col("alt")).alias("a"), text.family_of(F.lit("multi_clip_cross_slot_semantic_union_x")).alias("f")).first()
    assert tuple(row) == ("See the Box [#7] now", "0474_03#19", " (or: a, b)", "union_x")


def room(tilt, walls=True, seed=0):
    generator = np.random.default_rng(seed)
    u, v = generator.uniform(0, 4, (2, 6000))
    parts = [np.column_stack([u, v, np.zeros_like(u)])]
    if walls:
        parts += [np.column_stack([u, np.zeros_like(u), v * 0.6]), np.column_stack([np.zeros_like(u), u, v * 0.6])]
    cameras = np.column_stack([generator.uniform(1, 3, (10, 2)), np.full(10, 1.5)])
    c, s = math.cos(tilt), math.sin(tilt)
    turn = np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    return np.concatenate(parts) @ turn.T, cameras @ turn.T, np.tile(turn @ [0, 0, 1], (10, 1))


def test_leveling(spark):
    points, cameras, ups = room(0.2)
    p = spark.createDataFrame([("s", *map(float, v)) for v in points], "scene string, x double, y double, z double")
    c = spark.createDataFrame([("s", *map(float, v), *map(float, u)) for v, u in zip(cameras, ups)], "scene string, x double, y double, z double, ux double, uy double, uz double")
    row = leveling.leveled(p, c).first()
    m = np.array(row.transform).reshape(4, 4)
    up = m[:3, :3] @ ups[0]
    assert row.source == "floor" and up[2] > math.cos(math.radians(0.5))
    assert abs(np.percentile((points @ m[:3, :3].T + m[:3, 3])[:, 2], 1)) < 0.06


def test_leveling_needs_evidence():
    points = np.random.default_rng(0).uniform(0, 0.3, (2000, 3))
    with pytest.raises(ValueError):
        leveling.level(points, np.zeros((3, 3)), np.tile([0.0, 0, 1], (3, 1)))


def test_readers(spark, tmp_path):
    ep = tmp_path / "shard_0" / "task" / "mcep_1"
    ep.mkdir(parents=True)
    (ep / "transcript.json").write_text(json.dumps({"turns": [{"global_turn_id": "g0", "global_turn_index": 0, "session_index": 0, "local_frame": 5, "day": 1, "speaker": "user", "text": "hi"}]}))
    t = readers.read_transcripts(spark, str(ep / "transcript.json")).first()
    assert (t.shard, t.task, t.episode, t.text) == ("shard_0", "task", "mcep_1", "hi")
    (tmp_path / "map.json").write_text(json.dumps({"office chair": "chair"}))
    o = spark.createDataFrame([(1, "office chair"), (2, "lamp")], "object_id int, label string")
    mapped = readers.mapped_labels(o, readers.read_label_mapping(spark, str(tmp_path / "map.json")))
    assert values(mapped.select("object_id", "label", "mapped"), "object_id") == [(1, "chair", True), (2, "lamp", False)]
    header = "ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    (tmp_path / "a.ply").write_bytes(header.encode() + struct.pack("<fffBfffB", 1, 2, 3, 9, 4, 5, 6, 9))
    assert values(readers.read_ply(spark, str(tmp_path / "a.ply")).select("idx", "x", "z"), "idx") == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    (tmp_path / "frames").mkdir()
    for i in (0, 1, 3):
        (tmp_path / "frames" / f"{i:06d}.jpg").write_bytes(b"x")
    with pytest.raises(Exception, match="contiguous"):
        readers.read_frame_folder(spark, str(tmp_path / "frames"), "s").collect()
    (tmp_path / "frames" / "000002.jpg").write_bytes(b"x")
    assert readers.read_frame_folder(spark, str(tmp_path / "frames"), "s").count() == 4
    readers.write_once(o, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exists"):
        readers.write_once(o, str(tmp_path / "once"))


def test_cache_faults_and_masks(spark):
    mask = np.arange(12).reshape(3, 4) % 5 == 0
    packed = spark.createDataFrame([("a", "f", 3, 4, bytearray(readers.packed_bits(mask)))], "observation_id string, frame_id string, h int, w int, bits binary")
    assert {(r.row, r.col) for r in readers.read_mask_cells(packed).collect()} == set(zip(*(x.tolist() for x in np.nonzero(mask))))
    schema = "observation_id string, frame_id string, track_hint string, label string, label_candidates array<struct<label: string, score: double>>"
    rows = [("a", "f", "t", "chair", [Row(label="chair", score=0.5)]), ("a", "f", "t", "", [])]
    assert readers.cache_faults(spark.createDataFrame(rows, schema)).count() == 4


def test_packaging(spark):
    clips = spark.createDataFrame([("e", "c1-full", 1, 0, "kitchen"), ("e", "c2", 2, 1, "hall")], "episode_id string, clip_id string, day long, session_index long, room_gloss string")
    made = spark.createDataFrame([("c1-full", 1, "chair")], "clip_id string, object_id int, label string")
    row = readers.packaged(clips, made).first()
    assert row.complete is False and row.pending == ["c2"] and row.clips[0].clip_id == "c1-full"


def test_streaming(spark, sf, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = streams.read_events(spark, sf, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.drained(streams.sampled_by_state(source, 6 * 3600), "by_state", str(tmp_path / "a")).toPandas()
    from marlstone.sources import bridge

    batch = temporal.first_in_bins(bridge.frames(spark, sf), "sequence_id", "micros", 6 * 3600 * 10**6, ["micros", "frame_id"]).select("sequence_id", "frame_id").toPandas()
    assert set(zip(got.user_id, got.event_id)) == set(zip(batch.sequence_id, batch.frame_id))
    assert streams.drained(streams.sampled(source), "by_window", str(tmp_path / "b"), "complete").count() > 0


@pytest.mark.parametrize("n, m", [(30, 40), (900, 800)])
def test_near_fraction(n, m):
    rng = np.random.default_rng(n)
    p, q = rng.uniform(-1, 1, (n, 3)), rng.uniform(-0.5, 1.5, (m, 3))
    assert objects.near_fraction(p, q, 0.1) == pytest.approx(np.mean([min(((x - y) ** 2).sum() for y in q) <= 0.1**2 for x in p]))
    assert objects.near_fraction(p, q + 3, 0.1) == 0


CASES = [
    ("the lamp is beside the box; move the box", "box", True, True), ("my toolbox fell, put it by the box", "box", True, False), ("my toolbox fell", "box", False, False),
    ("Boxes and a BOXS", "box", True, True), ("move the c++ book", "c++ book", True, True), ("by the  c++ books", "c++ book", True, False), ("anything", ".*", False, False),
    ("un été", "t", False, False), ("look near\tthat table", "table", True, False), ("on top of the tv stand or the tv stand", "tv stand", True, True), ("person the cup", "cup", True, False),
]


@pytest.mark.parametrize("said, label, named, subject", CASES)
def test_class_phrases(spark, said, label, named, subject):
    """Against the rule written with Python's own regular expressions."""
    found = list(re.finditer(rf"\b{re.escape(label)}s?\b", said, re.I))
    place = rf"({'|'.join(text.PLACE_WORDS)})\s+({'|'.join(text.ARTICLES)})\s+$"
    assert (bool(found), any(not re.search(place, said[: m.start()], re.I) for m in found)) == (named, subject)
    row = spark.createDataFrame([(said, label)], "t string, l string").select(text.names_class(F.col("t"), F.col("l")).alias("n"), text.is_subject(F.col("t"), F.col("l")).alias("s")).first()
    assert (row.n, row.s) == (named, subject)


def test_near_fraction_by_force():
    rng = np.random.default_rng(6)
    for n, m, radius in ((1, 1, 0.1), (50, 80, 0.1), (200, 150, 0.3), (30, 500, 0.05)):
        a, b = rng.uniform(-0.5, 0.5, (n, 3)), rng.uniform(-0.4, 0.6, (m, 3))
        assert objects.near_fraction(a, b, radius) == ((((a[:, None] - b[None]) ** 2).sum(axis=2) <= radius * radius).any(axis=1)).mean()
    assert objects.near_fraction(np.empty((0, 3)), np.ones((2, 3)), 1.0) == 0.0


def associated(spark, rows, **options):
    kinds = "scene string, position int, observation_id string, label string, hint string, scores map<string,double>, points array<array<double>>"
    got = objects.associate(spark.createDataFrame(rows, kinds), **options).collect()
    return {r.observation_id: (r.decision, r.object) for r in got}


def cube(x0):
    return [[x0 + x / 10, y / 10, z / 10] for x in range(8) for y in range(8) for z in range(8)]


def test_trusted_hints_go_to_the_first_object(spark):
    """h began at object 0; when another observation has taken that object, overlap decides."""
    rows = [("s", 0, "a", "chair", "h", None, cube(0)), ("s", 0, "b", "chair", "k", None, cube(5)), ("s", 1, "c", "chair", "h", None, cube(0)), ("s", 2, "d", "chair", "h", None, cube(9)), ("s", 2, "e", "chair", "h", None, cube(5))]
    got = associated(spark, rows, trusted_hints=True)
    assert got["c"] == ("match", 0) and got["d"] == ("match", 0) and got["e"] == ("match", 1)


def test_labels_are_voted_by_scores(spark):
    """Two observations call the first object a chair and nearly a stool; the second is a stool by shares of two labels."""
    rows = [("s", 0, "a", "chair", None, {"stool": 0.9}, cube(0)), ("s", 1, "b", "chair", None, {"stool": 0.9}, cube(0)), ("s", 2, "c", "stool", None, None, cube(0))]
    got = associated(spark, rows, same_label=True)
    assert got["a"] == ("new", 0) and got["b"] == ("match", 0) and got["c"] == ("new", 1)
    rows = [("s", 0, "a", "chair", None, {"stool": 0.9}, cube(0)), ("s", 1, "b", "chair", None, {"stool": 1.2}, cube(0)), ("s", 2, "c", "stool", None, None, cube(0))]
    assert associated(spark, rows, same_label=True)["c"] == ("match", 0)
    tie = [("s", 0, "a", "chair", None, {"stool": 1.0}, cube(0)), ("s", 1, "b", "chair", None, None, cube(0))]
    assert associated(spark, tie, same_label=True)["b"] == ("match", 0)


def merged_by_force(rows):
    """Pairs in order of ids, with the rule's words: overlap of the smaller, confirmation, the veto of whole groups."""
    group = {i: {i} for i in range(len(rows))}
    points = [np.array(r[1], float) for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            small, large = (i, j) if len(points[i]) <= len(points[j]) else (j, i)
            near = (((points[small][:, None] - points[large][None]) ** 2).sum(axis=2) <= objects.MERGE_RADIUS**2).any(axis=1).mean()
            looks = rows[i][4], rows[j][4]
            agreed = set(rows[i][3]) & set(rows[j][3]) or None not in looks and np.dot(*looks) >= objects.MERGE_COSINE
            large_side = max(np.ptp(points[k], axis=0).max() for k in (i, j)) >= 1.0
            surface = rows[i][0] == rows[j][0] and rows[i][0] in evidence.LARGE_SURFACES and large_side
            frames = [set().union(*(rows[m][2] for m in group[k])) for k in (i, j)]
            if near >= objects.MERGE_OVERLAP and agreed and group[i] is not group[j] and (surface or not frames[0] & frames[1]):
                both = group[i] | group[j]
                group.update({m: both for m in both})
    return [min(group[i]) for i in range(len(rows))]


def test_merging_by_force(spark):
    rng = np.random.default_rng(11)
    for seed in range(3):
        rows = []
        for i in range(14):
            side = 0.6 if i % 5 == 0 else 0.15
            points = rng.uniform(-side, side, (30, 3)) + rng.choice([0.0, 0.1, 0.6], 3) * [1, 1, 0]
            look = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], None][rng.integers(4)]
            rows.append((("table", "chair")[rng.integers(2)], points, rng.choice(12, 2).tolist(), [["t"], ["u"], []][rng.integers(3)], look))
        got = [r.root for r in objects.merge_fragments(fragments(spark, rows)).orderBy("object_id").collect()]
        assert got == merged_by_force(rows) and len(set(got)) < 14


def test_scenes_do_not_mix(spark):
    rows = [("chair", BLOB, [i], ["t"], None) for i in range(2)]
    two = fragments(spark, rows).withColumn("scene", F.concat(F.lit("s"), "object_id"))
    assert {(r.scene, r.object_id, r.root) for r in objects.merge_fragments(two).collect()} == {("s0", 0, 0), ("s1", 1, 1)}


def test_objects_of_one_point_stay(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0)], "object_id long, idx long, x double, y double, z double")
    assert sorted((r.object_id, r.idx) for r in evidence.tightened(rows).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_merge_edges_rules(spark):
    overlaps = spark.createDataFrame([(1, 2, 10, 9), (1, 3, 10, 9), (2, 3, 10, 2), (4, 5, 10, 10), (6, 7, 10, 10)], "a_object long, b_object long, n_points long, n_near long")
    seen = spark.createDataFrame([(0, 1, 0), (0, 3, 0), (0, 4, 1), (0, 5, 1), (0, 6, 2), (0, 7, 2)], "room long, object_id long, frame long")
    looks = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 3, 4, 5)] + [(2, [0.0, 1.0])], "object_id long, vector array<double>")
    pairs = lambda **more: sorted((r.a_object, r.b_object) for r in evidence.merge_edges(overlaps, seen, looks, **more).collect())
    assert pairs() == []
    hints = spark.createDataFrame([(1, "t"), (2, "t"), (6, "u"), (7, "v")], "object_id long, hint string")
    assert pairs(hints=hints) == [(1, 2)]
    sides = spark.createDataFrame([(1, "chair", 2.0), (3, "chair", 2.0), (4, "table", 1.5), (5, "table", 0.2), (6, "table", 2.0), (7, "table", 2.0)], "object_id long, label string, side double")
    assert pairs(hints=hints, sides=sides) == [(1, 2), (4, 5)]  # 6 and 7 are one surface, but nothing confirms them


def test_assignment_of_a_chain(spark):
    """Each pair waits for the one before it: as many rounds as half the pairs."""
    pairs = spark.createDataFrame([(0, i // 2, (i + 1) // 2, float(i)) for i in range(24)], "room long, i long, j long, cost double")
    got = {(r.i, r.j) for r in align.greedy_assignment(pairs, ["cost"]).collect()}
    assert got == {(k, k) for k in range(12)}


def test_candidates_on_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, "l", *(float(v) for v in c), *(float(v) for a in c for v in (a - 0.3, a + 0.3))) for i, c in enumerate(rng.uniform(0, 3, (40, 3)))]
    schema = "object_id long, room long, label string, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"
    one = spark.createDataFrame(rows, schema)
    got = {(r.i, r.j): (r.tier, round(r.distance, 6)) for r in align.candidate_pairs(one, one).collect()}
    expected = {}
    for a in rows:
        for b in rows:
            gap = np.array(a[3:6]) - np.array(b[3:6])
            if a[1] == b[1] and (np.abs(gap).max() < 0.6 or np.linalg.norm(gap) <= 1.0):
                expected[a[0], b[0]] = (int(np.abs(gap).max() >= 0.6), round(float(np.linalg.norm(gap)), 6))
    assert got == expected and (0, 0) in got


def test_session_prompt(spark):
    sessions = spark.createDataFrame([(1, 0, "r", 2, "kitchen"), (1, 1, "q", 3, "hall")], "episode long, session long, room string, day long, gloss string")
    turns = spark.createDataFrame([(1, 0, 1, 100, "user", "see the cup"), (1, 0, 2, 110, "user", "a question?"), (1, 0, 3, 400, "assistant", "ok")], "episode long, session long, turn long, frame long, speaker string, text string")
    queries = spark.createDataFrame([(1, 2)], "episode long, turn long")
    things = spark.createDataFrame([("r", 10, "cup", ["mug"], 0.5, 1.0, 2.0, 0.0, 1.0, 0.0, 2.0, 1.5, 2.5), ("r", 9, "box", [], 0.0, 0.0, 0.0, 0.0, 0.125, 0.0, 1.0, 0.0, 1.0), ("r", 11, "late", [], 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "room string, object_id long, label string, alternatives array<string>, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    seen = spark.createDataFrame([("r", 10, 130), ("r", 9, 40), ("r", 9, 430), ("r", 11, 900)], "room string, object_id long, frame long")
    got = {r.session: r.prompt for r in links.session_prompts(sessions, turns, queries, things, seen, 60).collect()}
    assert got[0].split("\n") == [
        "Room r (day 2, kitchen). Objects:", "  box #9   centroid [0.00, 0.00, 0.00]   size [0.13, 1.00, 1.00]", "  cup (or: mug) #10   centroid [0.50, 1.00, 2.00]   size [1.00, 2.00, 1.00]",
        "", "Turns:", "[1] user (in view: box #9, cup #10): see the cup", "[3] assistant (in view: box #9): ok",
    ]
    assert got[1] == "Room q (day 3, hall). Objects:\n\nTurns:"


def test_axis_alignment(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x = 1\naxisAlignment = " + " ".join(map(str, range(16))) + " \ny = 2\n")
    (tmp_path / "b.txt").write_text("x = 1\n")
    from marlstone.sources import readers

    got = {r.path[-5:]: r.alignment for r in readers.read_axis_alignment(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == list(map(float, range(16))) and got["b.txt"] == np.eye(4).ravel().tolist()


def test_providers_are_asked_once(spark, tmp_path):
    turns = spark.createDataFrame([(1, 1, "r", "the cup"), (1, 2, "r", "the box")], "episode long, turn long, room string, text string")
    things = spark.createDataFrame([("r", 10, "cup"), ("r", 11, "box")], "room string, object_id long, label string")
    log = str(tmp_path / "asked")

    def provider(prompt):
        with open(log, "a") as f:
            f.write("x")
        return [{"turn": 1, "object_id": 10, "phrase": "cup"}]

    got = links.linked_episodes(turns, things, spark.createDataFrame([(1, "p")], "episode long, prompt string"), provider, provider)
    assert {(r.turn, r.object_id, r.source) for r in got.collect()} == {(1, 10, "llm"), (2, 11, "rule")} and got.count() == 2
    assert (tmp_path / "asked").read_text() == "x"


def test_linked_sessions(spark):
    """Session 1 gets an empty reply and rule links; session 2 an unreadable one and no links; an unlisted object is never linked."""
    sessions = spark.createDataFrame([(0, 1, "q", 1, "hall"), (0, 2, "q", 2, "hall"), (0, 3, "q", 3, "hall")], "episode long, session long, room string, day long, gloss string")
    t = [(0, 1, 1, 0, "user", "the cup is here"), (0, 1, 2, 9, "user", "which cup?"), (0, 2, 3, 0, "user", "the cup"), (0, 3, 4, 0, "user", "a coffee table by the box"), (0, 3, 5, 30, "user", "the table")]
    turns = spark.createDataFrame(t, "episode long, session long, turn long, frame long, speaker string, text string")
    box = (0.0,) * 9
    things = [("q", 1, "cup", *box), ("q", 2, "cup", *box), ("q", 3, "coffee table", *box), ("q", 4, "box", *box), ("q", 5, "table", *box), ("q", 6, "table", *box)]
    o = spark.createDataFrame([(*x, []) for x in things], "room string, object_id long, label string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, alternatives array<string>")
    seen = spark.createDataFrame([("q", 1, 5), ("q", 2, 900), *(("q", k, 80) for k in (3, 4, 5, 6))], "room string, object_id long, frame long")
    asked = spark.createDataFrame([(0, 2)], "episode long, turn long")

    def provider(prompt):
        if "(day 2" in prompt:
            raise ValueError
        return [] if "(day 1" in prompt else [{"turn": 4, "object_id": 3, "phrase": "it", "role": "locator"}, {"turn": 4, "object_id": 2}]

    def verifier(prompt):
        assert "\n\n\nTurns:\n" in prompt
        return [{"turn": 4, "object_id": 3}, {"turn": 5, "object_id": 6, "fact_bearing": False}] if "(day 3" in prompt else []

    got = {(r.session, r.turn, r.object_id): (r.source, r.fact_bearing) for r in links.linked_sessions(sessions, turns, asked, o, seen, provider, verifier).collect()}
    # Only cup #1 is listed in session 1, so the class is unique there; the box is a place.
    assert got == {(1, 1, 1): ("rule", True), (3, 4, 3): ("llm", True), (3, 4, 4): ("rule", False), (3, 5, 6): ("llm-verify", False)}


def test_uncovered_takes_the_longest_name(spark):
    turns = spark.createDataFrame([(0, 1, "q", "Coffee tables, c++ book"), (0, 2, "q", "my table")], "episode long, turn long, room string, text string")
    o = spark.createDataFrame([("q", 1, "table"), ("q", 2, "coffee table"), ("q", 3, "C++ book")], "room string, object_id long, label string")
    known = spark.createDataFrame([(0, 1, 3, True), (0, 2, 1, False)], "episode long, turn long, object_id long, fact_bearing boolean")
    got = sorted((r.turn, r.label) for r in links.uncovered_turns(turns, o, known).collect())
    assert got == [(1, "coffee table"), (2, "table")]


def test_link_scores(spark):
    schema = "episode long, turn long, object_id long, fact_bearing boolean"
    gold = spark.createDataFrame([(0, 1, 1, True), (0, 1, 2, False), (0, 2, 3, True), (0, 3, 4, True), (1, 1, 1, True)], schema)
    learned = spark.createDataFrame([(0, 1, 2, True), (0, 2, 3, True), (0, 9, 9, True), (2, 1, 1, True)], schema)
    scores = links.link_scores(learned, gold)
    got = {r.episode: tuple(r)[1:] for r in scores.collect()}
    assert got[0] == (3, 3, 2, 1, 1, pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert got[1] == (0, 1, 0, 0, 0, 0.0, 0.0) and got[2] == (1, 0, 0, 0, 0, 0.0, 0.0)
    assert tuple(links.link_score_total(scores).first()) == (4, 4, 2, 1, 1, 0.5, 0.25)


def test_patience():
    from marlstone.operators.answering import Unavailable, patient

    events, waits, probes = [Unavailable(), KeyError("a"), KeyError("b"), "fine"], [], [False, RuntimeError(), True]

    def step(queue):
        x = queue.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert patient(lambda p: step(events), lambda: step(probes), sleep=waits.append)("q") == "fine"
    assert waits == [60.0, 60.0, 60.0, 5.0, 10.0]
    failing = patient(lambda p: step([ValueError("no")]), lambda: True, sleep=lambda s: None)
    assert failing("q") == "ERROR: no"


def test_asked_once(spark, tmp_path):
    from marlstone.operators import answering

    log = str(tmp_path / "asked")

    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt)
        return "ERROR: x" if prompt == "c" else prompt.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "query_id long, prompt string")
    first = answering.asked(rows, spark.createDataFrame([], "cache_key string, raw string"), ask, "m")
    assert {r.query_id: (r.raw, r.cached) for r in first.collect()} == {1: ("A", False), 2: ("A", False), 3: ("B", False), 4: ("ERROR: x", False)}
    assert sorted(open(log).read()) == ["a", "b", "c"]
    again = answering.asked(rows, answering.new_replies(first), ask, "m")
    assert {r.query_id: r.cached for r in again.collect()} == {1: True, 2: True, 3: True, 4: False}
    assert sorted(open(log).read()) == ["a", "b", "c", "c"]


def test_query_chunks_and_ranges(spark, tmp_path):
    from marlstone.sources import segmentation

    def save(name, **odd):
        a = dict(positions=np.arange(2), queries=np.array([3, 1]), probabilities=np.ones((2, 3), "f2"), score=np.ones(2, "f4"), maps=np.zeros((2, 2, 4, 4), "u1"))
        np.savez(tmp_path / name, **{**a, **odd})

    save("chunk_000.npz")
    got = segmentation.read_query_chunks(spark, str(tmp_path), 4, 2).collect()
    assert sorted((r.chunk, r.query, len(r.probabilities), r.positions) for r in got) == [(0, 1, 3, [0, 1]), (0, 3, 3, [0, 1])]
    save("chunk_001.npz", queries=np.array([3, 3]))
    with pytest.raises(Exception, match="wrong queries"):
        segmentation.read_query_chunks(spark, str(tmp_path), 4, 2).collect()
    ranges = spark.createDataFrame([(0, 0, 4), (1, 5, 6), (2, 5, 9), (3, 9, 9)], 'chunk long, start long, "end" long'.replace('"', "`"))
    got = {r.chunk: r.fault for r in segmentation.range_faults(ranges, 9).collect()}
    assert got == {1: "gap before the chunk", 2: "chunk overlaps", 3: "chunk is empty"}


def test_observation_store_refuses(spark, tmp_path):
    from marlstone.sources import segmentation

    frames = spark.createDataFrame([(0, "a", 3, 5), (1, "b", 3, 5)], "position long, frame_id string, h long, w long")
    schema = "observation_id string, frame_id string, label string, confidence double, track_hint string, label_candidates array<struct<label: string, score: double>>, bits binary"
    good = ("o", "a", "cup", 1.0, "h", [("box", 0.5)], b"ab")
    save = lambda name, *rows: segmentation.write_observations(frames, spark.createDataFrame(rows, schema), f"{tmp_path}/{name}")
    save("x", good)
    assert segmentation.read_observations(frames, f"{tmp_path}/x").first().label == "cup"
    with pytest.raises(ValueError):
        segmentation.read_observations(frames.where("position = 0"), f"{tmp_path}/x")
    for at, value in ((1, "z"), (2, ""), (3, float("nan")), (5, [("cup", 0.1)]), (5, [("box", 0.1), ("box", 0.2)]), (6, b"abc")):
        with pytest.raises(ValueError):
            save("y", (*good[:at], value, *good[at + 1 :]))
    with pytest.raises(ValueError):
        save("y", good, ("p", *good[1:]))
    with pytest.raises(Exception, match="EXISTS"):
        save("x", good)


def test_unknown_mask_value_raises(spark):
    from marlstone.sources import segmentation

    pixels = spark.createDataFrame([(0, 0), (0, 2)], "frame long, value long")
    with pytest.raises(Exception, match="no object"):
        segmentation.mask_observations(pixels, spark.createDataFrame([(0, "cup")], "object_id long, label string")).collect()


def test_constructed(spark, tmp_path):
    """Two fragments of one thing with one hint merge; a thing seen once is dropped but stays recorded."""
    cube = lambda x: [[x + 0.06 * i, 0.06 * j, 0.06 * k] for i in range(8) for j in range(8) for k in range(8)]
    rows = [(7, 0, "a", "cup", "h", cube(0.0), {"mug": 0.5}), (7, 1, "b", "cup", "h", cube(0.0), {"mug": 0.5}), (7, 2, "c", "mug", "h", cube(0.2), {}), (7, 3, "d", "box", "k", cube(5.0), {}), (7, 4, "e", "box", "k", cube(5.0)[:50], {})]
    lifted = spark.createDataFrame(rows, "scene long, position long, observation_id string, label string, hint string, points array<array<double>>, scores map<string, double>")
    things, members = objects.constructed(lifted, least_observations=2)
    got = things.collect()
    assert [(r.scene, r.object_id, r.n_observations, r.label) for r in got] == [(7, 0, 3, "cup")]  # equal scores: the first seen
    assert {r.observation_id for r in members.collect()} == {"a", "b", "c"}
    seen, none = lifted.select("observation_id"), lifted.where("false").select("observation_id")
    objects.write_objects(things, seen, members, none, f"{tmp_path}/o")
    assert objects.read_objects(spark, f"{tmp_path}/o")["members"].count() == 3
    with pytest.raises(ValueError, match="recorded and skipped"):
        objects.write_objects(things, seen, members, seen, f"{tmp_path}/p")


def test_nearest_join_against_all_pairs(spark):
    """Crowded and lone places, two keys, rows too few for the number asked, and places far from all."""
    random = np.random.default_rng(5)
    spots = np.concatenate([random.normal(0, 0.3, (60, 3)), random.normal(40, 5, (25, 3)), [[-900.0, 3, 2], [5000.0, 0, 0]]])
    rows = [(int(i % 7 == 0), i, *map(float, p)) for i, p in enumerate(spots)] + [(2, 500, 0.0, 0.0, 0.0), (2, 501, 9.0, 0.0, 0.0), (3, 600, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double, z double")
    for most, right in ((1, df), (4, df), (1, df.where("id % 5 = 0"))):
        pairs = spatial.nearest_join(df, right, ["k"], most, "id", 0.5, ("x", "y", "z")).select("a.id", F.col("b.id").alias("other"), F.expr("pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)").alias("d")).collect()
        assert len(pairs) == len({(r.id, r.other) for r in pairs}) < len(df.collect()) ** 2
        ids = {r.id for r in right.collect()}
        for k, i, *p in rows:
            away = sorted((sum((u - v) ** 2 for u, v in zip(p, q)), j) for kk, j, *q in rows if kk == k and j != i and j in ids)
            assert [j for _, j in sorted((r.d, r.other) for r in pairs if r.id == i)[:most]] == [j for _, j in away[:most]]


def sens_file(place, frames, kind=2, version=4, cut=0):
    data = struct.pack("<IQ", version, 3) + b"cam" + bytes(256) + struct.pack("<2I4If", kind, 1, 8, 8, 8, 8, 1000.0) + struct.pack("<Q", len(frames))
    for pose, image in frames:
        data += np.array(pose, "<f4").tobytes() + struct.pack("<4Q", 0, 0, len(image), 5) + image + b"depth"
    place.write_bytes(data[: len(data) - cut])


def test_recorded_streams(spark, tmp_path):
    whole, eye = b"\xff\xd8" + b"x" * 40 + b"\xff\xd9", np.eye(4).ravel()
    good = tmp_path / "good"
    good.mkdir()
    frames = [(eye * (np.nan if i == 3 else 1), whole[:2] + bytes([i]) + whole[3:]) for i in range(20)]
    sens_file(good / "a.sens", frames)
    sens_file(good / "empty.sens", [])
    got = sorted(readers.read_sens_images(spark, str(good)).collect(), key=lambda r: r.position)
    assert [(r.name, bytes(r.image)) for r in got] == [(f"{i:06d}.jpg", f[1]) for i, f in enumerate(frames)]
    poses = {r.position: r.camera_to_world for r in readers.read_sens_poses(spark, str(good)).collect()}
    assert poses[3] is None and poses[4] == list(eye) and len(poses) == 20
    for name, frames, how in (("raw", [(eye, whole)], {"kind": 0}), ("torn", [(eye, whole[:-1])], {}), ("old", [(eye, whole)], {"version": 3}), ("cut", [(eye, whole)], {"cut": 2})):
        (tmp_path / name).mkdir()
        sens_file(tmp_path / name / "a.sens", frames, **how)
        with pytest.raises(Exception, match="JPEG|version|ends early"):
            readers.read_sens_images(spark, str(tmp_path / name)).collect()


def test_near_fraction_against_all_pairs(monkeypatch):
    random = np.random.default_rng(1)
    for most in (1 << 20, 7):
        monkeypatch.setattr(objects, "CANDIDATES", most)
        for _ in range(60):
            p, q = (random.normal(0, random.choice([0.1, 1, 5]), (random.integers(1, 60), 3)) for _ in range(2))
            radius = random.choice([0.05, 0.2, 1])
            assert objects.near_fraction(p, q, radius) == (((p[:, None] - q[None]) ** 2).sum(2) <= radius * radius).any(1).mean()
