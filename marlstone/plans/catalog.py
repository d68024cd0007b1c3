"""Every query of the engine by name, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, evidence, links, objects, scoring, spatial, temporal
from ..sources import bridge
from . import context

Query = Callable[[SparkSession, str], DataFrame]
#: Masks of a task, of 400 cells each.
FRAMES_A_TASK = 10_000
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = bridge.with_bridges(sql)
        return f

    return register


def micro(c) -> "F.Column":
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5).cast("long")


# Shared pieces of SQL.
_D = "sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))"
_OX, _OY, _OZ = (f"greatest(0.0::DOUBLE, least(a.{x}1,b.{x}1)-greatest(a.{x}0,b.{x}0))" for x in "xyz")
_IOU = f"CASE WHEN {_OX}*{_OY}*{_OZ} > 0 THEN {_OX}*{_OY}*{_OZ}/((a.x1-a.x0)*(a.y1-a.y0)*(a.z1-a.z0)+(b.x1-b.x0)*(b.y1-b.y0)*(b.z1-b.z0)-{_OX}*{_OY}*{_OZ}) ELSE 0 END"
_FOOT = f"{_OX}*{_OY}/((a.x1-a.x0)*(a.y1-a.y0))"
_PAIR = "FROM b_objects a JOIN b_objects b ON a.room = b.room AND a.object_id <> b.object_id"
_SIDES = "list_sort([{0}.x1-{0}.x0, {0}.y1-{0}.y0, {0}.z1-{0}.z0])"
_FIT = " AND ".join(f"{_SIDES.format('a')}[{k}] < {_SIDES.format('b')}[{k}]" for k in (1, 2, 3))
_HOLD = "'class_0', 'class_3', 'class_5'"
HOLDING = ("class_0", "class_3", "class_5")
_ON = f"SELECT a.room, a.object_id, b.object_id AS surface_id {_PAIR} WHERE b.label IN ({_HOLD}) AND {_FOOT} >= 0.5 AND abs(a.z0-b.z1) <= 0.12"


# Spatial relations.


@query(f"SELECT a.room, a.object_id AS a_id, b.object_id AS b_id, CAST(floor({_D}*1e6+0.5) AS BIGINT) AS distance_um {_PAIR} WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz) <= 2.25")
def near_pairs(spark, sf_dir):
    return spatial.near_pairs(bridge.objects(spark, sf_dir)).select("room", "a_id", "b_id", micro("distance").alias("distance_um"))


_NEAREST = f"SELECT a.object_id, a.room, min({_D}) AS distance, arg_min(b.object_id, {_D}) AS nearest_id {_PAIR} WHERE b.label = 'class_0' GROUP BY a.object_id, a.room"


@query(f"SELECT object_id, room, nearest_id, CAST(floor(distance*1e6+0.5) AS BIGINT) AS distance_um FROM ({_NEAREST})")
def nearest_class(spark, sf_dir):
    return spatial.nearest_class(bridge.objects(spark, sf_dir), "class_0").select("object_id", "room", "nearest_id", micro("distance").alias("distance_um"))


_FIRST = "(SELECT room, min(object_id) AS object_id FROM b_objects WHERE label = '{}' GROUP BY room)"
_REF = f"SELECT a.room, {_D} AS reference FROM (SELECT * FROM b_objects SEMI JOIN {_FIRST.format('class_1')} USING (room, object_id)) a JOIN (SELECT * FROM b_objects SEMI JOIN {_FIRST.format('class_2')} USING (room, object_id)) b ON a.room = b.room"
_FACT = "SELECT DISTINCT object_id FROM b_facts WHERE slot = 'purchase' AND bucket = 1 AND turn < 5000"


@query(f"SELECT n.room, count(*) AS n FROM ({_NEAREST}) n JOIN ({_REF}) r ON n.room = r.room WHERE n.distance < r.reference AND n.object_id IN ({_FACT}) GROUP BY n.room")
def closer_than_reference(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.closer_than(spatial.fact_candidates(bridge.facts(spark, sf_dir), "purchase", 1, 5000), o, "class_0", "class_1", "class_2")


@query(f"SELECT n.room, n.object_id FROM ({_NEAREST}) n JOIN ({_REF}) r ON n.room = r.room WHERE n.distance < r.reference AND n.distance > r.reference / 3")
def between_references(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    near = spatial.nearest_class(o, "class_0").join(spatial.reference_distance(o, "class_1", "class_2"), "room")
    return near.where("distance < reference and distance > reference / 3").select("room", "object_id")


@query(f"SELECT a.room, a.object_id AS a_id, b.object_id AS b_id, CAST(floor(({_IOU})*1e6+0.5) AS BIGINT) AS iou_ppm {_PAIR} WHERE ({_IOU}) > 0")
def aabb_iou_pairs(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.iou_pairs(o, o).select("room", "a_id", "b_id", micro("iou").alias("iou_ppm"))


@query(f"SELECT a.room, a.object_id AS a_id, b.object_id AS b_id, ({_IOU}) > 0 AS touches {_PAIR} WHERE ({_IOU}) > 0 OR {_D} <= 1.0")
def iou_or_distance_candidates(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.iou_or_distance(o, o).select("room", "a_id", "b_id", (F.col("iou") > 0).alias("touches"))


@query(f"SELECT a.room, b.object_id AS reference_id, a.object_id {_PAIR} WHERE b.label = 'class_4' AND {_FIT}")
def box_fit(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.smaller_than(o, o.where("label = 'class_4'"))


@query(f"SELECT b.object_id AS reference_id, count(*) AS n {_PAIR} WHERE {_FIT} GROUP BY b.object_id")
def smaller_every_dim(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.smaller_counts(o, o)


@query(_ON)
def on_surface(spark, sf_dir):
    return spatial.on_surface(bridge.objects(spark, sf_dir), HOLDING)


@query(f"SELECT a.room, a.object_id AS upper_id, b.object_id AS lower_id {_PAIR} WHERE {_FOOT} >= 0.25 AND a.z0-b.z1 > 0.12")
def above_below(spark, sf_dir):
    return spatial.above(bridge.objects(spark, sf_dir))


@query(f"SELECT DISTINCT a.room, a.object_id {_PAIR} WHERE b.label IN ('class_1', 'class_2') AND b.object_id IN (SELECT a.object_id {_PAIR} WHERE {_FOOT} >= 0.25 AND a.z0-b.z1 > 0.12) AND (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz) <= 2.25")
def chained_near_above(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    inner = spatial.above(o).select(F.col("upper_id").alias("object_id"))
    return spatial.chained(o, "class_1", inner).unionByName(spatial.chained(o, "class_2", inner)).distinct()


_STANDS = "(SELECT a.room, a.cx AS px, a.cy AS py, b.cx AS yx, b.cy AS yy, a.z1 AS ez FROM (SELECT * FROM b_objects SEMI JOIN " + _FIRST.format("class_1") + " USING (room, object_id)) a JOIN (SELECT * FROM b_objects SEMI JOIN " + _FIRST.format("class_2") + " USING (room, object_id)) b ON a.room = b.room)"


def stands(o: DataFrame) -> DataFrame:
    """Standing at a room's first object of class_1, at the height of its top, and looking at the first of class_2."""
    pick = lambda label: o.where(F.col("label") == label).groupBy("room").agg(F.min_by(F.struct("cx", "cy", "z1"), "object_id").alias("o")).select("room", "o.*")
    return pick("class_1").select("room", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("z1").alias("ez")).join(pick("class_2").select("room", F.col("cx").alias("yx"), F.col("cy").alias("yy")), "room")


@query(f"SELECT o.room, o.object_id FROM b_objects o JOIN {_STANDS} s ON o.room = s.room WHERE (cx-px)*(yx-px)+(cy-py)*(yy-py) > 0 AND (cx-px)*(yy-py)-(cy-py)*(yx-px) > 0")
def front_right(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.facing(o, stands(o))


@query(f"""WITH r AS (SELECT * FROM b_objects SEMI JOIN {_FIRST.format('class_3')} USING (room, object_id))
SELECT o.room, o.object_id FROM b_objects o JOIN {_STANDS} s ON o.room = s.room JOIN r ON r.room = o.room
WHERE o.object_id <> r.object_id AND atan2(o.cz-ez, sqrt((o.cx-px)*(o.cx-px)+(o.cy-py)*(o.cy-py))) > atan2(r.cz-ez, sqrt((r.cx-px)*(r.cx-px)+(r.cy-py)*(r.cy-py)))""")
def elevation_above(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.appears_above(o, stands(o).select("room", F.col("px").alias("ex"), F.col("py").alias("ey"), "ez"), "class_3")


_MOVED = "moved AS (SELECT m.object_id, m.room, any_value(m.cx) AS bx, any_value(m.cy) AS bz_y, any_value(m.cz) AS bz, avg(d.cx) AS mx, avg(d.cy) AS my, avg(d.z1 + (m.z1-m.z0)/2) AS mz FROM b_objects m JOIN b_objects d ON m.room = d.room AND m.object_id <> d.object_id WHERE m.label = 'class_6' AND d.label = 'class_7' GROUP BY m.object_id, m.room)"


@query(f"""WITH {_MOVED} SELECT room, object_id FROM (SELECT o.room, o.object_id,
min((o.cx-bx)*(o.cx-bx)+(o.cy-bz_y)*(o.cy-bz_y)+(o.cz-bz)*(o.cz-bz)) AS was, min((o.cx-mx)*(o.cx-mx)+(o.cy-my)*(o.cy-my)+(o.cz-mz)*(o.cz-mz)) AS will
FROM b_objects o JOIN moved m ON o.room = m.room AND o.object_id <> m.object_id GROUP BY o.room, o.object_id) WHERE will < was""")
def counterfactual_nearer(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.nearer_after_move(o, o.where("label = 'class_6'"), o.where("label = 'class_7'"))


@query(f"WITH {_MOVED} SELECT a.room, a.object_id, b.object_id AS reference_id FROM moved a JOIN moved b ON a.room = b.room AND a.object_id <> b.object_id WHERE a.bz > b.bz AND a.mz < b.mz")
def counterfactual_lower(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.lower_after_move(o, o.where("label = 'class_6'"), o.where("label = 'class_7'"))


@query("""WITH alt AS (SELECT object_id, 'class_' || CAST((object_id * 7) % 10 AS VARCHAR) AS label FROM b_objects)
SELECT room, object_id FROM b_objects WHERE label = 'class_8' UNION ALL
SELECT o.room, o.object_id FROM b_objects o JOIN alt USING (object_id) WHERE alt.label = 'class_8' AND o.room NOT IN (SELECT room FROM b_objects WHERE label = 'class_8')""")
def label_alternative_fallback(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    alternatives = o.select("object_id", F.concat(F.lit("class_"), ((F.col("object_id") * 7) % 10).cast("string")).alias("label"))
    return spatial.with_alternatives(o, alternatives, "class_8")


@query("SELECT DISTINCT object_id FROM b_facts WHERE slot = 'click' AND bucket = 2 AND turn < 3000")
def fact_candidates(spark, sf_dir):
    return spatial.fact_candidates(bridge.facts(spark, sf_dir), "click", 2, 3000)


# Time.

_BIN = 6 * 3600 * 1_000_000


@query(f"SELECT sequence_id, frame_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, bin ORDER BY micros, frame_id) AS n FROM (SELECT *, (micros - min(micros) OVER (PARTITION BY sequence_id)) // {_BIN} AS bin FROM b_frames)) WHERE n = 1")
def frame_sample(spark, sf_dir):
    return temporal.first_in_bins(bridge.frames(spark, sf_dir), "sequence_id", "micros", _BIN, ["micros", "frame_id"]).select("sequence_id", "frame_id", "bin")


@query("SELECT sequence_id, position // 50 AS chunk, min(position) AS first, max(position) + 1 AS \"end\", count(*) AS n FROM b_frames GROUP BY ALL")
def frame_chunks(spark, sf_dir):
    return temporal.chunked(bridge.frames(spark, sf_dir))


@query("SELECT DISTINCT room, object_id, unnest(range(greatest(0, frame * 6 - 3), frame * 6 + 3)) AS frame FROM b_sightings")
def frame_widen(spark, sf_dir):
    return temporal.widened(bridge.sightings(spark, sf_dir).withColumn("frame", F.col("frame") * 6))


@query("""SELECT DISTINCT episode, frame FROM (SELECT episode, unnest(range(0, max(frame * 7 // 3) + 1, 30)) AS frame FROM b_turns GROUP BY episode
UNION ALL SELECT episode, frame * 7 // 3 FROM b_turns WHERE role = 'user')""")
def per_second_grid(spark, sf_dir):
    return temporal.observation_grid(bridge.turns(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") * 7 / 3).cast("long")))


@query("""WITH a AS (SELECT sequence_id, frame_id, micros, value FROM b_frames WHERE event_type = 'signup')
, j AS (SELECT f.sequence_id, f.frame_id, f.micros, f.event_type, f.value,
 (SELECT struct_pack(t := a.micros, v := a.value) FROM a WHERE a.sequence_id = f.sequence_id AND (a.micros, a.frame_id) <= (f.micros, f.frame_id) ORDER BY a.micros DESC, a.frame_id DESC LIMIT 1) AS p,
 (SELECT struct_pack(t := a.micros, v := a.value) FROM a WHERE a.sequence_id = f.sequence_id AND (a.micros, a.frame_id) >= (f.micros, f.frame_id) ORDER BY a.micros, a.frame_id LIMIT 1) AS n FROM b_frames f)
SELECT sequence_id, frame_id, CASE WHEN event_type = 'signup' THEN 'measured' WHEN p IS NOT NULL AND n IS NOT NULL THEN 'interpolated' WHEN p IS NOT NULL OR n IS NOT NULL THEN 'held' END AS method,
CAST(floor(CASE WHEN event_type = 'signup' THEN value WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * ((micros - p.t)::DOUBLE / (n.t - p.t)::DOUBLE) ELSE coalesce(p.v, n.v) END * 1000 + 0.5) AS BIGINT) AS value_milli FROM j""")
def pose_held_or_interp(spark, sf_dir):
    out = temporal.held_pose(bridge.frames(spark, sf_dir), F.col("event_type") == "signup", ["value"])
    return out.select("sequence_id", "frame_id", "method", F.floor(F.col("pose_value") * 1000 + 0.5).cast("long").alias("value_milli"))


@query("SELECT DISTINCT t.episode, t.turn, s.object_id FROM b_turns t JOIN b_sightings s ON t.room = s.room AND t.frame = s.frame WHERE t.role = 'user'")
def visible_now(spark, sf_dir):
    asked = bridge.turns(spark, sf_dir).where("role = 'user'").select("episode", "turn", "room", "frame")
    return temporal.visible_at(asked, bridge.sightings(spark, sf_dir)).select("episode", "turn", "object_id")


@query("SELECT DISTINCT t.episode, t.turn, s.object_id FROM b_turns t JOIN b_sightings s ON t.room = s.room AND abs(t.frame - s.frame) <= 10")
def in_view_band(spark, sf_dir):
    asked = bridge.turns(spark, sf_dir).select("episode", "turn", "room", "frame")
    return temporal.in_view_band(asked, bridge.sightings(spark, sf_dir), 10).select("episode", "turn", "object_id")


_FIRSTS = "(SELECT room, object_id, min(frame) AS first_frame, count(*) AS n FROM b_sightings GROUP BY room, object_id)"


@query(f"SELECT * FROM {_FIRSTS}")
def first_sighting(spark, sf_dir):
    return temporal.first_sightings(bridge.sightings(spark, sf_dir))


# Evidence.


@query("SELECT object_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY object_id, floor(x/0.1), floor(y/0.1), floor(z/0.1) ORDER BY idx) AS n FROM b_points) WHERE n = 1")
def voxel_reduce(spark, sf_dir):
    return evidence.voxel_reduced(bridge.points(spark, sf_dir), 0.1).select("object_id", "idx")


_MICRO = "CAST(floor({} * 1e6 + 0.5) AS BIGINT)"


@query("SELECT object_id, count(*) AS n, " + ", ".join(f"{_MICRO.format(f'quantile_cont({a}, {q})')} AS {a}{i}" for a in "xyz" for i, q in enumerate((0.005, 0.995))) + " FROM b_points GROUP BY object_id")
def percentile_box(spark, sf_dir):
    b = evidence.percentile_boxes(bridge.points(spark, sf_dir))
    return b.select("object_id", "n", *(micro(f"{a}{i}").alias(f"{a}{i}") for a in "xyz" for i in (0, 1)))


@query("SELECT object_id, count(*) AS n, " + ", ".join(f"round(avg({a}), 6) AS c{a}, {_MICRO.format(f'min({a})')} AS lo{a}, {_MICRO.format(f'max({a})')} AS hi{a}" for a in "xyz") + " FROM b_points GROUP BY object_id")
def centroid_aabb(spark, sf_dir):
    b = evidence.boxes(bridge.points(spark, sf_dir))
    return b.select("object_id", "n", *(x for a in "xyz" for x in (F.round(f"c{a}", 6).alias(f"c{a}"), micro(f"lo{a}").alias(f"lo{a}"), micro(f"hi{a}").alias(f"hi{a}"))))


_SPREAD = """pairs AS (SELECT a.object_id, a.idx, b.idx AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS gap FROM b_points a JOIN b_points b ON a.object_id = b.object_id AND a.idx <> b.idx),
spread AS (SELECT object_id, idx, avg(gap) AS s FROM (SELECT *, row_number() OVER (PARTITION BY object_id, idx ORDER BY gap, other) AS n FROM pairs) WHERE n <= 12 GROUP BY object_id, idx),
marked AS (SELECT *, s <= avg(s) OVER w + stddev_pop(s) OVER w AS inside, count(*) OVER w AS total FROM spread WINDOW w AS (PARTITION BY object_id))"""


@query(f"WITH {_SPREAD} SELECT object_id, idx FROM (SELECT *, sum(CAST(inside AS INT)) OVER (PARTITION BY object_id) AS kept FROM marked) WHERE inside OR total <= 13 OR kept < 8")
def tighten_box(spark, sf_dir):
    return evidence.tightened(bridge.points(spark, sf_dir)).select("object_id", "idx")


@query("SELECT object_id, label, count(*) AS n FROM b_votes GROUP BY object_id, label")
def label_counts(spark, sf_dir):
    return evidence.label_counts(bridge.votes(spark, sf_dir))


_SCORES = "(SELECT object_id, label, CAST(sum(cents) AS BIGINT) AS score, min(seq) AS first_seq FROM b_votes GROUP BY object_id, label)"


@query(f"SELECT * FROM {_SCORES}")
def label_scores(spark, sf_dir):
    return evidence.label_scores(bridge.votes(spark, sf_dir), "cents", "seq")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, first_seq, label) AS rank, max(score) OVER (PARTITION BY object_id) AS top FROM {_SCORES})
SELECT object_id, max(CASE WHEN rank = 1 THEN label END) AS label,
coalesce(array_to_string(list_slice(list(label ORDER BY rank) FILTER (WHERE rank > 1 AND score >= greatest(20, top * 0.1)), 1, 2), ','), '') AS aliases, count(*) - 1 AS n_candidates
FROM r WHERE top > 0 AND score > 0 GROUP BY object_id""")
def label_rank_aliases(spark, sf_dir):
    ranked = evidence.ranked_labels(evidence.label_scores(bridge.votes(spark, sf_dir), "cents", "seq"), least=20.0)
    return ranked.select("object_id", "label", F.array_join("aliases", ",").alias("aliases"), F.size("candidates").cast("long").alias("n_candidates"))


@query(f"SELECT a.object_id AS a_id, b.object_id AS b_id FROM b_objects a JOIN b_objects b ON a.room = b.room AND a.label = b.label WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz) <= 1.0")
def gate_candidates(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    return spatial.gate(o, o, same_label=True)


_NEARPTS = "near AS (SELECT a.object_id AS a_object, b.object_id AS b_object, count(DISTINCT a.idx) AS n_near FROM b_points a JOIN b_points b ON a.object_id <> b.object_id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.1*0.1 GROUP BY ALL)"


@query(f"WITH {_NEARPTS} SELECT a_object, b_object, n AS n_points, n_near FROM near JOIN (SELECT object_id AS a_object, count(*) AS n FROM b_points GROUP BY object_id) USING (a_object)")
def voxel_overlap_fraction(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    return spatial.overlap_fraction(p, p, 0.1)


def overlap_table(spark, sf_dir) -> DataFrame:
    """Scores of a few observations and objects of each frame, from the votes: rows labels, columns last digits."""
    v = bridge.votes(spark, sf_dir)
    return v.groupBy((F.col("object_id") % 20).alias("scene"), F.col("object_id").alias("frame"), F.col("label").alias("row"), (F.col("seq") % 3).alias("col")).agg((F.max("cents") / 10).alias("overlap"))


_OVERLAP = "t AS (SELECT object_id % 20 AS scene, object_id AS frame, label AS row, seq % 3 AS col, max(cents) / 10 AS overlap FROM b_votes GROUP BY ALL)"


@query(f"""WITH {_OVERLAP}, r AS (SELECT *, row_number() OVER k AS k, lead(overlap, 1, 0.0) OVER k AS nxt, row_number() OVER (PARTITION BY scene, frame ORDER BY overlap DESC, row, col) AS ord FROM t WINDOW k AS (PARTITION BY scene, frame, row ORDER BY overlap DESC, col)),
c AS (SELECT *, CASE WHEN k = 1 AND overlap >= 0.15 AND overlap - nxt >= 0.10 THEN ord END AS claim FROM r), w AS (SELECT *, min(claim) OVER (PARTITION BY scene, frame, col) AS win FROM c),
g AS (SELECT scene, frame, row, max(CASE WHEN claim = win THEN col END) AS col, bool_or(overlap >= 0.15 AND (win IS NULL OR win > ord)) AS free FROM w GROUP BY scene, frame, row)
SELECT scene, frame, row, CASE WHEN col IS NOT NULL THEN 'match' WHEN free THEN 'drop' ELSE 'new' END AS decision, col FROM g""")
def margin_decision(spark, sf_dir):
    return objects.frame_decisions(overlap_table(spark, sf_dir))


_TOGETHER = "SELECT DISTINCT s.object_id AS a_object, t.object_id AS b_object FROM b_sightings s JOIN b_sightings t ON s.room = t.room AND s.frame = t.frame AND s.object_id < t.object_id"


@query(f"SELECT a.object_id AS a_object, b.object_id AS b_object FROM b_objects a JOIN b_objects b ON a.room = b.room AND a.object_id < b.object_id ANTI JOIN ({_TOGETHER}) v ON v.a_object = a.object_id AND v.b_object = b.object_id")
def covisibility_veto(spark, sf_dir):
    o, s = bridge.objects(spark, sf_dir).select("room", "object_id"), bridge.sightings(spark, sf_dir).distinct()
    return evidence.apart_pairs(o, s)


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(u.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE)))"


@query(f"SELECT u.vec_id AS a_object, v.vec_id AS b_object FROM embeddings u JOIN embeddings v ON u.vec_id % 20 = v.vec_id % 20 AND u.vec_id < v.vec_id WHERE {_COS} >= 0.3")
def cosine_confirm(spark, sf_dir):
    v = bridge.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("room"), "vec_id", "embedding")
    return evidence.look_alikes(v, 0.3)


@query(f"""WITH {_NEARPTS}, size AS (SELECT object_id AS a_object, count(*) AS n FROM b_points GROUP BY object_id), s AS (SELECT DISTINCT object_id % 400 AS room, object_id % 20 AS object_id, frame // 40 AS frame FROM b_sightings)
SELECT a_object, b_object FROM near JOIN size USING (a_object) JOIN embeddings u ON u.vec_id = a_object JOIN embeddings v ON v.vec_id = b_object
WHERE a_object < b_object AND n_near >= 0.5 * n AND {_COS} >= 0.0 AND NOT EXISTS (SELECT 1 FROM s p JOIN s q ON p.room = q.room AND p.frame = q.frame WHERE p.object_id = a_object AND q.object_id = b_object)""")
def merge_edges(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    seen = bridge.sightings(spark, sf_dir).select((F.col("object_id") % 400).alias("room"), (F.col("object_id") % 20).alias("object_id"), F.floor(F.col("frame") / 40).alias("frame")).distinct()
    looks = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), F.col("embedding").alias("vector"))
    return evidence.merge_edges(spatial.overlap_fraction(p, p, 0.1), seen, looks, least_cosine=0.0)


@query(f"SELECT object_id, n, printf('object:%04d', row_number() OVER (ORDER BY object_id) - 1) AS new_id FROM {_FIRSTS} WHERE n >= 18")
def thin_drop_renumber(spark, sf_dir):
    return evidence.renumbered(temporal.first_sightings(bridge.sightings(spark, sf_dir)), "n", 18).select("object_id", "n", "new_id")


@query("SELECT sequence_id, event_type, n FROM (SELECT sequence_id, event_type, count(*) * 5 AS n, any_value(sequence_id % 7 * 4000) AS area FROM b_frames GROUP BY sequence_id, event_type) WHERE n >= greatest(50.0, 0.005 * area)")
def visibility_rule(spark, sf_dir):
    n = bridge.frames(spark, sf_dir).groupBy("sequence_id", "event_type").agg((F.count("*") * 5).alias("n")).withColumn("area", F.col("sequence_id") % 7 * 4000)
    return evidence.visible_pixels(n).select("sequence_id", "event_type", "n")


@query("SELECT object_id, label FROM (SELECT object_id, label, greatest(x1-x0, y1-y0, z1-z0) AS side, object_id % 500 AS vertices FROM b_objects) WHERE label NOT IN ('class_1', 'class_9') AND vertices >= 200 AND side >= 0.25")
def structure_filter(spark, sf_dir):
    from ..functions.geometry import longest_side

    o = bridge.objects(spark, sf_dir)
    kept = evidence.not_structure(o, ("class_1", "class_9")).where((F.col("object_id") % 500 >= 200) & (longest_side("") >= 0.25))
    return kept.select("object_id", "label")


@query("SELECT l.episode, l.turn, l.object_id FROM b_learned l JOIN b_turns t ON l.episode = t.episode AND l.turn = t.turn WHERE EXISTS (SELECT 1 FROM b_objects o WHERE o.object_id = l.object_id AND o.room = t.room)")
def enum_filter(spark, sf_dir):
    found = links.in_domain(bridge.links(spark, sf_dir, gold=False), bridge.turns(spark, sf_dir), bridge.objects(spark, sf_dir))
    return found.select("episode", "turn", "object_id")


# Links. Classes are words of the dialogue, one for a hundred turns at least, that are no place words or articles.
_NO_CLASS = "('" + "', '".join(sorted({w for x in (*T.PLACE_WORDS, *T.ARTICLES) for w in x.split()})) + "')"
_NAMED = f"named AS (SELECT object_id, room, words[CAST(object_id % 1000003 * 7919 % greatest(len(words), 1) AS INT) + 1] AS label FROM b_objects, (SELECT list_sort(list(word)) AS words FROM (SELECT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM b_turns) WHERE regexp_full_match(word, '[a-z]{{2,}}') AND word NOT IN {_NO_CLASS} GROUP BY word HAVING count(*) * 100 >= (SELECT count(*) FROM b_turns))))"
_EDGE = "[^\\p{L}\\p{N}_]"
_TEXT = "(' ' || lower(t.text) || ' ')"
_HAS = f"CASE WHEN strpos(lower(t.text), n.label) > 0 THEN regexp_matches({_TEXT}, '{_EDGE}' || n.label || 's?{_EDGE}') ELSE FALSE END"
_UNIQUE = "uniq AS (SELECT room, label, min(object_id) AS object_id FROM named GROUP BY room, label HAVING count(*) = 1)"
_PLACE = f"'{T.PLACE_PREFIX}'"
#: Phrases after a place word and an article are taken out; some phrase is left if the class is a subject.
_SUBJECT = f"regexp_matches(regexp_replace({_TEXT}, '({T.PLACE_PREFIX})' || n.label || 's?({_EDGE})', '\\1#\\4', 'g'), '{_EDGE}' || n.label || 's?{_EDGE}')"


def named_objects(spark, sf_dir) -> DataFrame:
    words = bridge.turns(spark, sf_dir).select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where(F.col("word").rlike("^[a-z]{2,}\\z") & F.expr(f"word NOT IN {_NO_CLASS}"))
    turns = bridge.turns(spark, sf_dir).agg(F.count("*").alias("turns"))
    common = words.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(turns)).where("n * 100 >= turns")
    vocabulary = common.agg(F.sort_array(F.collect_set("word")).alias("words"))
    at = F.col("object_id") % 1000003 * 7919 % F.greatest(F.size("words"), F.lit(1))
    return bridge.objects(spark, sf_dir).join(F.broadcast(vocabulary)).select("object_id", "room", F.get("words", at.cast("int")).alias("label"))


@query(f"WITH {_NAMED}, {_UNIQUE} SELECT t.episode, t.turn, n.object_id, n.label AS phrase, {_SUBJECT} AS fact_bearing FROM b_turns t JOIN uniq n ON t.room = n.room WHERE {_HAS}")
def rule_links(spark, sf_dir):
    return links.rule_links(bridge.turns(spark, sf_dir), named_objects(spark, sf_dir))


@query(f"SELECT episode, turn, regexp_matches(lower(text), {_PLACE}) AS has_place FROM b_turns")
def locator_subject(spark, sf_dir):
    return bridge.turns(spark, sf_dir).select("episode", "turn", F.lower("text").rlike(T.PLACE_PREFIX).alias("has_place"))


@query("SELECT episode, turn, md5(CASE WHEN strpos(lower(text), 'the') > 0 THEN substr(text, 1, strpos(lower(text), 'the') + 2) || ' [#' || turn || ']' || substr(text, strpos(lower(text), 'the') + 3) ELSE text || ' [#' || turn || ']' END) AS marked_md5 FROM b_turns")
def mention_mark(spark, sf_dir):
    return bridge.turns(spark, sf_dir).select("episode", "turn", F.md5(T.mention_mark(F.col("text"), F.lit("the"), F.col("turn"))).alias("marked_md5"))


@query(f"""WITH {_NAMED}, covered AS (SELECT DISTINCT l.episode, l.turn, n.label FROM b_learned l JOIN named n USING (object_id) WHERE l.fact_bearing)
SELECT DISTINCT t.episode, t.turn, n.label FROM b_turns t JOIN named n ON t.room = n.room ANTI JOIN covered c ON c.episode = t.episode AND c.turn = t.turn AND c.label = n.label WHERE {_HAS}""")
def uncovered_turns(spark, sf_dir):
    return links.uncovered_turns(bridge.turns(spark, sf_dir), named_objects(spark, sf_dir), bridge.links(spark, sf_dir, gold=False))


_ORDER = "list_position(['log', 'compiled', 'evidence', 'llm', 'rule', 'llm-verify'], source)"


@query(f"""WITH al AS (SELECT * FROM b_gold UNION ALL SELECT * FROM b_learned), g AS (SELECT episode, turn, object_id, source, phrase, fact_bearing OR source = 'compiled' AS fact_bearing FROM al
WHERE source <> 'evidence' OR episode NOT IN (SELECT episode FROM al WHERE source = 'log'))
SELECT episode, turn, object_id, bool_or(fact_bearing) AS fact_bearing, arg_min(source, {_ORDER}) AS source FROM g GROUP BY ALL""")
def gold_union(spark, sf_dir):
    both = bridge.links(spark, sf_dir, gold=True).unionByName(bridge.links(spark, sf_dir, gold=False))
    return links.gold_links(both).select("episode", "turn", "object_id", "fact_bearing", "source")


_SAME = "{0}.episode = x.episode AND {0}.turn = x.turn AND {0}.object_id = x.object_id"
_SCORED = f"""l AS (SELECT DISTINCT episode, turn, object_id FROM b_learned), f AS (SELECT DISTINCT episode, turn, object_id FROM b_gold WHERE fact_bearing),
lh AS (SELECT *, EXISTS (SELECT 1 FROM b_gold x WHERE {_SAME.format("l")}) AS hit FROM l),
fh AS (SELECT *, EXISTS (SELECT 1 FROM l x WHERE {_SAME.format("f")}) AS found, EXISTS (SELECT 1 FROM l x WHERE x.episode = f.episode AND x.turn = f.turn) AS linked FROM f),
ls AS (SELECT episode, count(*) AS n_learned, count(*) FILTER (WHERE hit) AS hits FROM lh GROUP BY episode),
fs AS (SELECT episode, count(*) AS n_gold, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE linked AND NOT found) AS wrong_object FROM fh GROUP BY episode),
sc AS (SELECT episode, {", ".join(f"coalesce({c}, 0) AS {c}" for c in links.LINK_COUNTS)} FROM (SELECT episode FROM b_learned UNION SELECT episode FROM b_gold) e LEFT JOIN ls USING (episode) LEFT JOIN fs USING (episode))"""


@query(f"""WITH {_SCORED} SELECT *, CAST(floor(hits::DOUBLE / greatest(1, n_learned) * 1e6 + 0.5) AS BIGINT) AS precision_ppm, CAST(floor(found::DOUBLE / greatest(1, n_gold) * 1e6 + 0.5) AS BIGINT) AS recall_ppm FROM sc""")
def link_precision_recall(spark, sf_dir):
    s = links.link_scores(bridge.links(spark, sf_dir, gold=False), bridge.links(spark, sf_dir, gold=True))
    return s.select("episode", *links.LINK_COUNTS, micro("precision").alias("precision_ppm"), micro("recall").alias("recall_ppm"))


@query("SELECT episode, count(o.object_id) AS kept, count(*) - count(o.object_id) AS dropped FROM b_gold g LEFT JOIN (SELECT object_id FROM b_objects WHERE object_id % 3 <> 0) o USING (object_id) GROUP BY episode")
def link_replay(spark, sf_dir):
    other = bridge.objects(spark, sf_dir).where("object_id % 3 <> 0").select("object_id", (F.col("object_id") + 1000).alias("other_id"))
    return links.replay_stats(bridge.links(spark, sf_dir, gold=True), other)


@query("SELECT source, count(*) AS n, count(DISTINCT object_id) AS objects, count(DISTINCT (episode, turn)) AS turns FROM b_gold GROUP BY source")
def link_stats(spark, sf_dir):
    return links.link_stats(bridge.links(spark, sf_dir, gold=True))


# Context. A conversation is an episode of two sessions in two rooms; its last user turn asks.
_TURNS = "tt AS (SELECT episode, turn, text, role AS speaker, turn // 3 AS session, (episode + turn // 3) % 20 AS room, turn % 3 * 20 AS frame FROM b_turns WHERE role <> 'system')"
_QUEST = "q AS (SELECT episode AS question_id, episode, max(turn) AS q_turn FROM tt WHERE speaker = 'user' GROUP BY episode), qq AS (SELECT q.*, tt.session AS q_session, tt.frame AS q_frame FROM q JOIN tt ON tt.episode = q.episode AND tt.turn = q.q_turn)"
_SCOPE = "scope AS (SELECT question_id, qq.episode, q_turn, q_frame, s.session, s.room, CASE WHEN s.session = q_session THEN q_frame ELSE s.\"end\" END AS last FROM qq JOIN (SELECT episode, session, room, max(frame) AS \"end\" FROM tt GROUP BY ALL) s ON s.episode = qq.episode AND s.session <= q_session)"
_SEEN = f"firsts AS {_FIRSTS}, seen AS (SELECT scope.*, o.*, f.first_frame FROM scope JOIN firsts f ON f.room = scope.room AND f.first_frame <= scope.last JOIN b_objects o ON o.object_id = f.object_id AND o.room = f.room)"
_CTX = f"{_TURNS}, {_QUEST}, {_SCOPE}, {_SEEN}"
_VEC = "printf('[%.3f, %.3f, %.3f]', {}, {}, {})"


def dialogue(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions and turns."""
    t = bridge.turns(spark, sf_dir).where("role <> 'system'")
    session = F.floor(F.col("turn") / 3).cast("long")
    told = t.select("episode", "turn", "text", F.col("role").alias("speaker"), session.alias("session"), ((F.col("episode") + session) % 20).alias("room"), (F.col("turn") % 3 * 20).alias("frame"))
    asked = told.where("speaker = 'user'").groupBy("episode").agg(F.max_by(F.struct("turn", "session", "frame"), "turn").alias("q"))
    return asked.select(F.col("episode").alias("question_id"), "episode", "q.*"), told


@query(f"""WITH {_CTX} SELECT question_id, session, label, object_id, -1 AS turn, md5(label || ' #' || object_id || '   centroid ' || {_VEC.format('cx', 'cy', 'cz')} || '   box ' || {_VEC.format('x0', 'y0', 'z0')} || ' to ' || {_VEC.format('x1', 'y1', 'z1')} || '   first seen frame ' || first_frame) AS line_md5 FROM seen
UNION ALL SELECT s.question_id, s.session, s.label, s.object_id, tt.turn, md5('    [' || tt.turn || ' · ' || speaker || '] ' || CASE WHEN strpos(lower(tt.text), lower(l.phrase)) > 0 AND l.phrase <> '' THEN substr(tt.text, 1, strpos(lower(tt.text), lower(l.phrase)) + length(l.phrase) - 1) || ' [#' || s.object_id || ']' || substr(tt.text, strpos(lower(tt.text), lower(l.phrase)) + length(l.phrase)) ELSE tt.text || ' [#' || s.object_id || ']' END) AS line_md5
FROM seen s JOIN b_gold l ON l.episode = s.episode AND l.object_id = s.object_id AND l.fact_bearing JOIN tt ON tt.episode = l.episode AND tt.turn = l.turn WHERE tt.turn < s.q_turn""")
def context_memory_lines(spark, sf_dir):
    q, t = dialogue(spark, sf_dir)
    lines = context.memory_lines(q, t, temporal.first_sightings(bridge.sightings(spark, sf_dir)), bridge.objects(spark, sf_dir), bridge.links(spark, sf_dir, gold=True))
    return lines.select("question_id", "session", "label", "object_id", "turn", F.md5("line").alias("line_md5"))


@query(f"""WITH {_CTX}, said AS (SELECT scope.question_id, scope.room, scope.session, tt.turn, tt.frame, tt.speaker, tt.text FROM scope JOIN tt ON tt.episode = scope.episode AND tt.session = scope.session WHERE tt.turn < q_turn),
vis AS (SELECT s.room, s.frame, string_agg(o.label || ' #' || o.object_id, ', ' ORDER BY o.object_id) AS v FROM (SELECT DISTINCT room, frame, object_id FROM b_sightings) s JOIN b_objects o ON o.room = s.room AND o.object_id = s.object_id GROUP BY s.room, s.frame)
SELECT question_id, session, first_frame AS frame, 0.0::DOUBLE AS rank, object_id AS seq, md5(printf('frame %5d  seen   ', first_frame) || label || ' #' || object_id || '   centroid ' || {_VEC.format('cx', 'cy', 'cz')}) AS line_md5 FROM seen
UNION ALL SELECT question_id, session, frame, 0.5::DOUBLE, seq, md5(printf('frame %5d  in view: ', frame) || coalesce(v, '(nothing)')) FROM (SELECT question_id, session, room, frame, min(turn) AS seq FROM said WHERE speaker = 'user' GROUP BY ALL) LEFT JOIN vis USING (room, frame)
UNION ALL SELECT question_id, session, frame, 1.0::DOUBLE, turn, md5(printf('frame %5d  ', frame) || rpad(speaker, 9, ' ') || '  [' || turn || '] ' || text) FROM said""")
def context_full_events(spark, sf_dir):
    q, t = dialogue(spark, sf_dir)
    s = bridge.sightings(spark, sf_dir)
    lines = context.full_events(q, t, temporal.first_sightings(s), bridge.objects(spark, sf_dir), s)
    return lines.select("question_id", "session", "frame", "rank", "seq", F.md5("line").alias("line_md5"))


@query(f"""WITH {_TURNS}, vis AS (SELECT s.room, s.frame, string_agg(o.label || ' #' || o.object_id, ', ' ORDER BY o.object_id) AS v FROM (SELECT DISTINCT room, frame, object_id FROM b_sightings) s JOIN b_objects o ON o.room = s.room AND o.object_id = s.object_id GROUP BY s.room, s.frame),
grid AS (SELECT DISTINCT episode, room, frame FROM (SELECT episode, room, unnest(range(0, max(frame) + 1, 30)) AS frame FROM tt GROUP BY episode, room UNION ALL SELECT episode, room, frame FROM tt WHERE speaker = 'user'))
SELECT episode, room, frame, md5(printf('frame %5d  ', frame) || coalesce(v, '(nothing)')) AS line_md5 FROM grid LEFT JOIN vis USING (room, frame)""")
def context_frame_obs(spark, sf_dir):
    _, t = dialogue(spark, sf_dir)
    lines = context.frame_observations(t.withColumn("role", F.col("speaker")), bridge.sightings(spark, sf_dir), bridge.objects(spark, sf_dir))
    return lines.select("episode", "room", "frame", F.md5("line").alias("line_md5"))


@query(f"""WITH {_CTX}, p AS (SELECT question_id, session, label, label || ' ' || string_agg('#' || object_id, ' ' ORDER BY object_id) AS part FROM (SELECT DISTINCT question_id, session, label, object_id FROM seen) GROUP BY question_id, session, label)
SELECT question_id, session, md5(string_agg(part, '; ' ORDER BY label)) AS line_md5 FROM p GROUP BY question_id, session""")
def room_inventory(spark, sf_dir):
    q, t = dialogue(spark, sf_dir)
    seen = context.seen_objects(context.last_frames(q, t), temporal.first_sightings(bridge.sightings(spark, sf_dir)), bridge.objects(spark, sf_dir))
    return context.inventory(seen, ["question_id", "session"]).select("question_id", "session", F.md5("line").alias("line_md5"))


@query(f"WITH {_TURNS} SELECT episode, string_agg('day ' || (session + 1) || ' = room' || room || ' (room ' || room || ', session ' || (session + 1) || ')', '; ' ORDER BY session) AS line FROM (SELECT DISTINCT episode, session, room FROM tt) GROUP BY episode")
def day_table(spark, sf_dir):
    _, t = dialogue(spark, sf_dir)
    s = t.select("episode", "session", "room").distinct()
    return context.day_table(s.select("episode", "session", "room", (F.col("session") + 1).alias("day"), F.concat(F.lit("room"), "room").alias("gloss")))


# Scores.
_ANSWERS = """ans AS (SELECT query_id, family, session, official, ['count', 'bool', 'track'][query_id % 3 + 1] AS kind, query_id % 5 AS lo, query_id % 5 + 1 AS hi,
CASE WHEN query_id % 11 = 0 THEN NULL WHEN query_id % 3 = 0 THEN CAST(query_id % 7 AS VARCHAR) WHEN query_id % 3 = 1 THEN ['true', 'yes', 'false', 'no'][query_id % 4 + 1] ELSE 'Scene 0' || (query_id % 4) || ' # ' || (query_id % 6) END AS pred,
CASE WHEN query_id % 2 = 0 THEN 'true' ELSE 'false' END AS key, '0' || (query_id % 4) || '#' || (query_id % 3) AS want FROM b_results)"""
_CORRECT = "coalesce(CASE kind WHEN 'count' THEN TRY_CAST(pred AS DOUBLE) BETWEEN lo AND hi WHEN 'bool' THEN coalesce(pred IN ('true', 'yes'), FALSE) = (key = 'true') ELSE regexp_replace(lower(coalesce(pred, '')), 'scene| ', '', 'g') = want END, FALSE)"


def answers(spark, sf_dir) -> DataFrame:
    k = F.col("query_id")
    lit = F.lit
    pick = lambda options, by: F.element_at(F.array(*map(lit, options)), (by + 1).cast("int"))
    track = F.concat(lit("Scene 0"), (k % 4).cast("string"), lit(" # "), (k % 6).cast("string"))
    pred = F.when(k % 11 == 0, None).when(k % 3 == 0, (k % 7).cast("string")).when(k % 3 == 1, pick(("true", "yes", "false", "no"), k % 4)).otherwise(track)
    return bridge.results(spark, sf_dir).select(
        "query_id", "family", "session", "official", pick(("count", "bool", "track"), k % 3).alias("answer_type"), (k % 5).alias("low"), (k % 5 + 1).alias("high"), pred.alias("pred"),
        F.when(k % 2 == 0, "true").otherwise("false").alias("key"), F.concat(lit("0"), (k % 4).cast("string"), lit("#"), (k % 3).cast("string")).alias("want_ref"),
    )


@query(f"WITH {_ANSWERS} SELECT query_id, {_CORRECT} AS correct FROM ans")
def score_answers(spark, sf_dir):
    return scoring.scored(answers(spark, sf_dir)).select("query_id", "correct")


@query(f"WITH {_ANSWERS} SELECT family, session, count(*) AS n, CAST(sum(CAST({_CORRECT} AS INT)) AS BIGINT) AS correct FROM ans WHERE official GROUP BY GROUPING SETS ((), (family), (session))")
def accuracy_summary(spark, sf_dir):
    return scoring.accuracy(scoring.scored(answers(spark, sf_dir)))


@query(f"WITH {_ANSWERS} SELECT family, count(*) AS n, CAST(sum(CAST({_CORRECT} AS INT)) AS BIGINT) AS correct FROM (SELECT * REPLACE ('union_' || substr(family, 10) AS family) FROM ans) WHERE official GROUP BY family")
def accuracy_by_family(spark, sf_dir):
    rows = scoring.scored(answers(spark, sf_dir)).where("official")
    family = T.family_of(F.concat(F.lit("multi_clip_cross_slot_semantic_union_"), F.substring("family", 10, 100)))
    return rows.withColumn("family", family).groupBy("family").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"))


@query(f"WITH {_ANSWERS}, w AS (SELECT *, query_id % 4 AS work FROM ans WHERE query_id % 9 <> 0) SELECT kind AS answer_type, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(pred AS BIGINT) = work) AS agree, count(*) FILTER (WHERE work BETWEEN lo AND hi) AS correct_from_work FROM w GROUP BY kind")
def work_vs_answer(spark, sf_dir):
    a = answers(spark, sf_dir)
    n = F.col("query_id") % 4
    work = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit('{"counts": '), (i <= n).cast("string"), F.lit("}"))), ", ")
    reply = F.when(F.col("query_id") % 9 != 0, F.concat(F.lit('{"work": ['), work, F.lit('], "answer": 1}'))).otherwise("no list")
    return scoring.worklist_agreement(a.withColumn("reply", reply).withColumn("work", scoring.work_count()))


@query("SELECT query_id, room, object_id FROM (SELECT object_id AS query_id, room, object_id FROM b_objects WHERE object_id % 4 <> 0)")
def position_resolve(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    said = F.format_string("I think: Day %d | %s | [%.4f, %.4f, %.4f]", F.col("room") + 1, "label", *(F.col(c) + F.when(F.col("object_id") % 4 == 0, 500.0).otherwise(0.0) for c in ("cx", "cy", "cz")))
    asked = o.select(F.col("object_id").alias("query_id"), F.lit(1).alias("episode"), said.alias("pred"))
    sessions = o.select(F.lit(1).alias("episode"), (F.col("room") + 1).alias("day"), "room").distinct()
    return scoring.resolved_positions(asked, sessions, o)


@query("SELECT query_id FROM b_results WHERE NOT (a IS NOT NULL AND query_id % 17 <> 0)")
def todo_anti_join(spark, sf_dir):
    r = bridge.results(spark, sf_dir)
    done = r.where("a is not null").select("query_id", F.when(F.col("query_id") % 17 == 0, "ERROR 429").otherwise("{}").alias("raw"))
    return scoring.to_do(r.select("query_id"), done)


@query("SELECT episode, turn, substr(sha256(role || chr(10) || text), 1, 16) AS key FROM b_turns")
def reply_cache_key(spark, sf_dir):
    return bridge.turns(spark, sf_dir).select("episode", "turn", T.short_hash(F.col("role"), F.col("text")).alias("key"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY session, query_id % 1000 ORDER BY family DESC, query_id DESC) AS n FROM b_results) SELECT session AS configuration, count(*) AS n, CAST(sum(CAST(query_id % 7 < 4 AS INT)) AS BIGINT) AS correct FROM r WHERE n = 1 GROUP BY session")
def dedup_latest_result(spark, sf_dir):
    r = bridge.results(spark, sf_dir).select(F.col("session").alias("configuration"), (F.col("query_id") % 7 < 4).alias("correct"), F.col("family").alias("path"), F.col("query_id").alias("line"), (F.col("query_id") % 1000).alias("query_id"))
    return scoring.run_accuracy(r).select("configuration", "n", "correct")


@query("SELECT count(*) AS n, CAST(sum(CAST(b AS INT) - CAST(a AS INT)) AS BIGINT) AS net FROM b_results WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_difference(spark, sf_dir):
    return scoring.paired_difference(bridge.results(spark, sf_dir))


@query()
def paired_bootstrap(spark, sf_dir):
    return scoring.paired_bootstrap(bridge.results(spark, sf_dir))


# Python state, and iteration.


@query()
def greedy_assignment(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    shifted = o.select("object_id", "room", "label", *((F.col(c) + 0.1).alias(c) for c in ("cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1")))
    return align.assigned(o, shifted)


@query()
def umeyama_fit(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    poses = p.select(F.col("object_id").alias("clip"), F.col("idx").alias("frame"), "x", "y", "z")
    turned = poses.select("clip", "frame", (2 * F.col("y") + 1).alias("x"), (-2 * F.col("x") + 3).alias("y"), (2 * F.col("z") - 1).alias("z"))
    fit = align.similarity_fit(align.shared_poses(poses, turned))
    return fit.select("clip", "n", F.round("scale", 6).alias("scale"), *(F.round(F.col("shift")[i], 6).alias(f"shift{i}") for i in range(3)))


def clouds(spark, sf_dir) -> DataFrame:
    """Observations of each room: points scattered about each object's centroid, in frames of four objects."""
    o = bridge.objects(spark, sf_dir)
    grid = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.array(*(F.col(c) / 4 + (F.floor(i / 8**k) % 8) * 0.02 for k, c in enumerate(("cx", "cy", "cz")))))
    return o.select(F.col("room").alias("scene"), F.floor(F.col("object_id") / 80).alias("position"), F.col("object_id").alias("observation_id"), "label", F.col("object_id").cast("string").alias("hint"), grid.alias("points"))


@query()
def associate_frames(spark, sf_dir):
    return objects.associate(clouds(spark, sf_dir))


@query()
def merge_fragments(spark, sf_dir):
    c = clouds(spark, sf_dir)
    looks = bridge.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("observation_id"), F.transform("embedding", lambda v: v.cast("double")).alias("look"))
    rows = c.join(looks, "observation_id").select("scene", F.col("observation_id").alias("object_id"), "label", "points", F.array("position").alias("frames"), F.array((F.col("observation_id") % 3).cast("string")).alias("hints"), "look")
    return objects.merge_fragments(rows)


_VOTED = "v AS (SELECT object_id, idx, count(*) FILTER (WHERE visible) AS votes, count(*) FILTER (WHERE visible AND inside) AS inside FROM (SELECT object_id, idx, (idx + f) % 3 <> 0 AS visible, (idx * 7 + f) % 5 < 2 AS inside FROM b_points, range(4) r(f)) GROUP BY object_id, idx)"


@query(f"WITH {_VOTED}, m AS (SELECT *, votes >= 2 AND 2 * inside < votes AS gone FROM v) SELECT object_id, idx FROM (SELECT *, count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY object_id) AS kept FROM m) WHERE NOT gone OR kept < 8")
def carve_points(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    f = F.col("f")
    seen = p.select("object_id", "idx", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("f")).select("object_id", "idx", f.alias("frame_id"), ((F.col("idx") + f) % 3 != 0).alias("visible"), ((F.col("idx") * 7 + f) % 5 < 2).alias("in_mask"))
    return objects.carved(p, objects.point_votes(seen)).select("object_id", "idx")


def mask_cells(spark, sf_dir) -> DataFrame:
    """A 20 x 20 mask of each part size, with holes and two depths; dealt by frame before a row becomes 400."""
    frames = bridge.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_id"), "p_size")
    frames = frames.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), frames.count() // FRAMES_A_TASK), "frame_id")
    cells = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col"))
    return cells.where((F.col("row") * 7 + F.col("col") * 3 + F.col("p_size")) % 23 != 0).select("frame_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (F.lit(1.0) + F.col("row") * 0.01 + F.when((F.col("row") + F.col("col")) % 19 == 0, 3.0).otherwise(0.0)).alias("depth"))


_CELLS = "cells AS (SELECT p_partkey AS frame_id, r AS row, c AS col, 1.0::DOUBLE + r * 0.01::DOUBLE + CASE WHEN (r + c) % 19 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS depth FROM part, range(20) a(r), range(20) b(c) WHERE (r * 7 + c * 3 + p_size) % 23 <> 0)"


@query(f"WITH {_CELLS} SELECT frame_id, row, col, CAST(floor(share * 1e6 + 0.5) AS BIGINT) AS share_ppm FROM (SELECT frame_id, R.i AS row, C.i AS col, sum(greatest(0.0, least((R.i + 1) * (20/7::DOUBLE), row + 1.0) - greatest(R.i * (20/7::DOUBLE), row * 1.0)) / (20/7::DOUBLE) * (greatest(0.0, least((C.i + 1) * (20/6::DOUBLE), col + 1.0) - greatest(C.i * (20/6::DOUBLE), col * 1.0)) / (20/6::DOUBLE))) AS share FROM cells, range(7) R(i), range(6) C(i) GROUP BY ALL) WHERE share >= 0.5")
def coverage_fraction(spark, sf_dir):
    return evidence.coverage(mask_cells(spark, sf_dir), 20, 20, 7, 6).select("frame_id", "row", "col", micro("share").alias("share_ppm"))


@query(f"""WITH {_CELLS}, er AS (SELECT a.frame_id, a.row, a.col, any_value(a.depth) AS depth FROM cells a JOIN cells b ON a.frame_id = b.frame_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.frame_id, a.row, a.col HAVING count(*) = 9),
core AS (SELECT frame_id, quantile_cont(depth, 0.05) AS lo, quantile_cont(depth, 0.95) AS hi FROM er GROUP BY frame_id HAVING count(*) >= 20), al AS (SELECT frame_id, quantile_cont(depth, 0.05) AS lo, quantile_cont(depth, 0.95) AS hi FROM cells GROUP BY frame_id)
SELECT frame_id, row, col FROM cells JOIN al USING (frame_id) LEFT JOIN core USING (frame_id) WHERE depth >= coalesce(core.lo, al.lo) - 0.1 AND depth <= coalesce(core.hi, al.hi) + 0.1""")
def depth_core(spark, sf_dir):
    return evidence.depth_core(mask_cells(spark, sf_dir), radius=1, together=True).select("frame_id", "row", "col")


@query("""WITH p AS (SELECT *, object_id % 4 AS room FROM b_points), cam AS (SELECT room, room * 10 + k AS frame_id, k * 0.1 AS shift FROM range(4) r(room), range(3) c(k)),
pr AS (SELECT p.object_id, cam.frame_id, 20 * (x + shift) / (z + 1.2) + 20 AS u, 20 * y / (z + 1.2) + 20 AS v, z + 1.2 AS d FROM p JOIN cam USING (room)),
s AS (SELECT *, d > 0 AND u >= 0 AND u < 39.5 AND v >= 0 AND v < 39.5 AND NOT (CASE WHEN d > 0 AND u >= 0 AND u < 39.5 AND v >= 0 AND v < 39.5 THEN 1.0 + CAST(round_even(u, 0) AS INT) % 5 * 0.1 ELSE 1e9 END < d - 0.1) AS ok FROM pr)
SELECT object_id, frame_id FROM (SELECT object_id, frame_id, count(*) AS n, count(*) FILTER (WHERE ok) AS k, (max(u) FILTER (WHERE ok) - min(u) FILTER (WHERE ok)) * (max(v) FILTER (WHERE ok) - min(v) FILTER (WHERE ok)) AS area FROM s GROUP BY ALL) WHERE k >= 2 AND k >= 0.25 * n AND area >= 0.005 * 1600""")
def line_of_sight(spark, sf_dir):
    p = bridge.points(spark, sf_dir).withColumn("room", F.col("object_id") % 4)
    cams = spark.range(12).select((F.floor(F.col("id") / 3)).alias("room"), (F.floor(F.col("id") / 3) * 10 + F.col("id") % 3).alias("frame_id"), (F.col("id") % 3 * 0.1).alias("shift"))
    one, zero = F.lit(1.0), F.lit(0.0)
    cams = cams.select("room", "frame_id", F.array(one, zero, zero, F.col("shift"), zero, one, zero, zero, zero, zero, one, F.lit(1.2), zero, zero, zero, one).alias("m"), *(F.lit(20.0).alias(c) for c in ("fx", "fy", "cx", "cy")))
    depths = spark.range(1600).select((F.floor(F.col("id") / 40)).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col")).join(cams.select("frame_id")).select("frame_id", "row", "col", (F.lit(1.0) + F.col("col") % 5 * 0.1).alias("depth"))
    return evidence.line_of_sight(p, cams, depths, 40, 40, most=10**9)
