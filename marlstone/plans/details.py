"""Smaller operators and scalar functions as queries, with their SQL. Importing this adds them to the catalog."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import align, answering, evidence, facts, leveling, links, objects, scoring, spatial, temporal
from ..sources import bridge, readers
from .catalog import _D, _HAS, _NAMED, _PAIR, _SCORED, clouds, micro, named_objects, query


@query("SELECT event_id, value FROM events WHERE value >= 10")
def confidence_filter(spark, sf_dir):
    return evidence.confident(bridge.table(spark, sf_dir, "events"), "value", 10.0).select("event_id", "value")


@query("SELECT l_partkey AS object_id, count(*) AS n FROM lineitem WHERE l_discount > 0 AND l_tax >= 0.04 AND l_discount < 10 GROUP BY l_partkey")
def pixel_validity(spark, sf_dir):
    rows = evidence.valid_pixels(bridge.table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 0.04, 10.0)
    return rows.groupBy(F.col("l_partkey").alias("object_id")).agg(F.count("*").alias("n"))


@query("SELECT query_id, family FROM b_results WHERE starts_with(family, 'mc_query_urgent') AND query_id % 3 = 0 ORDER BY query_id LIMIT 100")
def query_subset(spark, sf_dir):
    r = bridge.results(spark, sf_dir)
    return scoring.query_subset(r, "mc_query_urgent", r.where("query_id % 3 = 0").select("query_id"), 100).select("query_id", "family")


_SCORES = "(SELECT object_id, label, CAST(sum(cents) AS BIGINT) AS score, min(seq) AS first_seq FROM b_votes GROUP BY object_id, label)"


@query(f"SELECT object_id, label, rank, CAST(floor(score / top::DOUBLE * 1e6 + 0.5) AS BIGINT) AS share_ppm FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY score DESC, first_seq, label) AS rank, max(score) OVER (PARTITION BY object_id) AS top FROM {_SCORES}) WHERE rank BETWEEN 2 AND 5 AND top > 0")
def runner_up_ranking(spark, sf_dir):
    ranked = evidence.runners_up(evidence.label_scores(bridge.votes(spark, sf_dir), "cents", "seq"))
    return ranked.select("object_id", "label", "rank", micro("share").alias("share_ppm"))


@query("SELECT object_id, CASE WHEN label IN ('class_0', 'class_1', 'class_2') THEN 'furniture' ELSE label END AS label, label IN ('class_0', 'class_1', 'class_2') AS mapped FROM b_objects")
def label_mapping(spark, sf_dir):
    mapping = spark.createDataFrame([(f"class_{i}", "furniture") for i in range(3)], "raw_label string, canonical_label string")
    return readers.mapped_labels(bridge.objects(spark, sf_dir).select("object_id", "label"), mapping)


@query("SELECT t.episode, t.turn, CASE WHEN t.turn % 2 = 0 AND t.role = 'user' THEN t.turn + 1000 ELSE t.turn END AS mapped FROM b_turns t")
def turn_id_map(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    ids = t.where("turn % 2 = 0 and role = 'user'").select("episode", "turn", (F.col("turn") + 1000).alias("other"))
    return temporal.renamed_turns(t, ids).select("episode", "turn", "mapped")


@query("SELECT clip, frame FROM (SELECT object_id AS clip, idx AS frame, row_number() OVER (PARTITION BY object_id, round(x, 1), round(y, 1) ORDER BY idx) AS n FROM b_points WHERE idx % 4 <> 0) WHERE n = 1")
def shared_camera_frames(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    recon = p.select(F.col("object_id").alias("clip"), F.col("idx").alias("frame"), "x", "y", F.lit(0.0).alias("z"))
    return align.shared_poses(recon, recon.where("frame % 4 <> 0"), decimals=1).select("clip", "frame")


@query("SELECT episode, frame // 60 AS minute, min(turn) AS turn FROM b_turns WHERE role = 'user' GROUP BY ALL")
def first_user_turns(spark, sf_dir):
    return temporal.first_user_turns(bridge.turns(spark, sf_dir), 60)


@query("SELECT object_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n FROM b_points) WHERE i % CAST(ceil(n / 10.0) AS INT) = 0")
def strided_points(spark, sf_dir):
    return evidence.strided(bridge.points(spark, sf_dir), 10).select("object_id", "idx")


@query("SELECT sequence_id, chunk, \"end\", nxt AS next FROM (SELECT *, lead(first) OVER (PARTITION BY sequence_id ORDER BY first) AS nxt FROM (SELECT sequence_id, position // 10 AS chunk, min(position) AS first, max(position) + 1 AS \"end\" FROM b_frames WHERE position // 10 % 4 <> 2 GROUP BY ALL)) WHERE nxt <> \"end\"")
def chunk_gaps(spark, sf_dir):
    frames = bridge.frames(spark, sf_dir).where("floor(position / 10) % 4 <> 2")
    return temporal.chunk_gaps(temporal.chunked(frames, 10)).select("sequence_id", "chunk", "end", "next")


@query("""WITH m AS (SELECT label AS object_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT object_id, sqrt(sum(m * m)) + 1e-9 AS n FROM m GROUP BY object_id)
SELECT object_id, i, CAST(floor(1e5 * m / n + 0.5) AS BIGINT) AS d FROM m JOIN n USING (object_id)""")
def mean_direction(spark, sf_dir):
    v = bridge.table(spark, sf_dir, "embeddings").select(F.col("label").alias("object_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    rows = evidence.mean_directions(v).select("object_id", F.posexplode("direction").alias("i", "d"))
    return rows.select("object_id", (F.col("i") + 1).cast("long").alias("i"), F.floor(F.col("d") * 1e5 + 0.5).cast("long").alias("d"))


@query("SELECT object_id, CAST(floor(1e5 * atan2(s, c) / 4 + 0.5) AS BIGINT) AS heading, CAST(floor(1e5 * sqrt(s * s + c * c) / w + 0.5) AS BIGINT) AS agreement FROM (SELECT object_id, sum((1 + abs(z)) * sin(4 * atan2(y, x))) AS s, sum((1 + abs(z)) * cos(4 * atan2(y, x))) AS c, sum(1 + abs(z)) AS w FROM b_points GROUP BY object_id)")
def heading_agreement(spark, sf_dir):
    rows = leveling.headings(bridge.points(spark, sf_dir).select("object_id", F.atan2("y", "x").alias("angle"), (1 + F.abs("z")).alias("weight")))
    return rows.select("object_id", F.floor(1e5 * F.col("heading") + 0.5).cast("long").alias("heading"), F.floor(1e5 * F.col("agreement") + 0.5).cast("long").alias("agreement"))


@query("SELECT object_id, CAST(round_even(quantile_cont(z, 0.01) / 0.05, 0) AS BIGINT) AS steps FROM b_points GROUP BY object_id")
def floor_height(spark, sf_dir):
    return leveling.floor_steps(bridge.points(spark, sf_dir)).select("object_id", "steps")


@query("SELECT p_partkey AS id, CAST(floor(1e6 * ((p_size - 25.5) / 30.0 * p_retailprice) + 0.5) AS BIGINT) AS x, CAST(floor(1e6 * ((p_partkey % 40 - 20.0) / 30.0 * p_retailprice) + 0.5) AS BIGINT) AS y FROM part")
def unprojected_points(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "part")
    x, y, _ = G.unprojected(F.col("p_size"), F.col("p_partkey") % 40, F.col("p_retailprice"), F.lit(30.0), F.lit(30.0), F.lit(25.5), F.lit(20.0))
    return p.select(F.col("p_partkey").alias("id"), micro(x).alias("x"), micro(y).alias("y"))


@query("SELECT idx, CAST(floor(1e6 * (0.0 * x + -1.0 * y + 0.0 * z + 2.0) + 0.5) AS BIGINT) AS x, CAST(floor(1e6 * (1.0 * x + 0.0 * y + 0.0 * z + 3.0) + 0.5) AS BIGINT) AS y, CAST(floor(1e6 * (0.0 * x + 0.0 * y + 1.0 * z + 4.0) + 0.5) AS BIGINT) AS z FROM b_points")
def rigid_apply(spark, sf_dir):
    m = F.array(*(F.lit(float(v)) for v in (0, -1, 0, 2, 1, 0, 0, 3, 0, 0, 1, 4, 0, 0, 0, 1)))
    new = G.applied(m, F.col("x"), F.col("y"), F.col("z"))
    return bridge.points(spark, sf_dir).select("idx", *(micro(c).alias(n) for c, n in zip(new, "xyz")))


@query("SELECT object_id, " + ", ".join(f"CAST(floor(1e6 * {f}({lo}, {hi}) + 0.5) AS BIGINT) AS {n}" for n, f, lo, hi in (("x0", "least", "-2 * y0 + 1", "-2 * y1 + 1"), ("x1", "greatest", "-2 * y0 + 1", "-2 * y1 + 1"), ("y0", "least", "2 * x0 + 2", "2 * x1 + 2"), ("y1", "greatest", "2 * x0 + 2", "2 * x1 + 2"), ("z0", "least", "2 * z0 + 3", "2 * z1 + 3"), ("z1", "greatest", "2 * z0 + 3", "2 * z1 + 3"))) + " FROM b_objects")
def transformed_boxes(spark, sf_dir):
    o = bridge.objects(spark, sf_dir).withColumnRenamed("room", "clip")
    fit = o.select("clip").distinct().select("clip", F.lit(2.0).alias("scale"), F.array(*(F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1))).alias("rotation"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("shift"))
    return align.transformed_boxes(o, fit).select("object_id", *(micro(f"{a}{i}").alias(f"{a}{i}") for a in "xyz" for i in (0, 1)))


@query("SELECT object_id, printf('%04d_%02d#%d', 474 + room, room, object_id) AS ref FROM b_objects WHERE object_id % 5 <> 0")
def object_refs(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    said = F.when(F.col("object_id") % 5 == 0, "no such thing").otherwise(F.format_string("Scene %04d_%02d # %d", F.col("room") + 474, "room", "object_id"))
    return o.select("object_id", T.object_ref(said).alias("ref")).where("ref is not null")


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '(^|[^a-z0-9_])thes?($|[^a-z0-9_])')) AS BIGINT) AS n FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])thes?($|[^a-z0-9_])')")
def class_phrase_counts(spark, sf_dir):
    d = bridge.table(spark, sf_dir, "documents")
    return d.where(T.names_class(F.col("text"), F.lit("the"))).select("doc_id", F.regexp_count(F.lower("text"), F.lit("(^|[^a-z0-9_])thes?($|[^a-z0-9_])")).cast("long").alias("n"))


_ANCHOR = "SELECT DISTINCT sequence_id, CAST(floor(i * (n - 1) / greatest(1, least(n, 24) - 1)::DOUBLE) AS BIGINT) AS position FROM (SELECT sequence_id, count(*) AS n FROM b_frames GROUP BY sequence_id), range(24) r(i) WHERE i < least(n, 24)"


@query(_ANCHOR)
def anchor_sample(spark, sf_dir):
    return temporal.anchors(bridge.frames(spark, sf_dir), 24).select("sequence_id", "position")


@query("SELECT object_id % 10 AS object_id, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM (SELECT object_id % 10 AS object_id, label, count(*) AS n FROM b_votes GROUP BY ALL) GROUP BY ALL")
def map_merge_sum(spark, sf_dir):
    merged = evidence.merged_counts(evidence.label_counts(bridge.votes(spark, sf_dir)), F.col("object_id") % 10)
    return merged.select("object_id", F.array_join(F.transform(F.map_entries("counts"), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",").alias("counts"))


@query("""WITH o AS (SELECT sequence_id % 20 AS scene, position, frame_id AS observation_id, event_type AS hint, CAST(floor(value * 10) AS BIGINT) AS n FROM b_frames), s AS (SELECT scene, hint, min(position) AS start FROM o WHERE n >= 500 GROUP BY scene, hint)
SELECT scene, observation_id, hint FROM o JOIN s USING (scene, hint) WHERE n >= 200 AND position >= start""")
def identity_association(spark, sf_dir):
    f = bridge.frames(spark, sf_dir)
    rows = f.select((F.col("sequence_id") % 20).alias("scene"), "position", F.col("frame_id").alias("observation_id"), F.col("event_type").alias("hint"), F.floor(F.col("value") * 10).alias("n_points"))
    return objects.identities(rows)


@query("SELECT r.query_id, r.family, CASE WHEN r.query_id % 4 <> 0 THEN 'evidence' WHEN r.query_id % 8 = 0 THEN 'witness' END AS program FROM b_results r WHERE r.query_id % 7 <> 0")
def query_answer_join(spark, sf_dir):
    r = bridge.results(spark, sf_dir)
    answers = r.where("query_id % 7 <> 0").select("query_id")
    found = r.where("query_id % 4 <> 0").select("query_id", F.lit("evidence").alias("program"))
    witness = r.where("query_id % 8 = 0").select("query_id", F.lit("witness").alias("program"))
    return scoring.with_answers(r.select("query_id", "family"), answers, found, witness).select("query_id", "family", "program")


def _sql_vocabulary() -> str:
    rows = ", ".join(f"('{s}', '{v}', {i})" for s, vs in facts.VOCABULARY.items() for i, v in enumerate(vs))
    return f"voc(slot, value, position) AS (VALUES {rows})"


_SLOTS = "['" + "', '".join(facts.VOCABULARY) + "']"
_FACTS = f"{_sql_vocabulary()}, f AS (SELECT event_id AS turn, (event_id % 25) * 20 + user_id % 20 AS object_id, {_SLOTS}[event_id % 13 + 1] AS slot, (SELECT any_value(value) FROM voc WHERE slot = {_SLOTS}[(event_id * 3) % 13 + 1] AND position = 0) AS value FROM events)"


def slot_facts(spark, sf_dir):
    """Facts of each event: a slot, and the first value of some slot, which is not always its own."""
    names = F.array(*map(F.lit, facts.VOCABULARY))
    firsts = F.array(*(F.lit(v[0]) for v in facts.VOCABULARY.values()))
    e, k = bridge.table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(k.alias("turn"), ((k % 25) * 20 + F.col("user_id") % 20).alias("object_id"), F.element_at(names, (k % 13 + 1).cast("int")).alias("slot"), F.element_at(firsts, ((k * 3) % 13 + 1).cast("int")).alias("value"))


@query(f"WITH {_FACTS} SELECT turn, object_id, slot, value FROM f WHERE EXISTS (SELECT 1 FROM voc v WHERE v.slot = f.slot AND v.value = f.value)")
def facts_in_vocabulary(spark, sf_dir):
    return facts.in_vocabulary(slot_facts(spark, sf_dir)).select("turn", "object_id", "slot", "value")


@query(f"WITH {_FACTS} SELECT DISTINCT object_id FROM f WHERE value IN ('keep accessible', 'leave out') AND slot = 'access_state' AND turn < 8000")
def facts_stated(spark, sf_dir):
    return facts.stated(slot_facts(spark, sf_dir), "access_state", ("keep accessible", "leave out"), 8000)


@query("SELECT l.episode, l.turn, l.object_id + 1000 AS object_id FROM b_gold l WHERE l.object_id IN (SELECT object_id FROM b_objects WHERE object_id % 3 <> 0)")
def replayed_links(spark, sf_dir):
    other = bridge.objects(spark, sf_dir).where("object_id % 3 <> 0").select("object_id", (F.col("object_id") + 1000).alias("other_id"))
    return links.replayed(bridge.links(spark, sf_dir, gold=True), other).select("episode", "turn", "object_id")


@query("SELECT sequence_id, frame_id, 'time does not increase' AS fault FROM (SELECT *, lag(t) OVER (PARTITION BY sequence_id ORDER BY position) AS before FROM (SELECT *, CASE WHEN frame_id % 50 = 0 THEN 0.0 ELSE position + 1.0 END AS t FROM b_frames)) WHERE t <= before")
def frame_faults(spark, sf_dir):
    f = bridge.frames(spark, sf_dir).withColumn("timestamp_seconds", F.when(F.col("frame_id") % 50 == 0, 0.0).otherwise(F.col("position") + 1.0))
    return temporal.frame_faults(f).select("sequence_id", "frame_id", "fault")


@query("SELECT room, frame, max(source) AS source FROM (SELECT room, f AS source, unnest(range(greatest(0, f - 3), f + 3)) AS frame FROM (SELECT DISTINCT room, frame * 5 AS f FROM b_sightings)) GROUP BY ALL")
def widened_cameras(spark, sf_dir):
    cameras = bridge.sightings(spark, sf_dir).select("room", (F.col("frame") * 5).alias("frame")).distinct()
    return temporal.widened_cameras(cameras)


@query("SELECT episode, turn, '{\"a\": ' || turn || '}' AS answer FROM b_turns WHERE FALSE UNION ALL SELECT episode, turn, CAST(turn AS VARCHAR) FROM b_turns WHERE turn % 3 <> 2")
def answer_parse(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"answer": '), "turn", F.lit("}"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('I think {"x": {}} so {"answer": '), "turn", F.lit("} ok"))).otherwise("nothing")
    return t.select("episode", "turn", T.answer_json(reply).alias("answer")).where("answer is not null")


@query("SELECT CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS shared, CAST(count(*) FILTER (WHERE a IS NOT NULL) AS BIGINT) AS only_a FROM b_results")
def paired_runs(spark, sf_dir):
    return scoring.shared_queries(bridge.results(spark, sf_dir))


_TYPED = "t AS (SELECT *, ['count', 'bool', 'track'][query_id % 3 + 1] AS kind, query_id % 5 < 3 AS correct FROM b_results)"


@query(f"WITH {_TYPED}, g AS (SELECT 'all' AS \"grouping\", '' AS value, correct FROM t WHERE official UNION ALL SELECT 'family', family, correct FROM t WHERE official UNION ALL SELECT 'session', CAST(session AS VARCHAR), correct FROM t WHERE official UNION ALL SELECT 'answer_type', kind, correct FROM t WHERE official) SELECT \"grouping\", value, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(floor(1000.0 * sum(CAST(correct AS INT)) / count(*) + 0.5) AS BIGINT) AS accuracy_milli FROM g GROUP BY ALL")
def accuracy_table(spark, sf_dir):
    k = F.col("query_id")
    rows = bridge.results(spark, sf_dir).withColumn("answer_type", F.element_at(F.array(*map(F.lit, ("count", "bool", "track"))), (k % 3 + 1).cast("int"))).withColumn("correct", k % 5 < 3)
    return scoring.accuracy_table(rows).select("grouping", "value", "n", "correct", F.floor(F.col("accuracy") * 1000 + 0.5).cast("long").alias("accuracy_milli"))


_RUN = "SELECT session AS configuration, query_id, query_id % 7 < 4 AS correct FROM b_results"


@query(f"WITH a AS ({_RUN}), b AS (SELECT configuration, query_id, query_id % 5 < 3 AS base FROM a WHERE query_id % 3 <> 0) SELECT configuration, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(base) AS paired, CAST(floor(100000.0 * (sum(CAST(correct AS INT)) FILTER (WHERE base IS NOT NULL) - sum(CAST(base AS INT))) / count(base) + 0.5) AS BIGINT) AS points_milli, true AS within FROM a LEFT JOIN b USING (configuration, query_id) GROUP BY configuration")
def run_report(spark, sf_dir):
    r = bridge.results(spark, sf_dir).select(F.col("session").alias("configuration"), "query_id", (F.col("query_id") % 7 < 4).alias("correct"), F.lit("a").alias("path"), F.lit(1).alias("line"))
    base = r.where("query_id % 3 <> 0").withColumn("correct", F.col("query_id") % 5 < 3)
    out = scoring.run_report(r, base)
    return out.select("configuration", "n", "correct", "paired", F.floor(F.col("points") * 1000 + 0.5).cast("long").alias("points_milli"), ((F.col("low") <= F.col("points")) & (F.col("points") <= F.col("high"))).alias("within"))


@query(f"WITH {_SCORED} SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in links.LINK_COUNTS) + " FROM sc")
def link_score_total(spark, sf_dir):
    scores = links.link_scores(bridge.links(spark, sf_dir, gold=False), bridge.links(spark, sf_dir, gold=True))
    return links.link_score_total(scores).select(*links.LINK_COUNTS)


@query("SELECT episode, turn FROM b_turns WHERE role <> 'user'")
def without_questions(spark, sf_dir):
    t = bridge.turns(spark, sf_dir)
    return links.without_questions(t, t.where("role = 'user'")).select("episode", "turn")


@query(f"WITH {_NAMED} SELECT DISTINCT t.episode, t.turn FROM b_turns t JOIN named n ON t.room = n.room WHERE {_HAS}")
def mentioned_turns(spark, sf_dir):
    return links.mentioned(bridge.turns(spark, sf_dir), named_objects(spark, sf_dir))


@query(f"""WITH s AS (SELECT episode, any_value(room) AS room, max(frame) FILTER (WHERE role <> 'user') AS last FROM b_turns GROUP BY episode),
fst AS (SELECT room, object_id, min(frame) AS first FROM b_sightings GROUP BY ALL),
lst AS (SELECT s.episode, o.* FROM s JOIN fst USING (room) JOIN b_objects o USING (room, object_id) WHERE fst.first <= coalesce(s.last, 0) + 60),
inv AS (SELECT episode, string_agg(printf('  %s #%d', label, object_id), chr(10) ORDER BY label, object_id) AS inv FROM lst GROUP BY episode),
v AS (SELECT DISTINCT t.episode, t.turn, l.object_id, l.label FROM b_turns t JOIN b_sightings g ON g.room = t.room AND abs(g.frame - t.frame) <= 60 JOIN lst l ON l.episode = t.episode AND l.object_id = g.object_id WHERE t.role <> 'user'),
sv AS (SELECT episode, turn, string_agg(label || ' #' || object_id, ', ' ORDER BY object_id) AS view FROM v GROUP BY ALL),
dlg AS (SELECT episode, string_agg('[' || turn || '] ' || role || ' (in view: ' || coalesce(view, 'nothing') || '): ' || text, chr(10) ORDER BY turn) AS dlg FROM b_turns LEFT JOIN sv USING (episode, turn) WHERE role <> 'user' GROUP BY episode)
SELECT episode, md5(concat_ws(chr(10), 'Room ' || room || ' (day 1, room). Objects:', inv, '', 'Turns:', dlg)) AS prompt_md5 FROM s LEFT JOIN inv USING (episode) LEFT JOIN dlg USING (episode)""")
def session_prompts(spark, sf_dir):
    t = bridge.turns(spark, sf_dir).select("episode", F.lit(1).alias("session"), "turn", "frame", F.col("role").alias("speaker"), "text", "room")
    sessions = t.groupBy("episode", "session").agg(F.min("room").alias("room")).select("*", F.lit(1).alias("day"), F.lit("room").alias("gloss"))
    objects_ = bridge.objects(spark, sf_dir).withColumn("alternatives", F.array().cast("array<string>"))
    asked = links.session_prompts(sessions, t.drop("room"), t.where("speaker = 'user'"), objects_, bridge.sightings(spark, sf_dir), 60)
    # Centroids and sizes are tested apart: two engines may round a half differently.
    bare = F.regexp_replace("prompt", r"(?m)^(  .* #\d+)   centroid \[.*$", "$1")
    return asked.select("episode", F.md5(bare).alias("prompt_md5"))


_RUNS = """r AS (SELECT query_id, official, ['count', 'bool', 'track'][query_id % 3 + 1] AS kind, family, session, query_id % 5 < 3 AS correct, CAST(query_id % 9 AS VARCHAR) AS pred, CASE WHEN query_id % 4 > 0 THEN query_id % 7 END AS work_true,
query_id % 2 = 0 AS from_work, CASE WHEN query_id % 11 > 0 THEN query_id % 5000 END AS tokens, query_id % 6 = 0 AS cached, CASE WHEN query_id % 19 = 0 THEN 'ERROR: 1' ELSE '' END AS raw FROM b_results)"""
_WORK = "official AND kind = 'count'"


@query(f"""WITH {_RUNS}, g AS (SELECT 'all' AS "grouping", '' AS value, correct FROM r UNION ALL SELECT 'official', '', correct FROM r WHERE official UNION ALL SELECT 'track', '', correct FROM r WHERE kind = 'track'
UNION ALL SELECT 'family', family, correct FROM r WHERE official UNION ALL SELECT 'session', CAST(session AS VARCHAR), correct FROM r WHERE official)
SELECT "grouping", value, count(*) AS n, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS correct FROM g GROUP BY ALL
UNION ALL SELECT 'work_list', '', count(*) FILTER (WHERE {_WORK}), count(*) FILTER (WHERE {_WORK} AND from_work) FROM r
UNION ALL SELECT 'work_list_differs', '', count(*) FILTER (WHERE {_WORK} AND CAST(work_true AS VARCHAR) <> pred), NULL FROM r
UNION ALL SELECT 'mean_prompt_tokens', '', CAST(floor(sum(coalesce(tokens, 0)) / count(*)) AS BIGINT), NULL FROM r UNION ALL SELECT 'most_prompt_tokens', '', CAST(max(tokens) AS BIGINT), NULL FROM r
UNION ALL SELECT 'cached', '', count(*) FILTER (WHERE cached), NULL FROM r UNION ALL SELECT 'errors', '', count(*) FILTER (WHERE raw <> ''), NULL FROM r""")
def run_summary(spark, sf_dir):
    k = F.col("query_id")
    rows = bridge.results(spark, sf_dir).select(
        "query_id", "official", F.element_at(F.array(*map(F.lit, ("count", "bool", "track"))), (k % 3 + 1).cast("int")).alias("answer_type"), "family", "session", (k % 5 < 3).alias("correct"), (k % 9).cast("string").alias("pred"),
        F.when(k % 4 > 0, k % 7).alias("work_true"), (k % 2 == 0).alias("correct_from_work"), F.when(k % 11 > 0, k % 5000).alias("prompt_tokens"), (k % 6 == 0).alias("cached"), F.when(k % 19 == 0, "ERROR: 1").otherwise("").alias("raw"),
    )
    return scoring.run_summary(rows).select("grouping", "value", "n", "correct")


@query("SELECT doc_id, CASE WHEN length(text) >= 4000 THEN md5(text || chr(10)) END AS prefix_md5, CASE WHEN length(text) >= 4000 THEN md5('=== session 2' || chr(10) || 'now') ELSE md5(text || chr(10) || '=== session 2' || chr(10) || 'now') END AS rest_md5 FROM documents")
def context_prefix(spark, sf_dir):
    """Each document as what a context has before the session of the question."""
    prefix, rest = T.split_prefix(F.concat("text", F.lit("\n=== session 2\nnow")))
    return bridge.table(spark, sf_dir, "documents").select("doc_id", F.md5(prefix).alias("prefix_md5"), F.md5(rest).alias("rest_md5"))


@query("SELECT b.query_id, c.configuration FROM b_results b, (VALUES ('memory', 0), ('memory_annotated_links', 1), ('full_context', 2), ('per_frame', 3)) c(configuration, i) WHERE b.query_id % 4 <> c.i OR b.query_id % 5 = 0")
def benchmark_plan(spark, sf_dir):
    """A quarter of the queries is done in each configuration, some with errors."""
    r, k = bridge.results(spark, sf_dir).select("query_id"), F.col("query_id")
    names = F.array(*(F.lit(c[0]) for c in answering.CONFIGURATIONS))
    done = r.select("query_id", F.element_at(names, (k % 4 + 1).cast("int")).alias("configuration"), F.when(k % 5 == 0, "ERROR: 5").otherwise("{}").alias("raw"))
    return answering.benchmark_plan(r, done).select("query_id", "configuration")


@query("SELECT query_id, '\"' || family || '\"' AS pred, query_id % 3 = 0 AS cached FROM b_results")
def cached_answers(spark, sf_dir):
    """The prompts of a third of the queries have known replies; an injected model that echoes gives the others."""
    r = bridge.results(spark, sf_dir).select("query_id", F.concat_ws(" ", F.col("query_id"), F.col("family")).alias("prompt"), "family")
    plan = r.select("query_id", F.lit("full").alias("method"), F.lit(None).cast("string").alias("links"))
    contexts = plan.join(r.select("query_id", "prompt"), "query_id")
    reply = F.to_json(F.struct(F.col("family").alias("answer")))
    cache = r.where("query_id % 3 = 0").select(T.short_hash(F.lit("m"), F.col("prompt")).alias("cache_key"), reply.alias("raw"))
    return answering.answers(plan, contexts, cache, echo, "m").select("query_id", "pred", "cached")


def echo(prompt: str) -> str:
    return json.dumps({"answer": prompt.split(" ", 1)[1]})


_SAID = """m AS (SELECT episode, turn, CASE WHEN turn % 5 = 0 THEN 'place' ELSE 'physical_object' END AS kind, ['resolved', 'clarified', 'open'][(episode + turn) % 3 + 1] AS status, CASE WHEN turn % 7 <> 3 THEN 't' || (turn % 4) END AS track, turn % 2 = 0 AS fact_bearing FROM b_turns WHERE episode % 4 <> 0),
e AS (SELECT episode, turn, 't' || (turn % 3) AS track, turn % 3 + 10 AS object_id FROM b_turns), tr AS (SELECT DISTINCT episode, track, object_id FROM e)"""


@query(f"""WITH {_SAID}, g AS (SELECT m.episode, turn, object_id, fact_bearing, 'log' AS source FROM m JOIN tr USING (episode, track) WHERE kind = 'physical_object' AND status <> 'open'
UNION ALL SELECT m.episode, turn, object_id, true, 'log' FROM m JOIN tr USING (episode, track) WHERE status = 'resolved'
UNION ALL SELECT episode, turn, object_id, true, 'evidence' FROM e WHERE episode % 4 = 0)
SELECT episode, turn, object_id, bool_or(fact_bearing) AS fact_bearing, min(source) AS source FROM g GROUP BY ALL""")
def release_links(spark, sf_dir):
    """Logs of three quarters of the episodes, whose turns have other ids there; evidence of all."""
    t, k = bridge.turns(spark, sf_dir).select("episode", "turn"), F.col("turn")
    status = F.element_at(F.array(*map(F.lit, ("resolved", "clarified", "open"))), ((F.col("episode") + k) % 3 + 1).cast("int"))
    logged = t.where("episode % 4 <> 0").select("episode", (k + 1000).alias("turn"), F.when(k % 5 == 0, "place").otherwise("physical_object").alias("mention_type"), status.alias("status"), F.when(k % 7 != 3, F.concat(F.lit("t"), k % 4)).alias("track_id"), F.lit("it").alias("span"), (k % 2 == 0).alias("fact_bearing"))
    records = logged.select("episode", "turn", F.when(F.col("status") == "resolved", "established").alias("status"), "track_id")
    facts_ = t.select("episode", "turn", F.concat(F.lit("t"), k % 3).alias("track_id"), F.lit("0474_03-full").alias("clip_id"), (k % 3 + 10).alias("object_id"))
    ids = t.select("episode", (k + 1000).alias("turn"), k.alias("other"))
    return links.release_links(logged, records, facts_, t, ids).select("episode", "turn", "object_id", "fact_bearing", "source")


@query("SELECT p_partkey AS id, p_size % 2 = 0 AS leveling, p_size % 3 = 0 AS resize, CAST(floor(1e6 * (p_retailprice - 2.0)) AS BIGINT) AS x FROM part")
def transform_checks(spark, sf_dir):
    """A quarter turn with a lift, and a sideways shift for odd sizes; a mapping that scales, or shears; a point there and back."""
    p = bridge.table(spark, sf_dir, "part")
    n = lambda *v: F.array(*(x if isinstance(x, Column) else F.lit(float(x)) for x in v))
    turn = n(0, -1, 0, F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(1.0), 1, 0, 0, 0, 0, 0, 1, 2, 0, 0, 0, 1)
    scale = n(2, F.when(F.col("p_size") % 3 == 0, 0.0).otherwise(0.5), 0, 0, 3, 0, 0, 0, 1)
    back = G.composed(G.inverted(turn), G.composed(turn, n(1, 0, 0, -2, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)))
    rows = p.select("p_partkey", "p_retailprice", turn.alias("turn"), scale.alias("scale"), back.alias("back"))
    x = G.applied(F.col("back"), F.col("p_retailprice"), F.lit(0.0), F.lit(0.0))[0]
    return rows.select(F.col("p_partkey").alias("id"), G.is_leveling(F.col("turn")).alias("leveling"), G.is_resize(F.col("scale")).alias("resize"), F.floor(1e6 * x).cast("long").alias("x"))


@query("SELECT room, object_id, min(frame) AS first_frame, CAST(floor(min(frame) * 0.5 * 1e6 + 0.5) AS BIGINT) AS px FROM b_sightings GROUP BY ALL HAVING min(frame) % 3 <> 1")
def standing_points(spark, sf_dir):
    """A third of the frames has no pose."""
    s = bridge.sightings(spark, sf_dir)
    cameras = s.where("frame % 3 <> 1").select("room", "frame", (F.col("frame") * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(1.5).alias("z")).distinct()
    return temporal.standing_points(s, cameras).select("room", "object_id", "first_frame", micro("px").alias("px"))


@query("SELECT DISTINCT room, object_id, frame FROM b_sightings WHERE frame % 2 = 0 OR frame % 3 = 0")
def seen_either_way(spark, sf_dir):
    s = bridge.sightings(spark, sf_dir)
    return temporal.seen_either_way(s.where("frame % 2 = 0"), s.where("frame % 3 = 0"))


@query("SELECT object_id, room FROM b_objects WHERE room % 3 = 0")
def room_scope(spark, sf_dir):
    o = bridge.objects(spark, sf_dir)
    rooms = o.select("room").distinct().withColumn("gloss", F.when(F.col("room") % 3 == 0, "Kitchen ").otherwise("hall"))
    return spatial.in_named_rooms(o, rooms, "kitchen").select("object_id", "room")


@query(f"SELECT a.room, a.object_id AS a_id, b.object_id AS b_id, CAST(floor((1.25 - {_D}) * 1e6 + 0.5) AS BIGINT) AS margin_um, abs(1.25 - {_D}) <= 0.25 AS open {_PAIR} WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz) <= 2.25")
def near_margin(spark, sf_dir):
    """Pairs up to a slack beyond a threshold of 1.25, with how far each is from it."""
    rows = spatial.with_margin(spatial.near_pairs(bridge.objects(spark, sf_dir), 1.5), "distance", 1.25, 0.25)
    return rows.select("room", "a_id", "b_id", micro("margin").alias("margin_um"), "open")


@query()
def constructed_objects(spark, sf_dir):
    """Objects of every scene's point clouds, from association to tightened boxes."""
    things, _ = objects.constructed(clouds(spark, sf_dir), least_observations=1)
    return things.select("scene", "object_id", "label", "n_observations", "n")


@query("SELECT DISTINCT room, 'floor' AS source, TRUE AS upright, TRUE AS on_floor FROM b_objects")
def level_scene(spark, sf_dir):
    """A floor and two walls in every room, tilted by an angle of its own; whether leveling turns them back."""
    rooms = bridge.objects(spark, sf_dir).select("room").distinct().withColumn("tilt", 0.05 + F.col("room") / 100)
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    grid = rooms.select("*", side(50).alias("i")).select("*", side(50).alias("j"))
    step = lambda c: F.col(c) * 0.08
    low = grid.where("j <= 30")
    nothing = F.lit(0.0)
    sheets = [grid.select("room", "tilt", step("i"), step("j"), nothing), low.select("room", "tilt", nothing, step("i"), step("j")), low.select("room", "tilt", step("i"), nothing, step("j"))]
    points = reduce(DataFrame.union, sheets).toDF("room", "tilt", "x", "y", "z")
    sin, cos = F.sin("tilt"), F.cos("tilt")
    tilted = lambda df: df.select(F.col("room").alias("scene"), "x", (F.col("y") * cos - F.col("z") * sin).alias("y"), (F.col("y") * sin + F.col("z") * cos).alias("z"), nothing.alias("ux"), (-sin).alias("uy"), cos.alias("uz"))
    cameras = rooms.select("room", "tilt", side(9).alias("i")).select("room", "tilt", (1 + step("i")).alias("x"), F.lit(2.0).alias("y"), F.lit(1.4).alias("z"))
    found = leveling.leveled(tilted(points).select("scene", "x", "y", "z"), tilted(cameras))
    m = lambda i: F.col("transform")[i]
    both = found.join(rooms.withColumnRenamed("room", "scene"), "scene")
    middle = m(9) * 2 * cos + m(10) * 2 * sin + m(8) * 2 + m(11)
    return both.select(F.col("scene").alias("room"), "source", (m(10) * cos - m(9) * sin > 0.9999).alias("upright"), (F.abs(middle) < 0.03).alias("on_floor"))
