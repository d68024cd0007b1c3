"""Context tables for a question, as lines with their order; `rendered` joins them into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import alternatives_suffix, mention_mark
from ..operators.temporal import observation_grid


def last_frames(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """question_id, session, room, last, current: the sessions up to a question's own, each with its last frame.

    questions: question_id, episode, session, turn, frame. turns: episode, session, room, turn, frame, speaker, text.
    """
    ends = turns.groupBy("episode", "session", "room").agg(F.max("frame").alias("end"))
    q = questions.select("question_id", "episode", F.col("session").alias("q_session"), F.col("turn").alias("q_turn"), F.col("frame").alias("q_frame"))
    rows = q.join(ends, "episode").where("session <= q_session")
    current = F.col("session") == F.col("q_session")
    return rows.select("question_id", "episode", "q_turn", "q_frame", "session", "room", current.alias("current"), F.when(current, F.col("q_frame")).otherwise(F.col("end")).alias("last"))


def vector(*columns: str) -> Column:
    return F.format_string("[%.3f, %.3f, %.3f]", *map(F.col, columns))


def seen_objects(scopes: DataFrame, first: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects first sighted up to each scope's last frame, with what describes them."""
    return scopes.join(first, "room").where("first_frame <= last").join(objects, ["room", "object_id"])


def memory_lines(questions: DataFrame, turns: DataFrame, first: DataFrame, objects: DataFrame, links: DataFrame, subject_only: bool = True) -> DataFrame:
    """question_id, session, label, object_id, turn, line: an object's line (turn -1) and those of its earlier turns.

    Only turns before the question count, and, if `subject_only`, only links that bear a fact.
    """
    scopes = last_frames(questions, turns)
    seen = seen_objects(scopes, first, objects)
    alternatives = alternatives_suffix(F.col("alternatives")) if "alternatives" in objects.columns else F.lit("")
    about = F.concat(F.col("label"), alternatives, F.lit(" #"), F.col("object_id"), F.lit("   centroid "), vector("cx", "cy", "cz"), F.lit("   box "), vector("x0", "y0", "z0"), F.lit(" to "), vector("x1", "y1", "z1"), F.lit("   first seen frame "), F.col("first_frame"))
    heads = seen.select("question_id", "session", "label", "object_id", F.lit(-1).cast("long").alias("turn"), about.alias("line"))
    good = links if not subject_only else links.where(F.coalesce("fact_bearing", F.lit(True)))
    said = turns.select("episode", "turn", "speaker", "text").join(good.select("episode", "turn", "object_id", "phrase"), ["episode", "turn"])
    told = seen.select("question_id", "session", "episode", "q_turn", "label", "object_id").join(said, ["episode", "object_id"]).where("turn < q_turn")
    line = F.concat(F.lit("    ["), F.col("turn"), F.lit(" · "), F.col("speaker"), F.lit("] "), mention_mark(F.col("text"), F.col("phrase"), F.col("object_id")))
    return heads.unionByName(told.select("question_id", "session", "label", "object_id", "turn", line.alias("line")))


def full_events(questions: DataFrame, turns: DataFrame, first: DataFrame, objects: DataFrame, sightings: DataFrame) -> DataFrame:
    """question_id, session, frame, rank, seq, line: sightings (0), what is in view (0.5) and turns (1), by frame."""
    scopes = last_frames(questions, turns)
    seen = seen_objects(scopes, first, objects)
    sight = seen.select("question_id", "session", F.col("first_frame").alias("frame"), F.lit(0.0).alias("rank"), F.col("object_id").alias("seq"), F.concat(F.format_string("frame %5d  seen   ", "first_frame"), F.col("label"), F.lit(" #"), F.col("object_id"), F.lit("   centroid "), vector("cx", "cy", "cz")).alias("line"))
    said = scopes.join(turns.drop("room"), ["episode", "session"]).where("turn < q_turn")
    talk = said.select("question_id", "session", "frame", F.lit(1.0).alias("rank"), F.col("turn").alias("seq"), F.concat(F.format_string("frame %5d  %-9s  [", "frame", "speaker"), F.col("turn"), F.lit("] "), F.col("text")).alias("line"))
    users = said.where("speaker = 'user'").groupBy("question_id", "session", "room", "frame").agg(F.min("turn").alias("seq"))
    view = in_view(users, sightings, objects).select("question_id", "session", "frame", F.lit(0.5).alias("rank"), "seq", F.concat(F.format_string("frame %5d  in view: ", "frame"), F.col("visible")).alias("line"))
    return sight.unionByName(view).unionByName(talk)


def in_view(asked: DataFrame, sightings: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows of `asked` (room, frame, ...) with visible: the objects sighted at that frame, in order of id."""
    named = sightings.select("room", "frame", "object_id").distinct().join(objects.select("room", "object_id", "label"), ["room", "object_id"])
    text = named.groupBy("room", "frame").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("object_id", "label"))), lambda o: F.concat(o["label"], F.lit(" #"), o["object_id"].cast("string"))), ", ").alias("visible"))
    return asked.join(text, ["room", "frame"], "left").withColumn("visible", F.coalesce("visible", F.lit("(nothing)")))


def frame_observations(turns: DataFrame, sightings: DataFrame, objects: DataFrame, step: int = 30) -> DataFrame:
    """episode, room, frame, line: one observation per second and at each user turn."""
    grid = observation_grid(turns, step, ("episode", "room"))
    return in_view(grid, sightings, objects).select("episode", "room", "frame", F.concat(F.format_string("frame %5d  ", "frame"), F.col("visible")).alias("line"))


def inventory(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and line: the classes in order, each with its objects' ids."""
    ids = seen.groupBy(*keys, "label").agg(F.concat(F.col("label"), F.lit(" "), F.array_join(F.transform(F.sort_array(F.collect_set("object_id")), lambda i: F.concat(F.lit("#"), i.cast("string"))), " ")).alias("part"))
    return ids.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "part"))), lambda p: p["part"]), "; ").alias("line"))


def day_table(sessions: DataFrame) -> DataFrame:
    """episode, line: `day d = gloss (room r, session s)` of all sessions in order."""
    part = F.concat(F.lit("day "), F.col("day"), F.lit(" = "), F.col("gloss"), F.lit(" (room "), F.col("room"), F.lit(", session "), F.col("session") + 1, F.lit(")"))
    return sessions.groupBy("episode").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("session", part.alias("p")))), lambda s: s["p"]), "; ").alias("line"))


def rendered(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys and text: a question's lines in order, joined by line feeds. A question's context bounds its size."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def numbered(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return lines.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
