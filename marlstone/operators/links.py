"""Links from dialogue turns to objects: rules, merging, gold links, replay and scores."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import alternatives_suffix, is_subject, names_class, quoted, scene_of
from ..sources.shared import written
from .temporal import in_view_band, renamed_turns

#: Sources in order of precedence.
PRECEDENCE = ("log", "compiled", "evidence", "llm", "rule", "llm-verify")


def unique_classes(objects: DataFrame) -> DataFrame:
    """room, label, object_id: classes of which a room has exactly one object."""
    return objects.groupBy("room", "label").agg(F.count("*").alias("n"), F.min("object_id").alias("object_id")).where("n = 1").drop("n")


def rule_links(turns: DataFrame, objects: DataFrame) -> DataFrame:
    """episode, turn, object_id, phrase, fact_bearing: a class that is unique in the room is named in the turn.

    A class phrase after a place word and an article is where something is; the class is the subject if any phrase of
    it is not.
    """
    pairs = turns.join(unique_classes(objects), "room").where(names_class(F.col("text"), F.col("label")))
    return pairs.select("episode", "turn", "object_id", F.col("label").alias("phrase"), is_subject(F.col("text"), F.col("label")).alias("fact_bearing"))


def uncovered_turns(turns: DataFrame, objects: DataFrame, links: DataFrame) -> DataFrame:
    """episode, turn, label (lower case): classes of the room that a turn names and no subject link of the turn covers.

    Of class names that begin at one place the longest counts: a coffee table is no table.
    """
    names = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("label")).alias("n"), "label"))), lambda x: quoted(x["label"]))
    patterns = objects.where(F.length("label") > 0).groupBy("room").agg(F.concat(F.lit(r"(?iU)\b("), F.array_join(names, "|"), F.lit(r")s?\b")).alias("pattern"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(1)), lambda x: F.lower(x)))
    named = turns.join(patterns, "room").select("episode", "turn", F.explode(found).alias("label"))
    subjects = links.where("fact_bearing").select("episode", "turn", "object_id").join(turns.select("episode", "turn", "room"), ["episode", "turn"])
    covered = subjects.join(objects.select("room", "object_id", F.lower("label").alias("label")), ["room", "object_id"]).select("episode", "turn", "label").distinct()
    return named.join(covered, ["episode", "turn", "label"], "left_anti")


def merged_links(links: DataFrame, keys: tuple[str, ...] = ("episode", "turn", "object_id"), precedence: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """One link per turn and object: the first source's phrase and source, fact-bearing if any is."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col("source"))
    first = F.min(F.struct(order.alias("p"), "source", "phrase"))
    return links.groupBy(*keys).agg(F.bool_or("fact_bearing").alias("fact_bearing"), first.alias("f")).select(*keys, "fact_bearing", "f.source", "f.phrase")


def gold_links(links: DataFrame) -> DataFrame:
    """Gold links of three sources; compiled ones bear facts, and evidence counts only where an episode has no log."""
    logged = links.where("source = 'log'").select("episode").distinct()
    other = links.where("source <> 'evidence'").withColumn("fact_bearing", F.col("fact_bearing") | (F.col("source") == "compiled"))
    return merged_links(other.unionByName(links.where("source = 'evidence'").join(logged, "episode", "left_anti")))


def link_scores(learned: DataFrame, gold: DataFrame) -> DataFrame:
    """By episode: n_learned, n_gold, hits, found, wrong_object, precision, recall; of episodes with links on either side.

    n_gold counts the gold links that bear a fact; hits, learned links among all gold ones; found, fact links that were
    learned; wrong_object, fact links that were not although their turn has learned links.
    """
    keys = ["episode", "turn", "object_id"]
    a = learned.select(*keys).distinct().withColumn("l", F.lit(True))
    b = gold.groupBy(*keys).agg(F.bool_or(F.coalesce("fact_bearing", F.lit(False))).alias("f"))
    n = lambda c: F.count(F.when(c, 1))
    turns = a.join(b, keys, "full").groupBy("episode", "turn").agg(n(F.col("l")).alias("n_learned"), n(F.col("f")).alias("n_gold"), n(F.col("l") & F.col("f").isNotNull()).alias("hits"), n(F.col("l") & F.col("f")).alias("found"))
    missed = F.when(F.col("n_learned") > 0, F.col("n_gold") - F.col("found")).otherwise(0)
    out = turns.withColumn("wrong_object", missed).groupBy("episode").agg(*(F.sum(c).alias(c) for c in LINK_COUNTS))
    return with_ratios(out)


LINK_COUNTS = ("n_learned", "n_gold", "hits", "found", "wrong_object")


def with_ratios(counts: DataFrame) -> DataFrame:
    """With precision and recall; nothing in nothing is 0."""
    return counts.select("*", (F.col("hits") / F.greatest(F.lit(1), "n_learned")).alias("precision"), (F.col("found") / F.greatest(F.lit(1), "n_gold")).alias("recall"))


def link_score_total(scores: DataFrame) -> DataFrame:
    """One row: the sums of link_scores over all episodes, with precision and recall of the sums."""
    return with_ratios(scores.agg(*(F.sum(c).alias(c) for c in LINK_COUNTS)))


def mentioned(turns: DataFrame, objects: DataFrame) -> DataFrame:
    """episode, turn: turns that name some class of their room.

    A room's classes are one pattern, so that each turn is searched once, not once a class.
    """
    names = F.array_join(F.array_sort(F.collect_set(quoted(F.col("label")))), "|")
    patterns = objects.where(F.col("label").isNotNull()).groupBy("room").agg(F.concat(F.lit(r"(?iU)\b(?:"), names, F.lit(r")s?\b")).alias("pattern"))
    return turns.join(patterns, "room").where(F.regexp_like("text", F.col("pattern"))).select("episode", "turn").distinct()


def without_questions(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """Turns that are no question of the benchmark."""
    return turns.join(queries.select("episode", "turn").distinct(), ["episode", "turn"], "left_anti")


def session_scope(sessions: DataFrame, turns: DataFrame, queries: DataFrame, objects: DataFrame, sightings: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """A session's turns that are no question, with its room; and its listed objects, with episode and session.

    Listed are the room's objects first seen up to `window` frames after the last of those turns.
    """
    own = without_questions(turns, queries).join(sessions.select("episode", "session", "room"), ["episode", "session"])
    last = sessions.join(own.groupBy("episode", "session").agg(F.max("frame").alias("last")), ["episode", "session"], "left").withColumn("last", F.coalesce("last", F.lit(0)))
    firsts = sightings.groupBy("room", "object_id").agg(F.min("frame").alias("first"))
    seen = last.join(firsts, "room").where(F.col("first") <= F.col("last") + window).select("episode", "session", "room", "object_id")
    return own, seen.join(objects, ["room", "object_id"])


def session_prompts(sessions: DataFrame, turns: DataFrame, queries: DataFrame, objects: DataFrame, sightings: DataFrame, window: int, among: DataFrame | None = None) -> DataFrame:
    """episode, session, room, prompt: the text that a link provider is asked with, one for each session.

    sessions: episode, session, room, day, gloss; turns: episode, session, turn, frame, speaker, text; objects with
    alternatives. The objects of session_scope are listed by label and id with centroid and size to two decimals; then
    each turn that is no question, with the objects in view within `window` frames of it. With `among` (episode, turn)
    these turns alone are shown, after one more empty line, and sessions without such a turn give no prompt.
    """
    own, listed = session_scope(sessions, turns, queries, objects, sightings, window)
    name = F.concat("label", alternatives_suffix(F.col("alternatives")))
    line = F.format_string("  %s #%s   centroid [%.2f, %.2f, %.2f]   size [%.2f, %.2f, %.2f]", name, F.col("object_id").cast("string"), "cx", "cy", "cz", *(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"))
    inventory = listed.groupBy("episode", "session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "object_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("inventory"))

    if among is not None:
        own = own.join(among.select("episode", "turn").distinct(), ["episode", "turn"], "left_semi")
    near = in_view_band(own.select("episode", "session", "room", "turn", "frame"), sightings, window)
    shown = near.join(listed.select("episode", "session", "room", "object_id", "label"), ["episode", "session", "room", "object_id"])
    each = F.transform(F.sort_array(F.collect_list(F.struct("object_id", "label"))), lambda x: F.concat(x["label"], F.lit(" #"), x["object_id"].cast("string")))
    shown = shown.groupBy("episode", "session", "turn").agg(F.array_join(each, ", ").alias("view"))
    said = own.join(shown, ["episode", "session", "turn"], "left")
    spoken = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "speaker", F.lit(" (in view: "), F.coalesce("view", F.lit("nothing")), F.lit("): "), "text")
    dialogue = said.groupBy("episode", "session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", spoken.alias("line")))), lambda x: x["line"]), "\n").alias("dialogue"))

    head = F.concat(F.lit("Room "), F.col("room").cast("string"), F.lit(" (day "), F.col("day").cast("string"), F.lit(", "), "gloss", F.lit("). Objects:"))
    rows = sessions.join(inventory, ["episode", "session"], "left").join(dialogue, ["episode", "session"], "left" if among is None else "inner")
    gap = [F.lit("")] * (1 if among is None else 2)
    return rows.select("episode", "session", "room", F.concat_ws("\n", head, "inventory", *gap, F.lit("Turns:"), "dialogue").alias("prompt"))


def replayed(links: DataFrame, counterparts: DataFrame) -> DataFrame:
    """Links of which the object has a counterpart, on that counterpart. counterparts: object_id, other_id."""
    return links.join(counterparts, "object_id").drop("object_id").withColumnRenamed("other_id", "object_id")


def replay_stats(links: DataFrame, counterparts: DataFrame) -> DataFrame:
    rows = links.join(counterparts, "object_id", "left")
    return rows.groupBy("episode").agg(F.count("other_id").alias("kept"), F.count(F.when(F.col("other_id").isNull(), 1)).alias("dropped"))


def in_domain(links: DataFrame, turns: DataFrame, objects: DataFrame) -> DataFrame:
    """Links whose turn is in the session and whose object is in its room."""
    known = turns.select("episode", "turn", "room")
    return links.join(known, ["episode", "turn"]).join(objects.select("room", "object_id"), ["room", "object_id"], "left_semi").drop("room")


def link_stats(links: DataFrame) -> DataFrame:
    return links.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("objects"), F.countDistinct("episode", "turn").alias("turns"))


def replies(prompts: DataFrame, provider: Callable[[str], list[dict]], turn: str = "bigint", object_id: str = "bigint") -> DataFrame:
    """The columns of `prompts` but the prompt, and links: what an injected provider gives for each.

    A link has turn, object_id and, if it says so, phrase and either fact_bearing or role; without these two it is a
    subject. Links are null where the provider raises ValueError, as it does for a reply that cannot be read.
    """
    keys = [f for f in prompts.schema if f.name != "prompt"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for prompt in batch.pop("prompt"):
                try:
                    said.append(json.dumps(provider(prompt)))
                except ValueError:
                    said.append(None)
            yield batch.assign(reply=said)

    asked = prompts.mapInPandas(ask, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "reply string"]))
    said = F.from_json("reply", f"array<struct<turn: {turn}, object_id: {object_id}, phrase: string, fact_bearing: boolean, role: string>>")
    each = lambda x: F.struct(x["turn"].alias("turn"), x["object_id"].alias("object_id"), F.coalesce(x["phrase"], F.lit("")).alias("phrase"), F.coalesce(x["fact_bearing"], F.coalesce(x["role"], F.lit("subject")) == "subject").alias("fact_bearing"))
    return asked.select(*(f.name for f in keys), F.transform(said, each).alias("links"))


def provided_links(prompts: DataFrame, provider: Callable[[str], list[dict]], source: str = "llm") -> DataFrame:
    """Links that an injected provider gives for each session's prompt: episode, turn, object_id, phrase, fact_bearing, source.

    A session of which the reply cannot be read gives no links.
    """
    return replies(prompts, provider).select("episode", F.inline("links")).withColumn("source", F.lit(source))


def linked_episodes(turns: DataFrame, objects: DataFrame, prompts: DataFrame, provider: Callable[[str], list[dict]], verifier: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Provider links, then rule links, then links of a second pass over turns that stay uncovered; merged.

    Rule links are given for an episode of which a reply could be read, be it an empty one. `linked_sessions` makes the
    prompts itself, and scopes objects and rules to each session.
    """
    domain = lambda x: in_domain(x, turns, objects)
    asked = written(replies(prompts, provider))  # asked once: replies cost, and may differ
    first = domain(asked.select("episode", F.inline("links")).withColumn("source", F.lit("llm")))
    answered = asked.where("links is not null").select("episode").distinct()
    rules = rule_links(turns.join(answered, "episode", "left_semi"), objects).withColumn("source", F.lit("rule"))
    merged = merged_links(first.unionByName(rules.select(*first.columns)))
    if verifier is None:
        return merged
    left = uncovered_turns(turns.join(answered, "episode", "left_semi"), objects, merged).select("episode").distinct()
    second = written(domain(provided_links(prompts.join(left, "episode", "left_semi"), verifier, "llm-verify")))
    return merged_links(merged.select(*first.columns).unionByName(second))


def linked_sessions(sessions: DataFrame, turns: DataFrame, queries: DataFrame, objects: DataFrame, sightings: DataFrame, provider: Callable[[str], list[dict]], verifier: Callable[[str], list[dict]] | None = None, window: int = 60) -> DataFrame:
    """episode, session, turn, object_id, fact_bearing, source, phrase: the links of every session; tables as in session_prompts.

    Only turns and objects of a session's own prompt can be linked, and a class is unique among those objects. Rule
    links and the second pass, which shows the turns that stay uncovered, are for sessions of which the reply could be
    read, be it an empty one. Each provider is asked once for a prompt.
    """
    own, listed = session_scope(sessions, turns, queries, objects, sightings, window)
    own, listed = written(own), written(listed)
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((turns, "turn"), (objects, "object_id"))]
    keys = ["episode", "session"]

    def allowed(said: DataFrame, source: str) -> DataFrame:
        rows = said.select(*keys, F.inline("links")).withColumn("source", F.lit(source))
        return rows.join(own.select(*keys, "turn"), [*keys, "turn"], "left_semi").join(listed.select(*keys, "object_id"), [*keys, "object_id"], "left_semi")

    asked = written(replies(session_prompts(sessions, turns, queries, objects, sightings, window).select(*keys, "prompt"), provider, *kinds))
    answered = asked.where("links is not null").select(*keys)
    # A session is a room of its own to the rules.
    room = F.struct(*keys)
    said = own.join(answered, keys, "left_semi").withColumn("room", room).select("episode", "turn", "text", "room")
    things = listed.withColumn("room", room).select("room", "object_id", "label")
    rules = rule_links(said, things).withColumn("source", F.lit("rule")).join(own.select("session", "episode", "turn"), ["episode", "turn"])
    first = allowed(asked, "llm")
    linked = lambda rows: merged_links(rows, (*keys, "turn", "object_id"))
    merged = linked(first.unionByName(rules.select(*first.columns)))
    if verifier is None:
        return merged
    left = uncovered_turns(said, things, merged).select("episode", "turn")
    prompts = session_prompts(sessions, turns, queries, objects, sightings, window, left).select(*keys, "prompt")
    second = allowed(written(replies(prompts, verifier, *kinds)), "llm-verify")
    return linked(merged.select(*first.columns).unionByName(second))


def physical_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions of a physical object that were resolved to a track. mentions: mention_type, status, track_id, ..."""
    return mentions.where((F.col("mention_type") == "physical_object") & F.col("status").isin("resolved", "clarified") & (F.coalesce("track_id", F.lit("")) != ""))


def track_map(facts: DataFrame) -> DataFrame:
    """episode, track_id, room, object_id: the object of each track, by its last fact. facts: episode, track_id, clip_id, object_id, turn."""
    last = F.max_by(F.struct("clip_id", "object_id"), F.struct("turn", "clip_id", "object_id"))
    return facts.groupBy("episode", "track_id").agg(last.alias("o")).select("episode", "track_id", scene_of(F.col("o.clip_id")).alias("room"), F.col("o.object_id").alias("object_id"))


def mapped_mentions(mentions: DataFrame, tracks: DataFrame, turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Physical mentions on transcript turns, with room and object_id, null where their track is not mapped.

    ids (episode, turn, other) renames a log's turns; what is no turn of the transcript then goes.
    """
    named = renamed_turns(physical_mentions(mentions), ids).drop("turn").withColumnRenamed("mapped", "turn")
    known = named.join(turns.select("episode", "turn").distinct(), ["episode", "turn"], "left_semi")
    return known.join(tracks, ["episode", "track_id"], "left")


def release_links(mentions: DataFrame, records: DataFrame, facts: DataFrame, turns: DataFrame, ids: DataFrame) -> DataFrame:
    """episode, turn, room, object_id, fact_bearing, source, phrase: gold links of a release's logs and evidence.

    mentions: episode, turn, mention_type, status, track_id, span, fact_bearing; records: episode, turn, status,
    track_id, of which established ones bear facts; facts: episode, turn, track_id, clip_id, object_id, which make links
    only of episodes that have no log.
    """
    tracks = track_map(facts)
    columns = ["episode", "turn", "room", "object_id", "fact_bearing", "source", "phrase"]
    logged = mapped_mentions(mentions, tracks, turns, ids).where("object_id is not null").select(*columns[:4], F.coalesce("fact_bearing", F.lit(False)).alias("fact_bearing"), F.lit("log").alias("source"), F.col("span").alias("phrase"))
    made = renamed_turns(records.where("status = 'established'"), ids).drop("turn").withColumnRenamed("mapped", "turn").join(tracks, ["episode", "track_id"])
    made = made.select(*columns[:4], F.lit(True).alias("fact_bearing"), F.lit("compiled").alias("source"), F.lit("").alias("phrase"))
    episodes = mentions.select("episode").unionByName(records.select("episode")).distinct()
    shown = facts.join(episodes, "episode", "left_anti").select("episode", "turn", scene_of(F.col("clip_id")).alias("room"), "object_id", F.lit(True).alias("fact_bearing"), F.lit("evidence").alias("source"), F.lit("").alias("phrase"))
    every = logged.unionByName(made).unionByName(shown).join(turns.select("episode", "turn").distinct(), ["episode", "turn"], "left_semi")
    merged = merged_links(every, tuple(columns[:4]))
    return merged.withColumn("source", F.when(F.col("source") == "compiled", "log").otherwise(F.col("source")))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
