"""Asking an injected model: patience with its endpoint, replies known already, and the plan of a benchmark run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_json, short_hash
from ..sources.shared import written
from .scoring import to_do

# The configurations of a benchmark run, each with its context, prompt and links.
CONFIGURATIONS = (
    ("memory", "memory_a", "memory.md", "learned"),
    ("memory_annotated_links", "memory_a", "memory.md", "annotated"),
    ("full_context", "full", "full_context.md", None),
    ("per_frame", "per_frame", "per_frame.md", None),
)
# Tries of one question, seconds more to wait after each, and between probes of an endpoint that is down.
TRIES, BACK_OFF, PROBE_EVERY = 6, 5.0, 60.0
ERROR = "ERROR: "


class Unavailable(Exception):
    """The endpoint is down or limits its use; the question itself is all right."""


def patient(ask: Callable[[str], str], probe: Callable[[], bool], tries: int = TRIES, back_off: float = BACK_OFF, every: float = PROBE_EVERY, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """`ask` with patience: while it is Unavailable, the endpoint is probed until it answers, and no try is used up.

    After any other failure it is asked again, with a wait that grows by `back_off`; the last failure gives an error
    text. A Python worker asks one question at a time, so a pause holds all that the worker has left.
    """

    def answers() -> bool:
        try:
            return probe()
        except Exception:
            return False

    def call(prompt: str) -> str:
        failures = 0
        while True:
            try:
                return ask(prompt)
            except Unavailable:
                sleep(every)
                while not answers():
                    sleep(every)
            except Exception as e:
                failures += 1
                if failures >= tries:
                    return f"{ERROR}{e}"
                sleep(back_off * failures)

    return call


def asked(prompts: DataFrame, cache: DataFrame, ask: Callable[[str], str], *settings: str) -> DataFrame:
    """Rows of `prompts` (prompt, ...) with cache_key, raw (the reply) and cached: whether `cache` (cache_key, raw) had it.

    Settings such as the model are part of the key. Prompts that are the same are asked once, in this run too, and the
    replies are written before they are used. `new_replies` gives what a cache lacks.
    """
    keyed = prompts.withColumn("cache_key", short_hash(*map(F.lit, settings), F.col("prompt")))
    known = cache.where(~F.col("raw").startswith(ERROR)).groupBy("cache_key").agg(F.min("raw").alias("raw"))
    missing = keyed.select("cache_key", "prompt").dropDuplicates(["cache_key"]).join(known, "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "raw": [ask(p) for p in batch["prompt"]]})

    fresh = written(missing.mapInPandas(run, "cache_key string, raw string"))
    both = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return keyed.join(both, "cache_key")


def new_replies(replies: DataFrame) -> DataFrame:
    """cache_key, raw of replies that a cache should get: new ones that are no errors."""
    return replies.where(~F.col("cached") & ~F.col("raw").startswith(ERROR)).select("cache_key", "raw").distinct()


def benchmark_plan(queries: DataFrame, done: DataFrame, configurations: tuple = CONFIGURATIONS) -> DataFrame:
    """Queries times configurations (configuration, method, prompt_name, links), without those that `done` answered.

    done: configuration, query_id, raw; a result that is an error is to be done again.
    """
    each = F.explode(F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("configuration", "method", "prompt_name", "links"), c))) for c in configurations)))
    rows = queries.withColumn("_c", each).select(*queries.columns, "_c.*")
    # The anti-join is on one column, so both go into it.
    key = F.struct("configuration", F.col("query_id"))
    both = rows.withColumn("_q", F.col("query_id")).withColumn("query_id", key)
    left = to_do(both, done.select(key.alias("query_id"), "raw"))
    return left.withColumn("query_id", F.col("_q")).drop("_q")


def answers(plan: DataFrame, contexts: DataFrame, cache: DataFrame, ask: Callable[[str], str], *settings: str) -> DataFrame:
    """The plan's rows with raw, cached and pred (JSON text of the answer, or null). contexts: method, links, query_id, prompt."""
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("method", "links", "query_id")]
    prompts = plan.alias("p").join(contexts.alias("c"), same).select("p.*", "c.prompt")
    return asked(prompts, cache, ask, *settings).withColumn("pred", answer_json(F.col("raw")))
