"""The closed vocabulary of facts, and checks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots and what each can say.
VOCABULARY = {
    "owner": ("Priya", "Dana", "Sam"),
    "responsibility": ("Priya", "Dana", "Sam"),
    "preference": ("like", "love", "dislike", "hate", "neutral"),
    "priority": ("early", "normal", "last"),
    "history": ("used daily", "never used", "bought recently", "spilled on", "searched here", "fixed last month", "broke before", "squeaked"),
    "constraint": ("shared", "do not touch", "not mine to move", "must stay here", "return by deadline", "fragile"),
    "decision": ("keep here", "defer", "relocate", "remove", "replace"),
    "planning": ("keep accessible", "handle later", "review later", "handle early"),
    "access_state": ("keep accessible",),
    "maintenance": ("inspect later", "needs cleaning", "needs repair", "recently serviced", "working"),
    "function": ("work surface", "storage", "display", "seating", "lighting"),
    "status": ("leave out", "packed", "undecided", "sorted"),
    "intention": ("clean", "keep", "give away", "repair", "replace"),
}


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, v, i) for s, vs in VOCABULARY.items() for i, v in enumerate(vs)], "slot string, value string, position int")


def in_vocabulary(facts: DataFrame) -> DataFrame:
    """Facts (slot, value, ...) that the vocabulary has; a value counts only under its own slot."""
    return facts.join(F.broadcast(vocabulary(facts.sparkSession).select("slot", "value")), ["slot", "value"], "left_semi")


def stated(facts: DataFrame, slot: str, values: tuple[str, ...], before: int, slots_any: bool = False) -> DataFrame:
    """object_id: distinct objects with any of the values under the slot at an earlier turn."""
    rows = facts.where(F.col("turn") < before).where(F.col("value").isin(*values))
    return (rows if slots_any else rows.where(F.col("slot") == slot)).select("object_id").distinct()
