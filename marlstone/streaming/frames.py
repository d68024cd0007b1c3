"""Streaming forms of frame sampling and of sightings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string", glob: str = "events.parquet") -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def sampled(events: DataFrame, width: str = "6 hours", late: str = "1 day", key: str = "user_id", time: str = "ts", row_id: str = "event_id") -> DataFrame:
    """key, start, first_id, n: the first row in each tumbling window of each sequence; rows later than `late` are dropped.

    Windows are aligned to the clock, unlike batch sampling, whose bins start with each sequence.
    """
    first = F.min(F.struct(F.col(time).alias("t"), F.col(row_id).alias("id")))
    rows = events.withWatermark(time, late).groupBy(key, F.window(time, width)).agg(first.alias("first"), F.count("*").alias("n"))
    return rows.select(key, F.col("window.start").alias("start"), F.col("first.id").alias("first_id"), "n")


def sampled_by_state(events: DataFrame, seconds: float, key: str = "user_id", time: str = "ts", row_id: str = "event_id") -> DataFrame:
    """key, row_id, bin: the first row of each bin that starts with the sequence's own first row.

    State is one number and one bin for each sequence. A row before the last bin seen is late and dropped.
    """

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last = state.get if state.exists else (None, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values([time, row_id])
        for t, i in zip(rows[time], rows[row_id]):
            now = t.timestamp()
            start = now if start is None else start
            at = int((now - start) / seconds + 1e-9)
            if now >= start and at > last:
                out.append((group[0], i, at))
                last = at
        state.update((start, last))
        yield pd.DataFrame(out, columns=[key, row_id, "bin"])

    return events.groupBy(key).applyInPandasWithState(keep, f"{key} long, {row_id} long, bin long", "start double, last long", "append", GroupStateTimeout.NoTimeout)


def first_sightings(events: DataFrame, late: str = "1 day") -> DataFrame:
    """room, object_id, first_ts, n, updated as events arrive."""
    room = F.col("user_id") % 20
    rows = events.withWatermark("ts", late).select(room.alias("room"), (F.col("event_id") % 25 * 20 + room).alias("object_id"), "ts")
    return rows.groupBy("room", "object_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
