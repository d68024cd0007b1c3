"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python function works on at once; bounds its temporary arrays.
SLICE_BYTES = 4 << 20
#: A key of more than this share of all rows, one in so many, is hot; there are fewer such keys than this.
HOT_KEYS = 512
#: Parts that a hot key's rows are dealt into.
SALTS = 64

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all are one process, a
    temporary one will do; on a cluster without that setting this raises."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the application ends, or by delete_stored before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
    place, files = _on_store(spark, path)
    files.deleteOnExit(place)
    _written.append(path)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """A mark for delete_stored: tables stored from now on come after it."""
    return len(_written)


def delete_stored(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables stored since a mark, but not the last so many; nothing may read them any more."""
    end = len(_written) - but
    for path in _written[since:end]:
        place, files = _on_store(spark, path)
        files.delete(place, True)
    del _written[since:end]


def _on_store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys of `counts` (one row per key, `n` rows each) that hold more than one in HOT_KEYS of all rows; so they are fewer than that."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * HOT_KEYS > total).select(*keys)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of `facts` (one row per key), where no key's rows meet in one task.

    The `hot` keys, fewer than HOT_KEYS, are broadcast. Their rows are dealt by `by` into SALTS parts, to each of which
    their facts go; other keys have one part.
    """
    parts = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = lambda salted: F.when(F.col("_hot"), salted).otherwise(0).cast("int")
    dealt = rows.withColumn("_by", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(parts, keys, "left").withColumn("_salt", salt(F.col("_by"))).drop("_hot", "_by")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = facts.join(parts, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def one_row_each(kept: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Some rows of `docs`, with one row, the least by a hash of all columns, of those that repeat an id and its text; null is an id here.

    Where no id of `docs` repeats, only the ids are dealt.
    """
    repeated = stored(docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if repeated.isEmpty():
        return kept
    same = kept[id_col].eqNullSafe(repeated["_id"])
    again = kept.join(repeated, same, "left_semi").select(F.struct(*(kept[c] for c in kept.columns)).alias("_row"))
    order = F.xxhash64(*(F.col("_row")[c] for c in kept.columns))
    text = F.sha2(F.coalesce(F.col("_row")[text_col], F.lit("")).cast("binary"), 256)
    one = again.groupBy(F.col("_row")[id_col].alias("_id"), text.alias("_text")).agg(F.min_by("_row", order).alias("_row"))
    return kept.join(repeated, same, "left_anti").unionByName(one.select(*(F.col("_row")[c].alias(c) for c in kept.columns)))


def give_back() -> None:
    """Return freed memory to the system; Arrow's pool and the C library would keep it, in idle workers too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, returning freed memory after each of its results and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(batches):
            yield out
            del out
            give_back()
        give_back()

    return run


def by_bytes(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `limit` bytes; a longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
