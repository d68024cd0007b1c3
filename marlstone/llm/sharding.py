"""Contiguous sharding with the smallest largest shard, keeping equal texts together."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import whole_text

#: Atomic groups in their order: texts by a hash, which bounds what the driver sees to so many sums.
ATOMS = 1 << 16
#: Parts in which the rows of a shard are numbered.
SLOT_PARTS = 1024
ROW_BYTES = 16


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Shards that greedy filling takes."""
    count = filled = 0
    for n in sizes:
        if not count or filled + n > capacity:
            count, filled = count + 1, 0
        filled += n
    return count


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """First groups of all shards but the first, in the contiguous partition whose largest sum is as small as can be.

    Of the cuts that keep to that capacity, each is the nearest to an even share of the whole.
    """
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    sums = list(accumulate(sizes, initial=0))
    earliest = [len(sizes)] * (shards + 1)  # the earliest start from which the shards that remain suffice
    for k in range(shards - 1, 0, -1):
        earliest[k] = bisect_left(sums, sums[earliest[k + 1]] - low)
    cuts, start = [], 0
    for k in range(1, shards):
        latest = bisect_right(sums, sums[start] + low) - 1
        near = bisect_left(sums, sums[-1] * k / shards)
        near -= near > 0 and sums[-1] * k / shards - sums[near - 1] < sums[near] - sums[-1] * k / shards
        start = max(earliest[k], min(near, latest), start)
        cuts.append(start)
    return [c for c in cuts if c < len(sizes)]


def shard_by_bytes(docs: DataFrame, shards: int = 40, atoms: int = ATOMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 16. Equal texts share one of `atoms` ordered atoms (a hash of the text),
    and only the atoms' sums, at most `atoms` rows, come to the driver. There a binary search finds the smallest
    capacity at which greedy filling needs no more than `shards` contiguous shards, and the atoms are cut within it.
    Slots number a shard's rows from 0 without gaps: rows are counted in SLOT_PARTS parts of the shard by a hash
    of the id and the text, so that no task sorts a whole shard, of rows without an id either. A group of copies larger than a fair share makes its shard
    larger than the others; it is never divided.

    Null text counts as empty. Repeated rows get a slot each. Other columns are not read. An empty table gives
    an empty result.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(atoms)).alias("atom"))
    sums = sorted((r["atom"], r["size"]) for r in rows.groupBy("atom").agg(F.sum("size").alias("size")).collect())
    starts = [sums[i][0] for i in minimax_cuts([n for _, n in sums], shards)]
    placed = rows.withColumn("shard", shard_of(F.col("atom"), starts)).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(SLOT_PARTS)))
    before = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("row", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "atom", "text_crc32")))
    return numbered.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_of(atom: Column, starts: list[int]) -> Column:
    """How many shards start at or before this atom, not counting the first."""
    return sum(((atom >= F.lit(s)).cast("int") for s in starts), F.lit(0))
