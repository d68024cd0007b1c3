"""Token counts of whole texts, encoded in batches inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, tidy, whole_text

#: Bytes that the units a worker remembers may take, at UNIT_BYTES and their characters each; beyond it the memory starts anew.
REMEMBERED_BYTES, UNIT_BYTES = 80 << 20, 160
#: Longer units are not remembered.
LONGEST_REMEMBERED = 64

_beside_space = re.compile(r"\s | \s")
_safe_space = re.compile(r"(?<=\S) (?=\S)")
_counters: dict[str, UnitCounter] = {}


def units(text: str) -> list[str]:
    """Split at safe boundaries: before a single space between two characters that are not white space.

    Every unit but the first stands for itself with that space before it. A byte-level BPE never merges across
    such a boundary, so the lengths of the units add up to that of the text.
    """
    return _safe_space.split(text) if _beside_space.search(text) else text.split(" ")


class UnitCounter:
    """Counts tokens by units, encoding each new unit once, in batches."""

    def __init__(self, lengths: Callable[[list[str]], list[int]]):
        self.lengths = lengths
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.bytes = 0

    def learn(self, known: dict[str, int], new: set[str], before: str) -> list[str]:
        fresh = list(new)
        sizes = [4 * len(x) for x in fresh]
        for a, b in by_bytes(sizes, 1 << 20):
            known.update(zip(fresh[a:b], self.lengths([before + x for x in fresh[a:b]])))
        self.bytes += sum(UNIT_BYTES + len(x) for x in fresh if len(x) <= LONGEST_REMEMBERED)
        return [x for x in fresh if len(x) > LONGEST_REMEMBERED]

    def count(self, texts: list[str]) -> list[int]:
        split = [units(x) for x in texts]
        heads = [x.pop(0) for x in split]
        if self.bytes > REMEMBERED_BYTES:
            self.first.clear()
            self.rest.clear()
            self.bytes = 0
        forget = [(self.first, x) for x in self.learn(self.first, set(heads) - self.first.keys(), "")]
        forget += [(self.rest, x) for x in self.learn(self.rest, set().union(*split) - self.rest.keys(), " ")]
        first, rest = self.first, self.rest.__getitem__
        out = [first[h] + sum(map(rest, u)) for h, u in zip(heads, split)]
        for known, unit in forget:
            del known[unit]
        return out


def counter(tokenizer_path: str) -> UnitCounter:
    """The worker's counter for a tokenizer file; it outlives the task where workers are reused."""
    if tokenizer_path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _counters[tokenizer_path] = UnitCounter(lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    return _counters[tokenizer_path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The tokenizer is a byte-level BPE file of the `tokenizers` library; no special tokens are added, and special
    strings inside a text count as the library's default has it. Each worker encodes slices of bounded bytes; a
    long text is split where no token crosses. Null and empty texts have no bytes and no tokens. Other columns
    are not read; repeated rows are counted each. An empty table gives an empty result.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path)
        for batch in batches:
            texts, sizes = batch.column("body"), batch.column("n_bytes").to_pylist()
            for a, b in by_bytes(sizes):
                found = pa.array(counts.count(texts.slice(a, b - a).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), found], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(tidy(lengths), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
