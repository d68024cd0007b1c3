"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, whole_text

#: Edits allowed for each character of a test item.
ERROR_RATE = 0.08
#: Bytes of test items that one pass over the documents looks for.
ITEM_BLOCK_BYTES = 4 << 20

_not_word = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower case, with every run of anything but letters and digits as one space, and a space at either end."""
    words = _not_word.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length and their places: with no more errors, one of them is unchanged."""
    n = errors + 1
    at = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


class Myers:
    """Myers' bit-parallel edit distance of one pattern, as long integers."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.all = (1 << self.m) - 1
        self.high = 1 << (self.m - 1)
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """The least distance of the pattern to any substring, and where the first such substring ends."""
        get, mask, high = self.peq.get, self.all, self.high
        pv, mv, score = mask, 0, self.m
        best, end = score, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1) & mask
            mh = (mh << 1) & mask
            pv = mh | (~(xv | ph) & mask)
            mv = ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """Finds approximate occurrences of test items in plain texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(item_id, text) for item_id, raw in items if (text := plain(raw))]
        self.errors = [int(error_rate * len(t)) for _, t in self.items]
        self.myers: dict[int, Myers] = {}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, self.errors[k]):
                where[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, characters of the item, end in the plain text) of each item that occurs, at its least distance."""
        text = plain(raw)
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            start = end - length + 1
            for k, at in places:
                e = self.errors[k]
                windows[k].append((max(0, start - at - e), start - at + len(self.items[k][1]) + e))
        out = []
        for k, spans in windows.items():
            spans.sort()
            best, end, e = self.errors[k] + 1, 0, self.errors[k]
            low, high = spans[0]
            for a, b in [*spans[1:], (len(text) + 1, 0)]:
                if a <= high and b:
                    high = max(high, b)
                    continue
                d, at = self.verified(k, text[low:high]) if e else (0, high - low)
                if d < best:
                    best, end = d, low + at
                low, high = a, b
            if best <= e:
                out.append((self.items[k][0], best, len(self.items[k][1]), end))
        return out

    def verified(self, k: int, window: str) -> tuple[int, int]:
        item = self.items[k][1]
        if (at := window.find(item)) >= 0:
            return 0, at + len(item)
        if k not in self.myers:
            self.myers[k] = Myers(item)
        return self.myers[k].search(window)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ITEM_BLOCK_BYTES; one empty block if there are none."""
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = 1 + int(total) // ITEM_BLOCK_BYTES
    for block in range(blocks):
        yield [(r["item_id"], r["item"]) for r in items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item that occurs in it: doc_id, item_id, distance, item_chars, end_char.

    Texts are compared in plain form (letters and digits in lower case, all else as one space). An item may
    differ from a part of the document by error_rate edits a character; it is split into one more piece than
    edits, exact hits of the pieces give windows, and Myers' bit-parallel distance verifies them. One rule holds for all
    lengths: the budget is the whole part of error_rate times the item's characters, its two outer spaces counted, so
    items of under 13 characters must occur unchanged, as whole words. The least distance of a pair is given, with
    the end of the match in the plain text.

    Items come to the driver and go out in blocks of about ITEM_BLOCK_BYTES, each block a pass over all
    documents, so no broadcast grows with the benchmark. Null and empty texts, and items without a letter or
    digit, match nothing. Repeated rows of either table give one row per pair of ids; null ids are ids like others. Other columns are not read. Empty tables
    give an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), whole_text(item_text_col).alias("item")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"))
    found: DataFrame | None = None
    for part in item_blocks(items):
        one = rows.mapInArrow(tidy(_search(part, error_rate)), f"doc_id {kind}, item_id {item_kind}, distance long, item_chars long, end_char long")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "item_chars", "end_char")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def _search(items: list[tuple[int, str]], error_rate: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("body")
            rows: list[int] = []
            found: list[tuple] = []
            for i in range(batch.num_rows):
                for match in matcher.matches(texts[i].as_py()):
                    rows.append(i)
                    found.append(match)
            if found:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *map(pa.array, zip(*found))], ["doc_id", "item_id", "distance", "item_chars", "end_char"])

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no test item occurs, with all their columns; nothing is shuffled.

    Null and empty texts hold no item and stay, as do all rows where the benchmark is empty.
    """

    def clean(items: list[tuple[int, str]]):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(x.as_py() or "") for x in batch.column(text_col)], pa.bool_()))

        return keep

    for part in item_blocks(benchmark.select(F.col(item_col).alias("item_id"), whole_text(item_text_col).alias("item")).distinct()):
        docs = docs.mapInArrow(tidy(clean(part)), docs.schema)
    return docs
