"""Bounded-space online packing of token streams into fixed-length sequences."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, stored, tidy, whole_text

#: Windows a partition holds open at once.
OPEN_WINDOWS = 16
#: A gap of so many tokens is padded, a larger one is filled with part of a document.
SMALL_GAP = 16
#: Partitions whose leftovers are merged in one task.
MERGED_TOGETHER = 64
#: Parts that the values of `by_col` are dealt into for merging.
BUCKETS = 64
#: Bytes of known words and their token ids that a worker remembers; beyond it the memory starts anew.
REMEMBERED_BYTES = 40 << 20
LONGEST_REMEMBERED = 64
#: A word whose ids are those of its letters in lower case and those of its last comma or full stop: a pre-tokenizer
#: that parts letters from punctuation never joins them, and these letters have no other forms.
PLAIN_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]?$"
TAILS = ("", ",", ".")
#: Text bytes encoded at once, and words whose ids are gathered at once.
SLICE_BYTES = 4 << 20
GATHERED = 1 << 18

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts, each new word encoded once, in batches.

    For tokenizers that turn letters into lower case, drop white space and part letters from punctuation, so that no
    token crosses a space or line feed. Words are cut at these two alone; any other white space is left to the
    tokenizer. A slice's words are first made distinct by Arrow and looked up in Arrow's array of known words, so that
    Python sees new words only; numpy puts the ids together again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.forget()

    def forget(self) -> None:
        """Known words in an array, the TAILS first; word k has ids[ends[k]:ends[k + 1]]."""
        self.known = pa.array([], pa.string())
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int32)
        self.learn(list(TAILS), len(TAILS))

    def learn(self, fresh: list[str], remembered: int) -> tuple[np.ndarray, np.ndarray]:
        """All known words' ids and ends with those of `fresh` after them; the first of these are remembered."""
        parts, lengths = [self.ids], [self.ends[-1:]]
        for a, b in by_bytes([4 * len(x) for x in fresh], 1 << 20):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(fresh[a:b], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, encoded), np.int32, len(encoded)))
            parts.append(np.fromiter(chain.from_iterable(encoded), "<u4", int(lengths[-1].sum())))
        ids, ends = np.concatenate(parts), np.concatenate([self.ends[:-1], np.cumsum(np.concatenate(lengths), dtype=np.int32)])
        if remembered:
            self.known = pa.concat_arrays([self.known, pa.array(fresh[:remembered], pa.string())])
            self.ends = ends[: len(self.known) + 1].copy()
            self.ids = ids[: self.ends[-1]].copy()
        return ids, ends

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, `end_id` after each text, and the offsets between texts."""
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self.forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        bounds = 2 * (np.asarray(split.offsets) - split.offsets[0].as_py())
        shape = words.dictionary
        plain = pc.match_substring_regex(shape, PLAIN_WORD)
        stems = pc.if_else(plain, pc.ascii_lower(pc.utf8_rtrim(shape, ",.")), shape).dictionary_encode()
        at = pc.index_in(stems.dictionary, value_set=self.known)
        new = np.asarray(at.is_null())
        of_stem = np.asarray(at.fill_null(0), np.int32).copy()
        ids, ends = self.ids, self.ends
        if new.any():
            unknown = stems.dictionary.filter(pa.array(new))
            longer = np.asarray(pc.greater(pc.utf8_length(unknown), LONGEST_REMEMBERED))
            order = np.argsort(longer, kind="stable")
            of_stem[np.flatnonzero(new)[order]] = len(self.known) + np.arange(len(order), dtype=np.int32)
            ids, ends = self.learn(unknown.take(pa.array(order)).to_pylist(), int(len(order) - longer.sum()))
        tail = np.where(plain, np.where(pc.ends_with(shape, ","), 1, np.where(pc.ends_with(shape, "."), 2, 0)), 0).astype(np.int32)
        both = np.column_stack([of_stem[np.asarray(stems.indices)], tail])
        number = both[np.asarray(words.indices)].ravel()
        del split, words, shape, plain, stems, at
        length = (ends[1:] - ends[:-1])[number]
        before = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        gathered = np.empty(before[-1], "<u4")
        for a in range(0, len(number), GATHERED):
            some, low, high = length[a : a + GATHERED], before[a], before[min(a + GATHERED, len(number))]
            start = ends[number[a : a + GATHERED]] - (before[a : a + len(some)] - low)
            gathered[low:high] = ids[np.repeat(start, some) + np.arange(high - low)]
        offsets = before[bounds] + np.arange(len(bounds))
        out = np.full(offsets[-1], end_id, "<u4")
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = gathered
        return out, offsets

    def documents(self, texts: pa.Array, sizes: list[int], end_id: int) -> Iterator[tuple[int, memoryview]]:
        """The number of each text and its ids as bytes; a text of over SLICE_BYTES is encoded in parts cut at spaces."""
        for a, b in by_bytes(sizes, SLICE_BYTES):
            if sizes[a] > SLICE_BYTES:
                parts = [self.encode(pa.array([x]), end_id)[0][:-1] for x in cut(texts[a].as_py())]
                yield a, memoryview(np.concatenate([*parts, np.array([end_id], "<u4")])).cast("B")
                continue
            encoded, offsets = self.encode(texts.slice(a, b - a), end_id)
            data, at = memoryview(encoded).cast("B"), (4 * offsets).tolist()
            for k, (low, high) in enumerate(zip(at, at[1:])):
                yield a + k, data[low:high]
            del encoded, data
            give_back()


def cut(text: str, most: int = SLICE_BYTES // 4) -> Iterator[str]:
    """The text in parts of `most` characters or a word more, cut before spaces."""
    start = 0
    while len(text) - start > most and (end := text.find(" ", start + most)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one partition and group, by rising fill. A window is [fill, pieces]; a piece is (doc_id, start, length, crc, doc_tokens, group)."""

    def __init__(self, capacity: int, windows: int, small_gap: int = SMALL_GAP, group: str | None = None):
        self.capacity, self.windows, self.small_gap, self.group = capacity, windows, small_gap, group
        self.open: list[list] = []
        self.done: list[list] = []

    def put(self, at: int, piece: tuple) -> None:
        """Put the piece into the open window at this place, or into a new one at -1."""
        window = self.open.pop(at) if at >= 0 else [0, []]
        window[0] += piece[2]
        window[1].append(piece)
        if window[0] == self.capacity:
            self.done.append(window)
        else:
            insort(self.open, window, key=_fill)

    def fitting(self, length: int) -> int:
        """The place of the fullest open window that has room; -1 if none has."""
        return bisect_right(self.open, self.capacity - length, key=_fill) - 1

    def add(self, doc_id, view: memoryview) -> None:
        total, start = len(view) // 4, 0
        piece = lambda length: (doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total, self.group)
        while total - start >= self.capacity:
            self.done.append([self.capacity, [piece(self.capacity)]])
            start += self.capacity
        while start < total:
            left = total - start
            at = self.fitting(left)
            if at < 0 and len(self.open) == self.windows:
                at = len(self.open) - 1
                gap = self.capacity - self.open[at][0]
                if gap <= self.small_gap:
                    self.done.append(self.open.pop())
                    continue
                left = gap
            self.put(at, piece(left))
            start += left

    def add_whole(self, piece: tuple) -> None:
        """Place a piece without cutting it, in as many windows as it takes."""
        self.put(self.fitting(piece[2]), piece)


def _fill(window: list) -> int:
    return window[0]


def pack_tokens(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text", by_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `by_col` if one is named.

    A document is its token ids and then `end_id`. Each partition keeps `windows` open windows: what reaches the
    capacity fills sequences of its own, a remainder goes to the open window it fits best, and when it fits none
    the fullest one is emitted, after a part of the remainder has filled it (a gap of SMALL_GAP tokens or less
    is padded instead). What is open at the end of a partition is merged, best-fit by falling length, in a tree: a
    task merges the windows that MERGED_TOGETHER partitions, or tasks of the level below, left open, and leaves the
    `windows` emptiest of them to the next level. So no task gets more than windows * MERGED_TOGETHER windows, however
    many partitions there are. Every token lies in exactly one piece.

    With `by_col`, say a language, a sequence holds documents of one value of it; null is a value. Each value has open
    windows of its own, so these numbers hold for a value, and BUCKETS deals the values to more merging tasks.

    Null and empty texts are one token, `end_id`. Very long texts are encoded in parts. Repeated rows are packed each. Sequence ids are unique, not
    gapless. Other columns are not read. An empty table gives an empty result.
    """
    by = F.col(by_col) if by_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("body"), by.cast("string").alias("by"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "by", "sequence_id", "offset", "left_by"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, by string, sequence_id long, offset long, left_by long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        words, packers = encoder(tokenizer_path), {}

        def taken(filled: list[list], left_by: int | None) -> pa.RecordBatch:
            nonlocal serial
            out: list[list] = [[] for _ in names]
            for fill, pieces in filled:
                offset = 0
                for p in pieces:
                    for column, value in zip(out, (*p, (part << 32) + serial, offset, left_by)):
                        column.append(value)
                    offset += p[2]
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        types = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 3
        done: list[list] = []
        for batch in batches:
            types[0] = batch.column("doc_id").type
            ids, groups, texts = batch.column("doc_id").to_pylist(), batch.column("by").to_pylist(), batch.column("body")
            for k, view in words.documents(texts, batch.column("size").to_pylist(), end_id):
                if groups[k] not in packers:
                    packers[groups[k]] = Packer(capacity, windows, group=groups[k])
                    packers[groups[k]].done = done
                packers[groups[k]].add(ids[k], view)
                if len(done) >= 512:
                    yield taken(done, None)
                    done.clear()
            yield taken(done, None)
            done.clear()
        still = [window for packer in packers.values() for window in packer.open]
        for a in range(0, len(still), 512):
            yield taken(still[a : a + 512], part)

    def merge(level: int, last: bool):
        def merged(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
            bucket, group = map(int, key)
            first = (level << 56) + (bucket << 48) + (group << 24)
            serial, still = 0, 0 if last else windows
            out = []
            for _, own in pieces.groupby("by", dropna=False):
                packer = Packer(capacity, 0)
                rest = own.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
                for p in rest[names[:6]].itertuples(index=False, name=None):
                    packer.add_whole(p)
                for n, (_, placed) in enumerate([*packer.open, *packer.done]):
                    offset = 0
                    for p in placed:
                        out.append((*p, first + serial, offset, group if n < still else None))
                        offset += p[2]
                    serial += 1
            return pd.DataFrame(out, columns=names).astype({"left_by": "Int64"})

        return merged

    pieces = stored(rows.withColumn("size", F.octet_length("body")).mapInArrow(tidy(pack), schema))
    packed = pieces.where("left_by is null")
    leaving, level = pieces.where("left_by is not null"), 0
    bucket = F.pmod(F.xxhash64("by"), F.lit(BUCKETS)).alias("bucket")
    most = leaving.agg(F.max("left_by")).first()[0]
    while most is not None:
        level, most = level + 1, most // MERGED_TOGETHER
        group = F.floor(F.col("left_by") / MERGED_TOGETHER).alias("g")
        level_pieces = stored(leaving.groupBy(bucket, group).applyInPandas(merge(level, most == 0), schema))
        packed, leaving = packed.unionByName(level_pieces.where("left_by is null")), level_pieces.where("left_by is not null")
        most = most or None
    return packed.select(*names[:5], "sequence_id", "offset", *([F.col("by").alias(by_col)] if by_col else []))
