"""Near duplicates: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import by_bytes, one_row_each, stored, tidy, whole_text
from .shingles import exact_shingles, mixed, shingle_sets

#: MinHash samples of a text that the odd sketch folds; the bands use the first of them, and more below a threshold of 7 percent.
SAMPLES = 192
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Samples of a band, at most, and the chance that a pair at the threshold meets in no band.
BAND_ROWS, BAND_MISS = 4, 1e-6
#: Standard deviations by which a sketch's estimate may fall short.
SKETCH_SIGMAS = 5.0
#: Members of a bucket that one task compares among themselves or with as many others.
BLOCK = 2048
#: Shingles of the members that a task compares among themselves or with as many others.
BLOCK_SHINGLES = 1 << 21
#: Text bytes whose signatures are computed at once.
SIGNATURE_BYTES = 1 << 20

_rng = np.random.default_rng(977)
_FLIP = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_more: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bands_for(percent: int) -> tuple[int, int]:
    """Samples of a band, and the fewest bands with which a pair at the threshold is missed no more often than BAND_MISS.

    The longest bands are taken of which the samples give enough; where not even single samples do, there are more samples.
    """
    if not 1 <= percent <= 100:
        raise ValueError("the threshold is a percentage from 1 to 100")
    for rows in range(BAND_ROWS, 0, -1):
        chance = (percent / 100) ** rows
        bands = 1 if chance == 1 else math.ceil(math.log(BAND_MISS) / math.log(1 - chance))
        if rows == 1 or rows * bands <= SAMPLES:
            return rows, bands
    raise AssertionError


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= SAMPLES:
        return _FLIP, _FACTOR
    if n not in _more:
        rng = np.random.default_rng(978)
        _more[n] = tuple(np.concatenate([x, y]) for x, y in ((_FLIP, rng.integers(0, 2**64, n - SAMPLES, dtype=np.uint64)), (_FACTOR, rng.integers(0, 2**63, n - SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
    return _more[n]


def differing_bits(mismatches: float) -> float:
    """The expected bits in which two odd sketches differ when so many samples differ: each toggles one bit in either."""
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * mismatches))


def most_bits(percent: int) -> int:
    """More differing bits than this rule a pair out, SKETCH_SIGMAS beyond what the threshold gives."""
    j = percent / 100
    mismatches = SAMPLES * (1 - j) + SKETCH_SIGMAS * math.sqrt(SAMPLES * j * (1 - j))
    bits = differing_bits(mismatches)
    return math.ceil(bits + math.sqrt(bits))


def minhashes(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """Minima of each set, SAMPLES of them or more; none of the sets is empty."""
    flip, factor = hash_functions(samples)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(flip)), np.uint64)
    for k in range(len(flip)):
        out[:, k] = np.minimum.reduceat((every ^ flip[k]) * factor[k], starts)
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of SAMPLES samples: bit b is set where an odd number of (sample, minimum) hash to b."""
    minima = minima[:, :SAMPLES]
    bit = mixed(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    cell = bit.astype(np.int64) + SKETCH_BITS * np.arange(len(minima))[:, None]
    counts = np.bincount(cell.ravel(), minlength=SKETCH_BITS * len(minima)).reshape(len(minima), SKETCH_BITS)
    return np.packbits((counts & 1).astype(bool), axis=1)


def band_keys(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    keys = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(minima), b + 1, np.uint64)
        for r in range(rows):
            key = mixed(key * np.uint64(0xA0761D6478BD642F) + minima[:, b * rows + r])
        keys[:, b] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, same (digest of the whole set), bands, sketch; the last three null for an empty set."""
    band_rows, bands = bands_for(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body")
            for a, b in by_bytes(batch.column("size").to_pylist(), SIGNATURE_BYTES):
                sets = shingle_sets(texts.slice(a, b - a), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                same: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if full:
                    minima = minhashes([sets[i] for i in full], band_rows * bands)
                    for i, k, o in zip(full, band_keys(minima, band_rows, bands), odd_sketches(minima)):
                        same[i], keys[i], sketch[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, o.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "same", "bands", "sketch"],
                )

    body = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), F.octet_length(body).alias("size"))
    return rows.mapInArrow(tidy(sign), "doc_id long, n_shingles long, same binary, bands array<long>, sketch binary")


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every sketch of one side and every one of the other."""
    x, y = (s.view(np.uint64).reshape(len(s), -1) for s in (left, right))
    bits = np.empty((len(x), len(y)), np.uint16)
    step = max(1, (1 << 21) // max(1, y.size))
    for a in range(0, len(x), step):
        bits[a : a + step] = np.bitwise_count(x[a : a + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.uint16)
    return bits


def possible(bits: np.ndarray, size: np.ndarray, rows: np.ndarray, cols: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of these rows and columns the sketches and set sizes allow."""
    x, y = size[rows][:, None], size[cols][None, :]
    return (bits <= most_bits(percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))


def stars(sketch: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each member the hub of its star, or itself: hubs are those with the most near neighbours not yet reached."""
    every = np.arange(len(sketch))
    bits = differing(sketch, sketch)
    ok = possible(bits, size, every, every, percent)
    np.fill_diagonal(ok, False)
    near = ok & (bits <= differing_bits(SAMPLES * (1 - percent / 100)))
    hub, alone = every.copy(), ok.any(axis=1)
    while alone.any():
        gain = near[:, alone].sum(axis=1)
        gain = gain if gain.any() else ok[:, alone].sum(axis=1)
        if not gain.any():
            break
        h = int(gain.argmax())
        reached = ok[h] & alone
        hub[reached] = h
        alone &= ~reached
        alone[h] = False
    return hub


def connecting_pairs(sketch: np.ndarray, size: np.ndarray, block: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A few pairs that connect a block, or the hubs of two blocks: each member with its hub, and hubs with hubs."""
    hubs: list[np.ndarray] = []
    blocks = np.unique(block)
    for b in blocks:
        own = np.flatnonzero(block == b)
        hub = stars(sketch[own], size[own], percent)
        moved = np.flatnonzero(hub != np.arange(len(own)))
        if len(blocks) == 1:
            yield from zip(own[hub[moved]].tolist(), own[moved].tolist())
        hubs.append(own[np.setdiff1d(np.unique(hub), moved)] if len(own) else own)
    left, right = hubs[0], hubs[-1]
    ok = possible(differing(sketch[left], sketch[right]), size, left, right, percent)
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1) if len(blocks) == 1 else ok))):
        yield int(left[i]), int(right[j])


def joining_links(sketch: np.ndarray, size: np.ndarray, group: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join different groups of a bucket, or of two of its blocks; a group is joined to another once.

    Sketches say which members may have a partner outside their group; the common shingles of such a member with
    all others are counted at once, from lists of the members that have each shingle.
    """
    m, top = len(sets), {g: g for g in group.tolist()}

    def root(g: int) -> int:
        while top[g] != g:
            top[g] = g = top[top[g]]
        return g

    every, lengths = np.arange(m), np.fromiter(map(len, sets), np.int64, m)
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    owner = np.repeat(every, lengths)[order]
    known, first = np.unique(shingles[order], return_index=True)
    last = np.append(first[1:], len(shingles))
    names, counts = np.unique(group, return_counts=True)
    rows = np.flatnonzero(group != names[counts.argmax()])
    two = bool((block != block[0]).any())
    for a in range(0, len(rows), 256):
        own = rows[a : a + 256]
        ok = possible(differing(sketch[own], sketch), size, own, every, percent) & (group[own][:, None] != group[None, :])
        if two:
            ok &= block[own][:, None] != block[None, :]
        for k in np.flatnonzero(ok.any(axis=1)).tolist():
            r = int(own[k])
            at = np.searchsorted(known, sets[r])
            low, many = first[at], last[at] - first[at]
            ends = np.cumsum(many)
            common = np.bincount(owner[np.repeat(low - (ends - many), many) + np.arange(ends[-1])], minlength=m)
            for c in np.flatnonzero(ok[k] & (100 * common >= percent * (size[r] + size - common))).tolist():
                p, q = root(int(group[r])), root(int(group[c]))
                if p != q:
                    top[max(p, q)] = min(p, q)
                    yield r, c


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows in runs of equal keys, several runs at a time, none of them cut."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        at = [rows.column(c).to_numpy() for c in keys]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in at]))
        whole = int(other[-1]) + 1 if len(other) else 0
        if whole:
            yield rows.slice(0, whole)
        held = rows.slice(whole)
    if held is not None:
        yield held


def pair_batches(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b in batches."""
    while rows := list(islice(found, 100_000)):
        both = np.sort(np.array(rows, np.int64).reshape(-1, 2), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def compared(members: DataFrame, every: bool) -> DataFrame:
    """Bucket members (key, members, total, doc, size, sketch, group, ...) dealt to the tasks (key, i, j) that compare them.

    A bucket of more than BLOCK members, or of more than BLOCK_SHINGLES shingles, is dealt into blocks, and each
    task compares two of them, so that no task holds a whole bucket: all pairs of blocks if `every`, else each
    block with itself and with the first.
    """
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    whole = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = F.when(F.col("block") == 0, whole).otherwise(F.array(F.lit(0), F.col("block")))
    dealt = dealt.withColumn("other", F.explode(whole if every else first)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.drop("blocks", "other", "members", "total").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def runs(rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, list[tuple[int, int]]]:
    """The columns, the sketches, and the ranges of rows of one task (key, i, j) each that have something to compare."""
    cols = {c: rows.column(c).to_numpy() for c in ("key", "i", "j", "doc", "size", "group", "block")}
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    cut = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([np.diff(cols[c]) != 0 for c in ("key", "i", "j")]), [True])))
    block = cols["block"]
    spans = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b - a > 1 and (cols["i"][a] == cols["j"][a] or (block[a:b] != block[a]).any())]
    return cols, sketch, spans


def proposed(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b that connect each bucket: few for each member."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, ["key", "i", "j"]):
            cols, sketch, spans = runs(rows)
            doc = cols["doc"]
            yield from pair_batches((doc[a + x], doc[a + y]) for a, b in spans for x, y in connecting_pairs(sketch[a:b], cols["size"][a:b], cols["block"][a:b], percent))

    return compared(members, every=False).mapInArrow(tidy(propose), "a long, b long").distinct()


def suspects(members: DataFrame, percent: int) -> DataFrame:
    """key, doc: members that by their sketches may have a partner of another group in their bucket."""

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, ["key", "i", "j"]):
            cols, sketch, spans = runs(rows)
            found = np.zeros(rows.num_rows, bool)
            for a, b in spans:
                group, block, size = (cols[c][a:b] for c in ("group", "block", "size"))
                if (group == group[0]).all():
                    continue
                every, two = np.arange(b - a), (block != block[0]).any()
                names, counts = np.unique(group, return_counts=True)
                few = np.flatnonzero(group != names[counts.argmax()])
                for x in range(0, len(few), 256):
                    own = few[x : x + 256]
                    ok = possible(differing(sketch[a:b][own], sketch[a:b]), size, own, every, percent) & (group[own][:, None] != group[None, :])
                    if two:
                        ok &= block[own][:, None] != block[None, :]
                    found[a + own[ok.any(axis=1)]] = True
                    found[a:b] |= ok.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(cols["key"][found]), pa.array(cols["doc"][found])], ["key", "doc"])

    return compared(members, every=True).mapInArrow(tidy(suspect), "key long, doc long").distinct()


def joined(members: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links a < b that join different groups within a bucket, confirmed on full sets where the bucket is compared.

    Only members that the sketches do not rule out take their sets along.
    """

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("bytes").to_pylist(), SIGNATURE_BYTES):
                sets = shingle_sets(batch.column("body").slice(a, b - a), words)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc", "shingles"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, ["key", "i", "j"]):
            cols, sketch, spans = runs(rows)
            doc, group = cols["doc"], cols["group"]
            sets = lambda a, b: [np.frombuffer(x, np.uint64) for x in rows.column("shingles").slice(a, b - a).to_pylist()]
            yield from pair_batches(
                (doc[a + x], doc[a + y]) for a, b in spans if (group[a:b] != group[a]).any()
                for x, y in joining_links(sketch[a:b], cols["size"][a:b], group[a:b], cols["block"][a:b], sets(a, b), percent)
            )

    members = stored(members.join(suspects(members, percent), ["key", "doc"], "left_semi"))
    sets = texts_of(members.select("doc"), docs, id_col, text_col).dropDuplicates(["doc"]).withColumn("bytes", F.octet_length("body")).mapInArrow(tidy(with_sets), "doc long, shingles binary")
    return compared(members.join(sets, "doc"), every=True).mapInArrow(tidy(join), "a long, b long").distinct()


def texts_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, body of the documents wanted (doc). These are written first, so that few of them can be broadcast by size."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("body"))
    return texts.join(stored(wanted.distinct()), "doc", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a written table) whose full shingle sets meet the threshold."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")), docs, id_col, text_col)
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("body").alias("left")), "a").join(texts.select(F.col("doc").alias("b"), F.col("body").alias("right")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(c) for c in ("a", "b", "left", "right"))
            keep, last, ours = [], None, set()
            for k in range(batch.num_rows):
                y = b[k].as_py()
                if y != last:
                    last, ours = y, exact_shingles(right[k].as_py(), words)
                theirs = exact_shingles(left[k].as_py(), words)
                common = len(ours & theirs)
                if 100 * common >= percent * (len(ours) + len(theirs) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])

    return both.mapInArrow(tidy(confirm), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach from each linked node.

    Alternating large-star and small-star steps; every step groups by node with partial aggregation, and its
    result is a written table. It ends when a round leaves the links as they were.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Two documents are linked when 100 * common shingles >= percent * shingles of either; a component is what
    links reach, named by its smallest id. Equal shingle sets form classes, of which only the smallest id goes
    on. MinHash bands put these into buckets; within a bucket odd sketches rule out what cannot meet the
    threshold and choose a few pairs that connect it, which full shingle sets confirm. In buckets that still hold
    several components, every member that may have a partner in another one is compared with all of them on full
    sets, so no link is lost to the choice (the bands miss a pair at the threshold with a chance of BAND_MISS);
    only links that join two components leave the task.

    Words are what white space separates, A-Z as a-z. A text of fewer words than a shingle is one shingle; null
    and empty texts have none and are linked with nothing, nor are rows without an id (component_id null, kept).
    Ids of any type that has an order will do; those that are no integers are numbered first. Rows that repeat an id
    are one document. Other columns are not read. An empty table gives an empty result.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
        number = stored(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("number", F.monotonically_increasing_id()))
        numbered = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).join(number, "id", "left")
        found = near_duplicates(numbered, words, percent, "number", "body").join(number.select(F.col("id").alias("own"), F.col("number").alias("doc_id")), "doc_id", "left")
        found = found.join(number.select(F.col("id").alias("root"), F.col("number").alias("component_id")), "component_id", "left")
        return found.select(F.col("own").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), "kept")
    signed = stored(signatures(docs, words, percent, id_col, text_col))
    classes = signed.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"))
    linked = signed.where("doc_id is not null and same is not null")
    reps = stored(linked.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "bands", "sketch"))

    spread = reps.select("doc", "size", F.explode("bands").alias("key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("members"), F.sum("size").alias("total")).where("members > 1")
    buckets = spread.drop("size").join(crowded, "key")
    members = stored(buckets.join(reps.select("doc", "size", "sketch"), "doc"))

    chosen = stored(proposed(members.withColumn("group", F.col("doc")), percent))
    first = stored(confirmed(chosen, docs, words, percent, id_col, text_col))
    roots = components(first)

    grouped = members.join(roots, members["doc"] == roots["node"], "left").withColumn("group", F.coalesce("root", "doc")).drop("node", "root")
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    second = stored(joined(stored(grouped.join(open_keys, "key", "left_semi")), docs, words, percent, id_col, text_col))
    roots = components(second.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))

    # Written, so that a class of very many copies is dealt by an exchange that Spark may split.
    named = stored(classes.join(roots, classes["rep"] == roots["node"], "left").select("same", F.coalesce("root", "rep").alias("component")))
    out = signed.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component of near_duplicates, with all its columns: that of the smallest id. Of rows that repeat that id and its text, one stays; so it is with rows without an id."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col))
    return one_row_each(docs.join(gone.distinct(), id_col, "left_anti").select(*docs.columns), docs, id_col, text_col)
