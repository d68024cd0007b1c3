"""The corpus operators against brute force, on edge cases and on the smallest tables."""

import collections
import functools
import hashlib
import html
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from marlstone.llm import decontam, exact_dedup, html_main, langid, licenses, line_dedup, near_dup, packing, queries, sharding, shingles, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash with working ones.
EDGES = [
    (1, "the same text here again and again", "en", "a", 1), (2, "the same text here again and again", "en", "b", 1), (2, "the same text here again and again", "en", "b", 1),
    (3, "", "en", "a", 0), (4, None, None, None, None), (5, "   \n\t ", "de", "c", 3), (6, "word " * 30_000 + "end", "en", "a", 1), (7, "1234 !!", "fr", "a", 1),
    (8, "x" * 5000 + " <|endoftext|> it's ok  double\n\nlines", "en", "d", 1), (9, "Une été à Paris, c'est déjà l'hiver. Œuvre ﬁn İstanbul H̱", "fr", "e", 1), (None, "no id at all but a text of words", "en", "f", 1), (10, "a", "en", "g", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({"body": F.lit("clash"), "digest": F.lit(1), "size": F.lit(2), "key": F.lit(3), "same": F.lit(4), "row": F.lit(5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_exact_dedup_edges(edges, empty):
    rows = exact_dedup.exact_dedup(edges).collect()
    assert len(rows) == len(EDGES)
    of = collections.defaultdict(list)
    for i, t, *_ in EDGES:
        of[t or ""].append(i)
    by_id = {i: t or "" for i, t, *_ in EDGES}
    for r in rows:
        group = of[by_id[r.doc_id]]
        assert r.group_size == len(group) and r.keep_id == max((x for x in group if x is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_compares_content(docs):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup.exact_dedup(docs)) == key(exact_dedup.exact_dedup(docs, digest=lambda c: F.pmod(F.crc32(c), F.lit(20))))


def test_drop_copies(edges):
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 4, 5, 6, 7, 8, 9, 10]
    again = edges.unionByName(edges.withColumn("n_chars", F.col("n_chars") + 1))
    rows = exact_dedup.drop_copies(again).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 2, 4, 5, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours = queries.queries()[name](spark, sf).toPandas()
    theirs = con.execute(queries.oracle_sql()[name]).df()[list(ours.columns)]
    assert sorted(map(repr, ours.astype(str).values.tolist())) == sorted(map(repr, theirs.astype(str).values.tolist()))


def test_token_counts(edges, empty, docs, texts):
    t = tokenizer(BYTE_BPE)
    for df, known in ((edges, {i: x or "" for i, x, *_ in EDGES}), (docs, texts)):
        for r in token_counts.token_counts(df, BYTE_BPE).collect():
            n = len(t.encode(known[r.doc_id], add_special_tokens=False))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(known[r.doc_id].encode()), n, n > 512)
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


ODD = st.text(st.sampled_from("ab .,!'s19\n\t  éÀ́<|>endoftext"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_units_add_up(found):
    t = tokenizer(BYTE_BPE)
    assert token_counts.counter(BYTE_BPE).count(found) == [len(t.encode(x, add_special_tokens=False)) for x in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_word_encoder(found):
    t = tokenizer(WORD_BPE)
    ids, at = packing.encoder(WORD_BPE).encode(pa.array(found), 1)
    for x, a, b in zip(found, at, at[1:]):
        assert ids[a:b].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name", ["edges", "docs"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    t = tokenizer(WORD_BPE)
    pieces = packing.pack_tokens(df.where("doc_id is not null").dropDuplicates(["doc_id"]), WORD_BPE).toPandas()
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.where("doc_id is not null").collect()}
    assert set(pieces.doc_id) == set(ids)
    for d, g in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    fills = []
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
        fills.append(g.length.sum())
    assert sum(fills) == sum(map(len, ids.values())) and (name == "edges" or sum(fills) > 0.97 * 2048 * len(fills))


def test_packing_repeats_and_empty(edges, empty):
    assert packing.pack_tokens(empty, WORD_BPE).count() == 0
    twos = packing.pack_tokens(edges, WORD_BPE).where("doc_id = 2 or doc_id is null").collect()
    assert len(twos) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=10), st.integers(1, 5))
def test_minimax(sizes, shards):
    cuts = sharding.minimax_cuts(sizes, shards)
    bounds = [0, *cuts, len(sizes)]
    assert len(cuts) < shards and bounds == sorted(bounds)
    best = [0] + [10**9] * len(sizes)
    for _ in range(shards):
        best = [min([best[j]] + [max(best[i], sum(sizes[i:j])) for i in range(j)]) for j in range(len(sizes) + 1)]
    assert max((sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])), default=0) == best[-1]


def test_sharding(edges, empty, docs, texts):
    got = sharding.shard_by_bytes(docs).toPandas()
    assert len(got) == len(texts) and got.shard.between(0, 39).all() and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    got["text"] = got.doc_id.map(texts)
    assert got.groupby("text").shard.nunique().max() == 1
    assert all(r.size_ == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in got.rename(columns={"size": "size_"}).itertuples())
    odd = sharding.shard_by_bytes(edges).collect()
    assert len(odd) == len(EDGES) and next(r for r in odd if r.doc_id == 4)["size"] == 16
    assert sharding.shard_by_bytes(empty).count() == 0


def components_by_force(known, words, percent):
    sets = {d: shingles.exact_shingles(t, words) for d, t in known.items()}
    parent = {d: d for d in known}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in known}


def variants(seed=1):
    """Texts in groups: one with a base that all others are near, one of one-word edits in a chain, copies, and loners."""
    generator = random.Random(seed)
    word = lambda: "".join(generator.choices("abcdefghij", k=6))
    out = []
    base = [word() for _ in range(120)]
    out.append(" ".join(base))
    for _ in range(25):
        edit = list(base)
        for k in generator.sample(range(120), 3):
            edit[k] = word()
        out.append(" ".join(edit))
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = list(chain)
        chain[generator.randrange(100)] = word()
        chain[generator.randrange(100)] = word()
        out.append(" ".join(chain).upper())
    out += [" ".join(word() for _ in range(60)) for _ in range(20)]
    out += [out[3]] * 4 + ["two words"] * 2 + ["two", "", None]
    generator.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rows = variants()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    expected = components_by_force({i: t or "" for i, t in rows}, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_blocks(spark, monkeypatch):
    """Buckets larger than a block give the same components."""
    rows = variants(2)
    expected = components_by_force({i: t or "" for i, t in rows}, 3, 85)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_members_near_but_not_linked(spark, monkeypatch):
    """A large group below the threshold, with one late member that links two components, is settled inside its buckets."""
    generator = random.Random(9)
    word = lambda: "".join(generator.choices("abcdefghij", k=6))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(60):
        edit = list(base)
        for k in generator.sample(range(100), 4):
            edit[k] = word()
        rows.append((i, " ".join(edit)))
    rows.append((999, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        expected = components_by_force(dict(rows), 3, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 3, percent).collect()} == expected
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 1000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 3, 90).collect()} == expected


def test_near_duplicates_edges(edges, empty):
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(edges).collect()}
    assert got[2] == (1, False) and got[1] == (1, True) and got[3] == (3, True) and got[None] == (None, True)
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.drop_near_duplicates(edges).columns == edges.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZé \t\x0b\n "), max_size=30), min_size=1, max_size=5), st.integers(2, 4))
def test_shingle_hashes_match_shingles(found, words):
    sets = shingles.shingle_sets(pa.array(found), words)
    exact = [shingles.exact_shingles(x, words) for x in found]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    for a in range(len(found)):
        for b in range(len(found)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(exact[a] & exact[b])


def test_word_hashes_over_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000))
    whole = shingles.shingle_sets(pa.array([text, "w1 w2 w3"]), 3)
    monkeypatch.setattr(shingles, "CHUNK", 100)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(pa.array([text, "w1 w2 w3"]), 3)))


def test_odd_sketch_estimates():
    generator = np.random.default_rng(0)
    for share in (0.7, 0.85, 0.95):
        common = generator.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        sets = [np.concatenate([common, generator.integers(0, 2**63, int(2000 * (1 - share) / 2), dtype=np.uint64)]) for _ in range(2)]
        sketch = near_dup.odd_sketches(near_dup.minhashes(sets))
        bits = int(near_dup.differing(sketch, sketch)[0, 1])
        assert abs(bits - near_dup.differing_bits(near_dup.SAMPLES * (1 - share))) < 30
        assert share < 0.85 or bits <= near_dup.most_bits(85)


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_myers(pattern, text):
    assert decontam.Myers(pattern).search(text)[0] == least_distance(pattern, text)


def test_decontamination_finds_edits(spark):
    generator = random.Random(4)
    word = lambda: "".join(generator.choices("abcdefghijklm", k=generator.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, None), (51, "..."), (52, "short one")]
    rows = []
    for i, item in items[:12]:
        spoilt = list(item.upper() if i % 2 else item)
        for k in generator.sample(range(len(spoilt)), i):
            spoilt[k] = generator.choice(["", "z", " ", spoilt[k] * 2])
        rows.append((i, " ".join(word() for _ in range(50)) + " " + "".join(spoilt) + ", " + " ".join(word() for _ in range(50))))
    rows += [(100, "nothing of the kind"), (101, None), (102, ""), (103, "a Short,  ONE here"), (104, "ashort onehere")]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = {}
    for d, t in rows:
        for i, item in items:
            p, q = decontam.plain(item or ""), decontam.plain(t or "")
            if p:
                n = least_distance(p, q)
                if n <= int(decontam.ERROR_RATE * len(p)):
                    expected[d, i] = n
    assert {(r.doc_id, r.item_id): r.distance for r in got} == expected and (103, 52) in expected and len(expected) > 8


def test_decontamination_in_blocks(spark, sf, docs, texts, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if decontam.plain(x) in decontam.plain(t)}
    whole = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs, bench).collect()}
    monkeypatch.setattr(decontam, "ITEM_BLOCK_BYTES", 2000)
    assert exact <= whole == {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs, bench).collect()}
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in whole}


def test_decontamination_edges(edges, empty, spark):
    bench = spark.createDataFrame([(1, "the same text here again and again")], "item_id long, text string")
    assert sorted((r.doc_id, r.distance) for r in decontam.decontaminate(edges, bench).collect()) == [(1, 0), (2, 0)]
    assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(edges, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(edges, bench.limit(0)).count() == len(EDGES)


def test_language_id(spark, docs, edges, empty):
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(edges).collect()}
    assert odd[4] == odd[3] == odd[5] == odd[7] == ("und", 0.0) and odd[6][0] != "und"
    assert langid.identify_languages(empty).count() == 0
    assert {r.doc_id for r in langid.keep_identified(edges).collect()} == {1, 2, 6, 8, 9, None, 10}
    assert {r.lang_pred for r in langid.identify_languages(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_presence_kernel():
    texts = [b"banana", b"bandana", b"xyz", b""]
    c = langid.KernelClassifier(texts[:3], ["a", "a", "b"])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    got = c.kernel(texts)
    order = sorted(range(3), key=lambda i: (["a", "a", "b"][i], i))
    for i, t in enumerate(texts):
        for j, m in enumerate(order):
            p, q = grams(t), grams(texts[m])
            assert got[i, j] == pytest.approx(len(p & q) / max(1e-9, (len(p) * len(q)) ** 0.5) if p else 0, abs=1e-6)


def test_license_scan(spark, docs, texts, edges, empty):
    got = licenses.scan_licenses(docs).toPandas()
    for name, notice in (("Apache-2.0", licenses.TEMPLATES[3][1]), ("GPL-3.0", licenses.TEMPLATES[5][1]), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("MIT", licenses.TEMPLATES[0][1])):
        assert {d for d, t in texts.items() if notice in t} <= set(got[got.license == name].doc_id)
    assert set(got.doc_id) == {d for d, t in texts.items() if any(n in t for _, n in licenses.TEMPLATES)}
    grant = licenses.TEMPLATES[2][1]
    near = grant.replace("charge", "cost").upper()
    rows = spark.createDataFrame([(1, "intro " * 37 + near + " more"), (2, grant[: len(grant) // 3]), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan_licenses(rows).collect()] == [(1, "MIT")]
    assert licenses.scan_licenses(edges).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_line_dedup(spark, edges, empty):
    rows = [(i, f"own line {i}\n  shared line \n\nshared by few {i % 3}" + ("\nrare" if i < 7 else ""), "en", f"site{i % 12}", 1) for i in range(36)]
    got = {r.doc_id: r for r in line_dedup.clean_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == "own line 0\n\nshared by few 0\nrare" and (got[0].n_lines, got[0].n_removed) == (5, 1)
    odd = {r.doc_id: r.text for r in line_dedup.clean_lines(edges).collect()}
    assert odd[5] == "   \n\t " and odd[4] == "" and line_dedup.clean_lines(edges).count() == len(EDGES)
    assert line_dedup.clean_lines(empty).count() == 0


def article_by_force(page):
    inner = re.search(r"(?s)<article>(.*?)(</article>|<footer>|\Z)", page)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>?", inner)]
    return " ".join(b for b in blocks if b)


def test_html_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_main.extract_main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == article_by_force(source[r.page_id]) and r.n_chars == len(r.text)


def test_html_rules(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-menu"><header>H</header><nav><ul><li>m</ul></nav>
    <div id="cookie-notice">c</div><main><h1>One &amp; <b>t</b>wo</h1><!-- x --><p>a&nbsp;b<br>c <p>d&lt;e<form><input>f</form><aside>g</aside><div class='comments'><p>h</div></main><footer>z</footer></body>"""
    template = "<html><body><div><p>Read more at our site</p></div><p>{}</p></body></html>"
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "bad url", "")] + [(10 + i, f"http://B.y:80/{i}", template.format(f"story {i}")) for i in range(8)] + [(30, "http://c.z/", template.format("story 1"))]
    got = {r.page_id: r.text for r in html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One & two a b c d<e" and got[2] == "" and got[3] == ""
    assert got[12] == "story 2" and got[30] == "Read more at our site story 1"
    assert html_main.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, sf, texts):
    import corpus_pipeline
    from marlstone.llm.common import stored

    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    left = {d: t for d, t in texts.items() if any(unicodedata.category(c)[0] == "L" for c in t)}
    assert kept["language_id"] == set(left)
    last = {t: d for d, t in sorted(left.items())}
    assert kept["exact_dedup"] == set(last.values())
    left = {d: texts[d] for d in last.values()}
    roots = components_by_force(left, 5, 80)
    assert kept["near_dedup"] == {d for d, (_, r) in roots.items() if d == r}
    plain = [decontam.plain(x) for x in bench]
    clean = {d for d in kept["near_dedup"] if not any(p in decontam.plain(texts[d]) for p in plain)}
    assert kept["decontamination"] == clean
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").collect()} == clean


def main_text(source):
    page = html_main.Page(source)
    return " ".join(t for t, gone in zip(page.blocks, page.ruled) if not gone)


def test_html_raw_elements():
    assert main_text("<script>for(i=0;i<n;i++){f(i)}</script><p>Text</p>") == "Text"
    assert main_text("<style>a<b{c:d}</STYLE ><p>one</p><textarea>x<y</textarea><script src=/a/>1<c</script\n><p>two</p>") == "one two"
    assert main_text("<script>'</scripted>' <p>no</script><p>yes</p>") == "yes"
    assert main_text("<svg><title/><style/></svg><p>after</p><script>if(a<b) no") == "after"
    assert main_text("<p>a</p><xmp>if (a <b) c</xmp><p>d</p><xmp>e <f") == "a if (a <b) c d e <f"


@pytest.mark.parametrize("wrapper", ['div class="content no-sidebar"', 'article class="post comments-open"', 'section id="side-effects"', 'div class="content sidebar"', 'div id="comments"'])
def test_html_classes_lose_no_article(wrapper):
    tag = wrapper.split()[0]
    title = "<h1>Title</h1>" if tag != "article" else ""
    assert main_text(f"<body><{wrapper}>{title}<p>The text.</p></{tag}></body>") == ("Title " if title else "") + "The text."
    assert main_text(f"<body><div class='sidebar'>x</div><{wrapper}><article><p>The text.</p></article></{tag}></body>") == "The text."


def test_html_classes_that_go():
    assert main_text("<p>a<span class='ad x'>b</span>c</p><div id=nav-menu>d<p>e</div><div class='x related'>f</div><p>g") == "ac g"
    assert main_text("<div>a<a class=promo>b<div>c</div>d</a>e</div>") == "a e"
    assert main_text("<div id=x><h1>T</h1><p>text</p></div><div class=comments><article>c</article></div>") == "T text c"
    assert main_text("<nav><h1>n</h1></nav><div class=menu><nav><h1>m</h1></nav>k</div><main>t<div class=share>s</div></main>") == "t"
    assert main_text("<h1 class=banner>T</h1><p>a") == "T a"


def extracted(spark, pages, **options):
    rows = [(i, f"http://{host}/{i}", source) for i, (host, source) in enumerate(pages)]
    return [r.text for r in html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).orderBy("page_id").collect()]


def test_html_template_of_one_section(spark):
    """On a host of 1,000 pages a sidebar of 150 goes; a passage of 99, too rare for both bars, stays until the bar falls."""
    story = lambda i: f"<p>story {i}</p>" + ("<div>section box</div>" if i < 150 else "") + ("<div>quoted box</div>" if i < 99 else "")
    got = extracted(spark, [("h", story(i)) for i in range(1000)], many_pages=100)
    assert got == [f"story {i}" + (" quoted box" if i < 99 else "") for i in range(1000)]
    assert extracted(spark, [("h", story(i)) for i in range(1000)]) == [f"story {i}" for i in range(1000)]


def test_html_template_in_main(spark):
    """A notice in main on all pages of a host goes, as do list items; a passage on less than half of them stays."""
    page = lambda i: f"<main><p>Notice.</p><p>story {i}</p><ul><li>Share<li>item {i}</ul>" + ("<p>quoted</p>" if i < 9 else "") + "</main>"
    got = extracted(spark, [("h", page(i)) for i in range(20)] + [("few", page(i)) for i in range(4)])
    quoted = lambda i: " quoted" if i < 9 else ""
    assert got[:20] == [f"story {i} item {i}{quoted(i)}" for i in range(20)]
    assert got[20:] == [f"Notice. story {i} Share item {i} quoted" for i in range(4)]


def test_language_of_long_texts_is_learned(spark):
    """Language bb has texts of more than TRAINING_BYTES only, cc one such text besides a short one."""
    rng = random.Random(3)
    words = {x: ["".join(rng.choice(abc) for _ in range(5)) for _ in range(60)] for x, abc in (("aa", "abcdefg"), ("bb", "mnopqrs"), ("cc", "tuvwxyz"))}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, say(x, n), x) for i, (x, n) in enumerate([("aa", 50)] * 40 + [("bb", 3000 + 50 * k) for k in range(40)] + [("cc", 50)] + [("cc", 3000)] * 4)]
    assert all(len(t) > langid.TRAINING_BYTES for _, t, x in rows if x == "bb")
    rows += [(1000 + i, say(x, 30), None) for i, x in enumerate(["aa", "bb", "cc"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert all(got[i] == x for i, _, x in rows if x) and all(got[1000 + i] == x for i, x in enumerate(["aa", "bb", "cc"] * 5))
    keyed = docs.where("lang is not null").selectExpr("lang", "text as body", "xxhash64(doc_id) as order", "cast(octet_length(text) as long) as size")
    texts = [t for _, t, x in rows if x == "bb"]
    assert langid.longer_rows(keyed, {"bb": 4}, 250) == [("bb", k + 1, texts[k]) for k in range(3)]  # a fourth is beyond 4 x TRAINING_BYTES


def test_nothing_learned_keeps_texts(spark, edges):
    want = {1, 2, 6, 8, 9, None, 10}
    assert {r.doc_id for r in langid.keep_identified(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == want
    long = spark.createDataFrame([(i, "word " * 5000, "en") for i in range(8)], "doc_id long, text string, lang string")
    assert langid.keep_identified(long).count() == 8
