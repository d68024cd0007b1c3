"""Corpus operators on nulls, ties, repeats, odd ids, long texts and keys that hold a third of all rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from marlstone.llm import common, decontam, exact_dedup, html_main, langid, licenses, line_dedup, near_dup, packing, sharding, shingles

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def main_text(source):
    page = html_main.Page(source)
    return " ".join(t for t, gone in zip(page.blocks, page.ruled) if not gone)


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "key": F.lit("y"), "text": F.lit("z"), "hash": F.lit(1)})
    return html_main.extract_main_text(df).collect()


def test_html_attributes_are_read_whole():
    assert main_text('<div style="overflow: hidden">a</div><div data-hidden="false">b</div><p title="hidden gem">c</p>') == "a b c"
    assert main_text('<p hidden>a</p><p aria-hidden=true>b</p><p role="navigation">c</p><p data-x=\'class="ad"\'>d') == "d"
    assert main_text('<article id="legal-history" class="comment-on-law">a <b class="menu-item">b</b> c</article>') == "a b c"
    assert main_text("<article>teaser</article><div>body</div>") == "teaser body"
    assert main_text("<p>a <span hidden>b</span> c</p>") == "a c"


def test_html_deep_pages_are_linear():
    assert main_text("<div>x" * 20_000) == "x " * 19_999 + "x"
    assert len(html_main.Page("<ul><li><p>x" * 5_000).blocks) == 5_000


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_html_menus_without_names_go_by_counting(spark, monkeypatch, most):
    """No class, role or element name tells these menus and footers, shared or dealt; one page's own second block stays."""
    monkeypatch.setattr(html_main, "SHARED_TEMPLATES", most)
    page = lambda i: f"<html><head><title>t{i}</title></head><body><div><a href=/{i}>Home</a> <a>News</a></div><div><p>story {i}</p><div>own {i}</div></div><div>All rights</div></body></html>"
    got = extracted(spark, [(i, f"http://h.x/{i}", page(i)) for i in range(12)])
    others = extracted(spark, [(i, f"http://h{i}.x/", page(i)) for i in range(3)] + [(i, "http://other/", page(i)) for i in range(4, 9)])
    assert {(r.page_id < 4, r.n_template) for r in others} == {(True, 0), (False, 2)}
    assert {r.page_id: r.text for r in got} == {i: f"story {i} own {i}" for i in range(12)}
    assert {(r.n_blocks, r.n_template, r.n_ruled) for r in got} == {(4, 2, 0)}


def test_html_boilerplate_is_counted_too(spark):
    """Recurring menus go by counting though their element would tell; a rule removes those of a small host."""
    page = lambda i: f"<nav>Home</nav><p>story {i}</p><script>var i={i}</script>"
    got = extracted(spark, [(i, "http://h.x/", page(i)) for i in range(6)] + [(6, "http://few.x/", page(6))])
    assert {r.page_id: (r.text, r.n_template, r.n_ruled) for r in got} == {i: (f"story {i}", int(i < 6), int(i == 6)) for i in range(7)}


def test_html_nulls_and_repeats(spark):
    rows = [(None, None, "<p>a"), (None, None, "<p>a"), (1, "http://h/", None), (1, "http://h/", ""), (2, None, "<p>" + "long " * 300_000)]
    got = extracted(spark, rows)
    assert sorted((r.page_id or 0, len(r.text), r.n_chars) for r in got) == [(0, 1, 1), (0, 1, 1), (1, 0, 0), (1, 0, 0), (2, 1_499_999, 1_499_999)]
    # Copies of a page are one page of the host, so their text is no template.
    assert [r.text for r in extracted(spark, [(i, "http://h/", "<div>same</div>") for i in range(40)])] == ["same"] * 40


def test_letters():
    from marlstone.llm.langid import LETTER

    assert LETTER == r"\p{L}"


def test_language_needs_a_letter(spark):
    rows = [(i, f"the words of line {i}", "en") for i in range(30)] + [(100, "½ ² Ⅷ ① 5", None), (101, "ª", None), (102, "日本", None), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs).collect()}
    assert got[100] == got[103] == ("und", 0.0) and got[101][0] == got[102][0] == "en"
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs).collect()}
    assert set(kept) == set(range(30)) | {101, 102} and set(kept.values()) == {"en"}


def test_many_languages(spark):
    """More languages than there are landmarks for all of LANDMARKS_PER_LANGUAGE."""
    rng = random.Random(1)
    names = [f"l{k}" for k in range(150)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for x in names}
    rows = [(i, " ".join(rng.choices(words[names[i % 150]], k=30)), names[i % 150]) for i in range(900)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.mean([r.lang_pred == names[r.doc_id % 150] for r in got]) > 0.95


def test_folded_model_is_kernel_ridge_regression(monkeypatch):
    """Scores against the textbook formula: kernels of pairs, K^-1/2, weighted ridge regression."""
    rng = random.Random(2)
    texts = [(" ".join("".join(rng.choice(abc) for _ in range(4)) for _ in range(12))).encode() for abc in ("abcd", "cdef", "efgh") for _ in range(20)]
    labels = [x for x in "pqr" for _ in range(20)]
    monkeypatch.setattr(langid, "LANDMARKS_PER_LANGUAGE", 6)
    model = langid.KernelClassifier(texts, labels)
    marks = [i for i in range(60) if i % 20 < 6]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    known = set().union(*(grams(texts[i]) for i in marks))
    k = lambda a, b: len(grams(a) & grams(b) & known) / (len(grams(a) & known) * len(grams(b) & known)) ** 0.5
    square = np.array([[k(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(square)
    features = np.array([[k(t, texts[j]) for j in marks] for t in texts]) @ (vectors / np.sqrt(values))
    features = np.column_stack([features, np.ones(60)])
    targets = np.array([[1.0 if x == y else -1.0 for y in "pqr"] for x in labels])
    solved = np.linalg.solve(features.T @ features / 20 + langid.RIDGE * np.eye(features.shape[1]), features.T @ targets / 20)
    langs, scores = model.predict([t.decode() for t in texts])
    decision = features @ solved
    power = np.exp(langid.SHARPNESS * (decision - decision.max(axis=1, keepdims=True)))
    assert langs == ["pqr"[i] for i in decision.argmax(axis=1)]
    assert np.allclose(scores, power.max(axis=1) / power.sum(axis=1), atol=1e-3)


def containments(text, templates, words=5):
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    own, out = split(text), {}
    for k, (_, t) in enumerate(templates):
        w = split(t)
        n = min(words, len(w))
        if n:
            shingles = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            out[k] = len(shingles & {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}) / len(shingles)
    return {k: v for k, v in out.items() if v >= 0.8}


def test_licenses_by_force(spark, monkeypatch):
    """Edited, cut and short templates in long texts against exact containment, in one block and in many."""
    rng = random.Random(5)
    templates = licenses.TEMPLATES + [("Short", "MIT License"), ("Word", "Beerware"), ("Empty", " -- ")]
    rows = []
    for i, (_, t) in enumerate(templates * 2):
        words = t.split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, "some intro " * 30 + " ".join(words) + " and more of it" * 20))
    rows += [(900, "the mit, license"), (901, None), (902, ""), (None, "MIT License"), (903, "MIT License"), (903, "no license here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "row": F.lit(2)})
    expected = collections.Counter((i, k) for i, k in {(i, k) for i, t in rows for k in containments(t or "", templates)})
    found = lambda: collections.Counter((r.doc_id, r.template) for r in licenses.scan_licenses(docs, templates).collect())
    assert found() == expected and (900, len(templates) - 3) in expected
    monkeypatch.setattr(licenses, "BLOCK_SHINGLES", 60)
    assert found() == expected
    assert licenses.scan_licenses(docs, []).count() == 0


def test_long_license_templates_take_linear_time(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(6_000))
    docs = spark.createDataFrame([(1, "x y z " + text), (2, text[:20_000])], "doc_id long, text string")
    assert [(r.doc_id, r.containment) for r in licenses.scan_licenses(docs, [("Long", text)]).collect()] == [(1, 1.0)]


def test_packing_in_a_tree(spark, monkeypatch):
    """Leftovers of many partitions merge level by level; ids are strings; a long text is encoded in parts."""
    monkeypatch.setattr(packing, "MERGED_TOGETHER", 2)
    monkeypatch.setattr(packing, "SLICE_BYTES", 4_000)
    rng = random.Random(7)
    rows = [(f"d{i}", " ".join("".join(rng.choices("abcdefg", k=4)) for _ in range(rng.choice([3, 40, 300])))) for i in range(120)]
    rows += [("long", "many words, of them " * 3_000), ("none", None), ("empty", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(9)
    got = packing.pack_tokens(docs, WORD_BPE, windows=2).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    sizes = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in rows}
    assert got.groupby("doc_id").length.sum().to_dict() == sizes
    fills = got.groupby("sequence_id").length.sum()
    assert fills.max() <= 2048 and len(fills) <= sum(sizes.values()) / 2048 * 1.25 + 2
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]


def test_encoder_forgets(monkeypatch):
    import pyarrow as pa

    e = packing.WordEncoder(WORD_BPE)
    before = e.encode(pa.array(["some words, more words.", "x" * 100 + " words"]), 1)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 10)
    after = e.encode(pa.array(["some words, more words.", "x" * 100 + " words"]), 1)
    assert all((a == b).all() for a, b in zip(before, after)) and "x" * 100 not in e.known.to_pylist()


def test_lines_of_rows_without_an_id(spark):
    rows = [(i if i % 2 else None, f"own {i}\nshared", f"s{i}") for i in range(20)] + [(50, "own\nshared", "s1"), (50, "other", "s1"), (None, "own 0\nshared", None)]
    got = line_dedup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == collections.Counter((i, t.split("\n")[0], t.count("\n") + 1, t.count("\n")) for i, t, _ in rows)


def test_hot_keys_are_spread(spark):
    rows = spark.range(9_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_keys(facts, ["k"], "n")
    assert [r.k for r in hot.collect()] == [7]
    joined = common.spread_join(rows, facts, ["k"], hot, F.col("id"))
    assert joined.columns == ["k", "id", "n"] and joined.count() == 9_000
    assert {r.n for r in joined.where("k = 7").select("n").distinct().collect()} == {facts.where("k = 7").first().n}
    assert common.spread_join(rows, facts.where("k <> 7"), ["k"], hot, F.col("id"), "left").where("n is null").count() == facts.where("k = 7").first().n


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    class Unset:
        def isEmpty(self):
            return True

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Unset()

    Session.sparkContext._jsc = Jsc()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_stored_tables_go(spark):
    mark = common.stored_so_far()
    first, second = common.stored(spark.range(3)), common.stored(spark.range(4))
    common.delete_stored(spark, mark, but=1)
    assert second.count() == 4 and common.stored_so_far() == mark + 1
    with pytest.raises(Exception):
        first.count()


@pytest.mark.parametrize("percent", [1, 5, 10, 30, 50, 60, 70, 80, 85, 95, 100])
def test_bands_meet_at_every_threshold(percent):
    rows, bands = near_dup.bands_for(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= near_dup.BAND_MISS * 1.0001 and 1 <= rows <= 4


def test_near_duplicates_at_low_thresholds(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 60 - 3 * i] + [f"v{i}x{j}" for j in range(3 * i)])) for i in range(1, 18)]
    for percent in (5, 50):
        sets = {i: shingles.exact_shingles(t, 3) for i, t in rows}
        root = {i: i for i, _ in rows}
        for _ in rows:
            for a in sets:
                for b in sets:
                    common_ = len(sets[a] & sets[b])
                    if 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
                        root[a] = root[b] = min(root[a], root[b])
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()
        assert {r.doc_id: r.component_id for r in got} == root


def test_near_duplicates_of_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text + " x"), ("a", text), ("c", "else"), (None, text), ("a", text), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {("a", 36, "a", True), ("b", 37, "a", False), ("c", 1, "c", True), ("c", 0, "c", True), (None, 36, None, True)}
    kept = sorted(((r.doc_id or "", r.text or "") for r in near_dup.drop_near_duplicates(docs).collect()))
    assert kept == [("", text), ("a", text), ("c", ""), ("c", "else")]


def test_decontamination_of_short_items_and_nulls(spark):
    items = [(1, "fourteen chars"), (2, "short"), (None, "item without id"), (2, "short")]
    rows = [(1, "a fourteen chors b"), (2, "it is short."), (2, "it is short."), (3, "it is shirt"), (None, "an item without id"), (4, "fourteen")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "doc_id": F.lit(2)})
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"body": F.lit(1), "item_id": F.lit(2)})
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.distance) for r in decontam.decontaminate(docs, bench).collect()))
    assert got == [(0, 0, 0), (1, 1, 1), (2, 2, 0)]
    kept = decontam.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4] and kept.columns == docs.columns


def test_slots_of_rows_without_an_id(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 100).alias("text"))
    got = sharding.shard_by_bytes(docs, shards=3).toPandas()
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


EDGES = [(1, "the same text here again and again", "en", "a", 1), (2, "the same text here again and again", "en", "b", 1), (2, "the same text here again and again", "en", "b", 1), (3, "", "en", "a", 0), (4, None, None, None, None), (5, " \n", "de", "c", 3), (None, "no id but a text of words", "en", "f", 1), (6, "planted item of the benchmark in a text", None, "g", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("items", [0, 1])
def test_pipeline_edges(spark, tmp_path, labelled, items):
    import corpus_pipeline

    docs = spark.createDataFrame(EDGES, SCHEMA).withColumns({"item_id": F.lit(1), "body": F.lit("clash"), "key": F.lit(2), "size": F.lit(3)})
    docs = docs if labelled else docs.withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "planted item of the benchmark")][:items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 2] + [6] * (1 - items)


def test_languages_found_in_the_first_stage_reach_packing(spark, tmp_path):
    """A third of the texts has no label, a few have a wrong one, one has a language of too few rows to learn."""
    import corpus_pipeline

    rng = random.Random(8)
    words = {x: ["".join(rng.choice(abc) for _ in range(5)) for _ in range(200)] for x, abc in (("aa", "abcdefg"), ("bb", "mnopqrs"))}
    true = {i: ("aa", "bb")[i % 2] for i in range(240)}
    labels = {i: None if i % 3 == 0 else "bb" if i in (1, 2, 50) else "aa" if i in (5, 7) else x for i, x in true.items()}
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2)
    true[held] = labels[held] = "rare"
    rows = [(i, " ".join(rng.choices(words.get(x, ["odd", "other"]), k=60)), labels[i], "s", 1) for i, x in true.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert dict(zip(got.doc_id, got.lang)) == true
    assert got.groupby("sequence_id").lang.nunique().eq(1).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_packing_by_a_column(spark, monkeypatch):
    """Groups and null apart, through three levels of merging; no token is lost and no id given twice."""
    monkeypatch.setattr(packing, "MERGED_TOGETHER", 2)
    monkeypatch.setattr(packing, "BUCKETS", 2)
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abcdefg", k=4)) for _ in range(rng.choice([3, 40, 300]))), rng.choice(["x", "y", "z", None])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(7)
    got = packing.pack_tokens(docs, WORD_BPE, windows=2, by_col="kind").toPandas()
    alone = packing.pack_tokens(docs, WORD_BPE).toPandas()
    assert list(got.columns) == [*alone.columns, "kind"]
    assert got.groupby("doc_id").length.sum().to_dict() == alone.groupby("doc_id").length.sum().to_dict()
    kinds = {i: x for i, _, x in rows}
    assert all((x if isinstance(x, str) else None) == kinds[i] for i, x in zip(got.doc_id, got.kind))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048 and g.kind.nunique(dropna=False) == 1
    for _, g in got.groupby("kind", dropna=False):
        assert g.sequence_id.nunique() <= g.length.sum() / 2048 * 1.25 + 2


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.where("kept").count() == 2_001 and {(r.keep_id, r.group_size) for r in got.where("doc_id % 3 = 0").collect()} == {(2_997, 1_000)}
