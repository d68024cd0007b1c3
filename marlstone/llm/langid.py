"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_bytes, tidy, whole_text

#: Labelled rows of a language that train the classifier, at most, and of all languages; chosen by a hash of the id.
ROWS_PER_LANGUAGE, TRAINING_ROWS = 250, 32_000
#: Rows of longer texts train only where a language has too few others; every text is read whole, in training as in prediction.
TRAINING_BYTES = 16_000
#: Landmarks of the Nyström approximation for a language, at most, and for all languages.
LANDMARKS_PER_LANGUAGE, LANDMARKS = 32, 1024
#: Languages that are learned, at most: those of the most labelled rows.
MOST_LANGUAGES = 1000
#: Numbers in the model's matrix of n-grams and languages, at most; beyond, the rarest n-grams of the landmarks do not count.
MODEL_SIZE = 1 << 24
#: n-grams of one to so many UTF-8 bytes.
LONGEST_GRAM = 3
RIDGE = 1e-3
#: Texts scored in one matrix product, and landmarks compared in one, at most.
BATCH_ROWS = 128
#: Decision values run from -1 to +1, as the targets do; their softmax is taken at this sharpness for the score.
SHARPNESS = 3.0
UNKNOWN = "und"
#: What a text needs for a language; one test for training, prediction and filtering.
LETTER = r"\p{L}"


def lettered(text: Column) -> Column:
    """Whether there is a letter; false for null."""
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def grams(text: bytes) -> np.ndarray:
    """Codes of all n-grams of 1 to LONGEST_GRAM bytes, with repeats; the length of a gram is part of its code."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    return np.concatenate([b, two + 256, ((two[:-1] << 8) | b[2:]) + (256 + 65536)])


GRAM_CODES = 256 + 65536 + (1 << 24)


def parts(text: bytes) -> Iterator[bytes]:
    """The text in pieces that bound the arrays of its n-grams; they overlap so that no n-gram is lost."""
    for a in range(0, max(1, len(text)), 1 << 20):
        yield text[a : a + (1 << 20) + LONGEST_GRAM - 1]


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class KernelClassifier:
    """Blended-spectrum presence kernel, Nyström map, one-versus-rest kernel ridge regression.

    k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), where G is the set of a text's n-grams of all lengths among
    those that occur in the landmarks. The Nyström map is k(x, landmarks) K^-1/2, and a ridge regression to +1
    and -1 for each language on it gives weights. As k is linear in the presence of n-grams, landmarks and weights
    fold into one matrix of n-grams by languages: all that goes to the tasks, where batches of texts are scored by its
    product with their presence.
    """

    def __init__(self, texts: list[bytes], labels: list[str]):
        self.languages = sorted(set(labels))
        each: dict[str, list[int]] = {x: [] for x in self.languages}
        for i, x in enumerate(labels):
            each[x].append(i)
        many = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(self.languages)))
        marks = [i for x in self.languages for i in each[x][:many]]
        count = np.zeros(GRAM_CODES, np.int32)
        for i in marks:
            count[self.codes_of(texts[i])] += 1
        self.codes = np.flatnonzero(count).astype(np.int32)
        most = max(1, MODEL_SIZE // len(self.languages))
        if len(self.codes) > most:
            self.codes = np.sort(self.codes[np.argsort(-count[self.codes], kind="stable")[:most]])
        self._place: np.ndarray | None = None
        self.marks = [texts[i] for i in marks]
        kernel = self.kernel(self.marks).astype(np.float64)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        good = values > 1e-6 * max(values.max(initial=0.0), 1e-12)
        to_features = vectors[:, good] / np.sqrt(values[good])
        rows = np.concatenate([self.kernel(texts[a : a + BATCH_ROWS]) for a in range(0, len(texts), BATCH_ROWS)]) if texts else np.zeros((0, len(marks)))
        features = np.column_stack([rows @ to_features, np.ones(len(texts))])
        targets = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        share = np.array([len(each[x]) for x in labels], float)
        weighted = features / share[:, None]  # each language weighs the same
        solved = np.linalg.solve(features.T @ weighted + RIDGE * np.eye(features.shape[1]), weighted.T @ targets)
        weights = to_features @ solved[:-1]
        self.bias = solved[-1].astype(np.float32)
        folded = np.zeros((len(self.codes), len(self.languages)))
        for a in range(0, len(self.marks), BATCH_ROWS):
            folded += self.landmarks(a) @ weights[a : a + BATCH_ROWS]
        self.folded = folded.astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None, "marks": []}

    @staticmethod
    def codes_of(text: bytes) -> np.ndarray:
        return np.unique(np.concatenate([np.unique(grams(part)) for part in parts(text)]))

    def presence(self, texts: list[bytes]) -> np.ndarray:
        if self._place is None:
            self._place = np.zeros(GRAM_CODES, np.int32)  # 0: not a code; untouched zeros take no memory
            self._place[self.codes] = np.arange(1, len(self.codes) + 1, dtype=np.int32)
        out = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in zip(out, texts):
            for part in parts(text):
                row[self._place[grams(part)]] = 1
        return out[:, 1:]

    @staticmethod
    def norms(presence: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))

    def landmarks(self, start: int) -> np.ndarray:
        """n-grams by the landmarks from `start` on, at most BATCH_ROWS, each of length 1."""
        presence = self.presence(self.marks[start : start + BATCH_ROWS])
        return (presence / self.norms(presence)).T

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """The texts' kernel with every landmark, while fitting."""
        presence = self.presence(texts)
        return np.concatenate([presence @ self.landmarks(a) for a in range(0, len(self.marks), BATCH_ROWS)], axis=1) / self.norms(presence)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The best language of each text, and its share of the softmax over decision values."""
        presence = self.presence([normal(x) for x in texts])
        decision = (presence @ self.folded) / self.norms(presence) + self.bias
        best = decision.argmax(axis=1)
        power = np.exp(SHARPNESS * (decision - decision.max(axis=1, keepdims=True)).astype(np.float64))
        return [self.languages[i] for i in best], (power.max(axis=1) / power.sum(axis=1)).tolist()


def held_out(doc_id: str):
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> KernelClassifier | None:
    """Learn from at most `rows` labelled rows of each language that are not held out; None if there are none.

    Of more than MOST_LANGUAGES languages those of the most rows are learned; of very many, fewer rows of each, so that
    TRAINING_ROWS bounds the sample.
    A language's rows are those of up to TRAINING_BYTES of greatest hash of the id. If they are fewer than `rows`, its
    shortest longer texts fill up the rest, whole, as long as they stay within TRAINING_BYTES on average; one trains in
    any case. So the sample is bounded, and a language of longer texts alone is learned. Counts of languages come first,
    so that only about twice the rows wanted of a language are dealt by it, however common it is; longer texts are
    chosen by their sizes before any is read.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & lettered(F.col(text_col)))
    keyed = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body"), F.xxhash64(F.col(id_col)).alias("order"), F.octet_length(text_col).cast("long").alias("size"))
    short = F.col("size") <= TRAINING_BYTES
    found = keyed.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n"), F.count(F.when(~short, 1)).alias("longer"))
    counts = {r["lang"]: (r["n"], r["longer"]) for r in found.orderBy(F.desc(F.col("n") + F.col("longer")), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return None
    rows = max(1, min(rows, TRAINING_ROWS // len(counts)))
    few = F.lit(False)
    for lang, (n, _) in sorted(counts.items()):
        least = F.lit(-(2**63)) if n <= 4 * rows else F.lit(2**63 - 1 - int(2**64 * min(1.0, 2.5 * rows / n)))
        few = few | (F.col("lang") == lang) & ((F.col("order") >= least) if n > 4 * rows else F.lit(True))
    ranked = keyed.where(short & few).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("order"), "body")))
    sample = sorted((r["lang"], r["rank"], r["body"]) for r in ranked.where(F.col("rank") <= rows).collect())
    sample += longer_rows(keyed.where(~short), {lang: rows - n for lang, (n, longer) in counts.items() if n < rows and longer}, rows)
    sample.sort(key=lambda r: r[0])  # stable: a language's longer texts come after its others
    return KernelClassifier([normal(x) for _, _, x in sample], [x for x, _, _ in sample])


def longer_rows(keyed: DataFrame, wanted: dict[str, int], rows: int) -> list[tuple[str, int, str]]:
    """lang, rank, body of the shortest texts of each wanted language: at most so many, of TRAINING_BYTES each on average, but one at least."""
    if not wanted:
        return []
    rank = F.row_number().over(W.partitionBy("lang").orderBy("size", F.desc("order")))
    sizes = keyed.where(F.col("lang").isin(list(wanted))).select("lang", "size", "order").withColumn("rank", rank).where(F.col("rank") <= rows).collect()
    keys: dict[str, list[tuple[str, int, int]]] = {}
    left = {lang: n * TRAINING_BYTES for lang, n in wanted.items()}
    for r in sorted(sizes, key=lambda r: (r["lang"], r["rank"])):
        own = keys.setdefault(r["lang"], [])
        left[r["lang"]] -= r["size"]
        if not own or left[r["lang"]] >= 0 and len(own) < wanted[r["lang"]]:
            own.append((r["lang"], r["size"], r["order"]))
    chosen = keyed.sparkSession.createDataFrame([k for own in keys.values() for k in own], "lang string, size long, order long")
    again = F.row_number().over(W.partitionBy("lang").orderBy("size", F.desc("order"), "body"))  # equal ids are chosen together
    found = keyed.join(F.broadcast(chosen), ["lang", "size", "order"], "left_semi").withColumn("rank", again).where(F.col("rank") <= rows).collect()
    return sorted((r["lang"], r["rank"], r["body"]) for r in found if r["rank"] <= len(keys[r["lang"]]))


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are scored together: bounded rows and bytes."""
    for low, high in by_bytes(sizes, 1 << 20):
        for a in range(low, high, BATCH_ROWS):
            yield a, min(high, a + BATCH_ROWS)


def predicted(classifier: KernelClassifier | None, texts: pa.Array, letters: pa.Array) -> tuple[list[str], list[float]]:
    """lang_pred and score; `und` and 0 without a letter, or without a classifier."""
    own = [x or "" for x in texts.to_pylist()]
    langs, scores = classifier.predict(own) if classifier else ([UNKNOWN] * len(own), [0.0] * len(own))
    ok = letters.to_pylist()
    return [x if y else UNKNOWN for x, y in zip(langs, ok)], [x if y else 0.0 for x, y in zip(scores, ok)]


def identify_languages(docs: DataFrame, model: KernelClassifier | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score.

    The model, learned from `docs` if none is given, reads the whole text and nothing else. lang_pred is a
    learned language, or `und` with score 0 for null text, text without a letter (LETTER; digits, fractions and
    Roman numeral signs are none), or where nothing could be learned. The score is the language's share of a softmax
    over decision values. Repeated rows are predicted each. An empty table gives an empty result.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_SIZE

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            for a, b in slices(batch.column("size").to_pylist()):
                own = batch.slice(a, b - a)
                langs, scores = predicted(classifier, own.column("body"), own.column("letters"))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    body = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), body.alias("body"), F.octet_length(body).alias("size"), lettered(F.col(text_col)).alias("letters"))
    return rows.mapInArrow(tidy(predict), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in some language, with all their columns; `lang` is the language that the model finds in the whole text.

    A label that the model hasn't learned (beyond MOST_LANGUAGES, or of held-out rows alone) stays, as the model can't
    judge it. Null texts and texts without a letter are rejected, and nothing else: where nothing could be learned, the
    others stay as they are. Nothing is shuffled but the training rows.
    """
    model = fit(docs, id_col, text_col, lang_col)
    kept = docs.where(lettered(F.col(text_col)))
    if model is None:
        return kept
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_SIZE
    at = docs.columns.index(lang_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        learned = set(classifier.languages)
        for batch in batches:
            texts, langs = batch.column(text_col), batch.column(lang_col).to_pylist()
            for a, b in slices(pc.binary_length(texts).to_pylist()):
                for i, x in enumerate(classifier.predict(texts.slice(a, b - a).to_pylist())[0], a):
                    if langs[i] is None or langs[i] in learned:
                        langs[i] = x
            yield batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type))

    return kept.mapInArrow(tidy(label), docs.schema)
