"""Language identification by a blended-spectrum n-gram presence kernel.

k(x, y) = sum over n of WEIGHTS[n] * (number of distinct letter n-grams that x and y share), scaled by the lengths of x
and y in that space. Landmark texts give the Nyström feature map, one-versus-rest kernel ridge regression the
classifiers. A batch of texts is a presence matrix P over the landmarks' n-grams; scores are (P @ V) / |P|, where V holds
the landmarks, the Nyström map and the ridge weights multiplied together (the same products in another order).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, trimmed

#: Blend of the spectrum: weight of shared n-grams by n.
WEIGHTS = {1: 0.25, 2: 1.0, 3: 1.0}
#: Symbols: 0 is a run of anything but letters, 1 to 26 are a to z, further letters share 27 to 63 by code point.
SYMBOLS = 64
#: Bounds of the sample that the classifier is fitted on: rows, rows of one language, landmarks.
SAMPLE_ROWS, SAMPLE_OF_LANG, LANDMARKS = 4000, 500, 384
RIDGE = 1e-3
UNKNOWN = "und"
_FIRST = {1: 0, 2: SYMBOLS, 3: SYMBOLS + SYMBOLS**2}
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


def symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


_symbols: list[np.ndarray] = []


def gram_codes(text: str) -> np.ndarray:
    """Codes of all letter n-grams of a whole text, with repeats; empty if it has no letter."""
    if not _symbols:
        _symbols.append(symbol_table())
    s = _symbols[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return np.empty(0, np.int32)
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    two = s[:-1] * SYMBOLS + s[1:]
    return np.concatenate([s, two + _FIRST[2], two[:-1] * SYMBOLS + s[2:] + _FIRST[3]])


def _weight_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < _FIRST[2], WEIGHTS[1], np.where(codes < _FIRST[3], WEIGHTS[2], WEIGHTS[3]))


class Classifier:
    """Fitted on ``(lang, distinct gram codes)`` rows; the first of each language, in turn, are the landmarks."""

    def __init__(self, sample: list[tuple[str, np.ndarray]]):
        self.langs = sorted({x for x, _ in sample})
        by_lang = {x: [i for i, s in enumerate(sample) if s[0] == x] for x in self.langs}
        turns = [x[i] for i in range(max(map(len, by_lang.values()), default=0)) for x in by_lang.values() if i < len(x)]
        landmarks = turns[:LANDMARKS]
        grams = np.unique(np.concatenate([sample[i][1] for i in landmarks])) if landmarks else np.empty(0, np.int64)
        self.column = np.full(GRAMS, len(grams), np.int32)
        self.column[grams] = np.arange(len(grams))
        self.weights = _weight_of(grams).astype(np.float32)
        if not sample:
            return
        x = np.zeros((len(sample), len(grams) + 1), np.float32)
        for i, (_, codes) in enumerate(sample):
            x[i, self.column[codes]] = 1
        x = x[:, :-1] * np.sqrt(self.weights)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        marks = x[landmarks]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        top = values > 1e-6 * values.max()
        to_features = vectors[:, top] / np.sqrt(values[top])
        features = np.c_[(x @ marks.T) @ to_features, np.ones(len(x))]
        wanted = np.where(np.array([[s[0] == y for y in self.langs] for s in sample]), 1.0, -1.0)
        # each language weighs the same, so that a rare one isn't drowned
        each = np.array([1 / len(by_lang[s[0]]) for s in sample])[:, None] * len(sample) / len(self.langs)
        ridge = RIDGE * len(sample) * np.eye(features.shape[1])
        beta = np.linalg.solve(features.T @ (each * features) + ridge, features.T @ (each * wanted))
        self.bias = beta[-1].astype(np.float32)
        self.product = (np.sqrt(self.weights)[:, None] * (marks.T @ (to_features @ beta[:-1]))).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, score
        for at in range(0, len(texts), 128):
            present = np.zeros((min(128, len(texts) - at), len(self.weights) + 1), np.float32)
            known = []
            for i, t in enumerate(texts[at : at + 128]):
                codes = gram_codes(t) if t else ()
                if len(codes):
                    present[i, self.column[codes]] = 1
                    known.append(i)
            present = present[:, :-1]
            margins = (present @ self.product) / np.sqrt(np.maximum(present @ self.weights, 1e-9))[:, None] + self.bias
            best = margins.argmax(1)
            for i in known:
                langs[at + i] = self.langs[best[i]]
                score[at + i] = min(1.0, max(0.0, (float(margins[i, best[i]]) + 1) / 2))
        return langs, score


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """A classifier of the rows where ``learn`` holds and lang and text are not null.

    SAMPLE_OF_LANG rows of each language at most (fewer if there are more than SAMPLE_ROWS / SAMPLE_OF_LANG languages),
    those with the smallest hash of the id. Their whole texts' distinct n-grams, not the texts, come to the driver.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 32).alias("h")).where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()}
    if not counts:
        return Classifier([])
    each = max(1, min(SAMPLE_OF_LANG, SAMPLE_ROWS // len(counts)))
    # a little more than needed, so that enough are left by chance
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 32, int((each + 5 * each**0.5 + 20) / n * (1 << 32))))])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            codes = [np.unique(gram_codes(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array([c.astype(np.int32).tobytes() for c in codes], pa.binary())], ["lang", "h", "codes"])

    found = rows.where(F.col("h") < least[F.col("lang")]).mapInArrow(trimmed(grams), "lang string, h long, codes binary").collect()
    sample, taken = [], dict.fromkeys(counts, 0)
    for lang, _, codes in sorted(found, key=lambda r: (r[1], r[0], r[2])):
        if len(codes) and taken[lang] < each:
            taken[lang] += 1
            sample.append((lang, np.frombuffer(codes, np.int32)))
    return Classifier(sample)


def predict(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: UNKNOWN and 0 if the text is null or has no letter (or nothing was
    learned). Ties go to the first language in order. Repeated rows get the same prediction, also those with null ids; texts
    of any length are read whole, some hundred at a time. An empty table gives no rows; other columns play no part."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            langs, score = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(predicted), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, classifier: Classifier, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least_score`` or more; if nothing was learned, those with a letter.
    A null text has no language; all columns, whatever their names, are kept as they are; an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(text_col).to_pylist()
            if not sent.value.langs:
                yield b.filter(pa.array([bool(t) and len(gram_codes(t)) > 0 for t in texts], pa.bool_()))
                continue
            langs, score = sent.value.predict(texts)
            yield b.filter(pc.and_(pc.not_equal(pa.array(langs), UNKNOWN), pc.greater_equal(pa.array(score), least_score)))

    return docs.mapInArrow(trimmed(kept), docs.schema)


def labeled(docs: DataFrame, classifier: Classifier, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with the predicted one in ``lang``, whatever stood there; if nothing was learned, those
    with a letter, as they are. All other columns are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index(lang_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(text_col).to_pylist()
            if not sent.value.langs:
                yield b.filter(pa.array([bool(t) and len(gram_codes(t)) > 0 for t in texts], pa.bool_()))
                continue
            langs = pa.array(sent.value.predict(texts)[0], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), langs).filter(pc.not_equal(langs, UNKNOWN))

    return docs.mapInArrow(trimmed(told), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; those without an id too."""
    return F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, by a classifier fitted on those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
