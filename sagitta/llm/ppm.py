"""Language-model scores by prediction by partial matching, with a word model as their base.

The model is a trie of byte contexts up to ORDER symbols, pretrained on counts of all training texts: a symbol that its
longest known context has seen costs c / (T + D); else an escape D / (T + D) is paid (T occurrences, D distinct symbols)
and the next shorter context is asked, without the symbols that the longer one has excluded. Only (ORDER + 1)-grams are
counted, in one shuffle together with the words; shorter contexts are their sums. The trie that workers hold has NODES
grams of an order at most: all of them, or those counted most with the T and D of all. What it doesn't tell is looked up in
tables of all contexts by shuffles, so scores don't depend on NODES.

The base scores need every training word's exact count. Words counted most (FREQUENT of them at most) are broadcast; a
document's other words are joined to their counts by a shuffle, so the vocabulary may be of any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, lookup_join, release, table, trimmed, written

ORDER, NODES, FREQUENT = 5, 1 << 20, 400_000
#: A symbol is a byte plus 1; 0 stands before a text and ends it.
_BITS, _SYMBOLS = 9, 257
#: Counted at once: grams, distinct words.
_GRAMS, _WORDS = 1 << 22, 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(text: bytes) -> np.ndarray:
    """Codes of the (ORDER + 1)-grams that end at each byte of a lower-cased text and at its end."""
    s = np.zeros(len(text) + ORDER + 1, np.uint64)
    s[ORDER:-1] = np.frombuffer(text, np.uint8)
    s[ORDER:-1] += np.uint64(1)
    n = len(text) + 1
    out = s[:n].copy()
    for i in range(1, ORDER + 1):
        out <<= np.uint64(_BITS)
        out |= s[i : i + n]
    return out


class Lookup:
    """An open-addressed table of whole numbers to rows of ``values``, for arrays of keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = [np.zeros(1 << bits, v.dtype) for v in values]
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = keys[left[put]]
            for to, v in zip(self.values, values):
                to[slot[put]] = v[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and where."""
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        left = np.flatnonzero(~hit & (there != _EMPTY))
        while len(left):
            at = slot[left] = (slot[left] + np.uint64(1)) & self.last
            there = self.keys[at]
            same = there == keys[left]
            hit[left[same]] = True
            left = left[~same & (there != _EMPTY)]
        return hit, slot


class Trie:
    """From ``orders``, a list that is used up from its end: k-grams, shortest last, as ``(codes, counts, None)`` of all or
    ``(codes, counts, (T, D, sum of what the shorter context excludes))`` of some, with what holds for each one's context."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, tuple | None]]):
        self.grams: list[Lookup] = []
        self.contexts: list[Lookup] = []
        #: Of each order, shortest first: whether all its grams are here.
        self.whole: list[bool] = []
        shorter = None
        for k in range(1, len(orders) + 1):
            codes, counts, of_all = orders.pop()
            contexts, first, at, held = np.unique(codes >> np.uint64(_BITS), return_index=True, return_inverse=True, return_counts=True)
            if of_all is not None:
                total, distinct, below = (x[first] for x in of_all)
            else:
                total, distinct, below = np.bincount(at, counts, len(contexts)), held, np.zeros(len(contexts))
                if shorter is not None and len(codes):
                    hit, slot = shorter.find(codes & np.uint64((1 << _BITS * (k - 1)) - 1))
                    below = np.bincount(at, np.where(hit, shorter.values[0][slot], 0), len(contexts))
            sure = np.log10(counts / (total + distinct)[at]) if len(codes) else np.empty(0)
            shorter = Lookup(codes, counts, sure.astype(np.float32))
            self.grams.append(shorter)
            self.contexts.append(Lookup(contexts, total, distinct.astype(np.float32), below, held == distinct))
            self.whole.append(of_all is None)
            del codes, counts, of_all, contexts, first, at, held, total, distinct, below, sure
            release()

    def log10(self, codes: np.ndarray, order: int | None = None, so_far: np.ndarray | None = None, excluded: np.ndarray | None = None) -> np.ndarray:
        """log10 of each last symbol's probability after those before it; NaN where the grams that are held don't tell.

        ``so_far`` and ``excluded`` (T and D) are what longer orders than ``order`` have left.
        """
        if order is None:
            order, top = len(self.grams), self.grams[-1]
            hit, slot = top.find(codes)
            out = np.where(hit, top.values[1][slot], np.float32(0)).astype(np.float64)
            at = np.flatnonzero(~hit)
            excluded = np.zeros((2, len(at)))
        else:
            out, at = so_far.copy(), np.arange(len(codes))
        for k in range(order, 0, -1):
            if not len(at):
                return out
            c = codes[at] & np.uint64((1 << _BITS * k) - 1)
            known, slot = self.contexts[k - 1].find(c >> np.uint64(_BITS))
            total, distinct, below, complete = (np.where(known, v[slot], 0) for v in self.contexts[k - 1].values)
            t, d = total - excluded[0], distinct - excluded[1]
            hit, place = self.grams[k - 1].find(c)
            count = self.grams[k - 1].values[0][place]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.log10(np.where(hit, count, d) / (t + d))
            out[at] += np.where(hit | (d > 0), step, 0)
            excluded = np.where(known, [below, distinct], excluded)
            more = ~hit
            if not self.whole[k - 1]:
                more &= complete.astype(bool)
                out[at[~hit & ~more]] = np.nan
            at, excluded = at[more], excluded[:, more]
        out[at] -= np.log10(_SYMBOLS - excluded[1])
        return out


def _rows(words, codes, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, codes, counts], ["word", "code", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (word, null, n) and (null, gram, n), and one of (null, -1, documents)."""
    words: Counter = Counter()
    waiting, size, docs = [], 0, 0

    def all_grams():
        codes, n = np.unique(np.concatenate(waiting), return_counts=True)
        for at in range(0, len(codes), 200_000):
            part = codes[at : at + 200_000]
            yield _rows(pa.nulls(len(part), pa.binary()), pa.array(part.view(np.int64)), pa.array(n[at : at + 200_000]))

    def all_words():
        keys = [*words]
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield _rows(pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([words[w] for w in part], pa.int64()))

    for b in batches:
        for x in b.column("text").cast(pa.binary()):
            text = (x.as_py() or b"").lower()
            docs += 1
            words.update(text.split())
            waiting.append(grams(text))
            size += len(waiting[-1])
            if size >= _GRAMS:
                yield from all_grams()
                waiting, size = [], 0
            if len(words) >= _WORDS:
                yield from all_words()
                words.clear()
    if waiting:
        yield from all_grams()
    yield from all_words()
    if docs:
        yield _rows(pa.nulls(1, pa.binary()), pa.array([-1], pa.int64()), pa.array([docs], pa.int64()))


def _most(rows: DataFrame, by: list[str], most: int) -> dict[tuple, int]:
    """For each value of ``by``, the least bucket of counts (eight for a doubling) from which on there are ``most`` rows at most."""
    found = rows.groupBy(*by, F.floor(F.log2("n") * 8).alias("bucket")).count().collect()
    least: dict[tuple, int] = {}
    total: Counter = Counter()
    for r in sorted(found, key=lambda r: -r["bucket"]):
        key = tuple(r[c] for c in by)
        total[key] += r["count"]
        if total[key] <= most:
            least[key] = r["bucket"]
        elif key not in least:
            least[key] = r["bucket"] + 1
    return least


class Model:
    def __init__(self, trie: Trie, words: dict[bytes, float], tokens: int, distinct: int, ends: int, tables: list[DataFrame]):
        self.trie, self.tokens, self.distinct, self.ends = trie, tokens, distinct, ends
        #: log10 of each held word's count plus 1
        self.words = words
        #: Of the orders that the trie has in part, longest first: all contexts. They stay at the driver.
        self.tables = tables

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tables": []}


def _low(code: Column, k: int) -> Column:
    """The last ``k`` symbols."""
    return code.bitwiseAND((1 << _BITS * k) - 1)


def _contexts(grams_k: DataFrame, k: int) -> DataFrame:
    """``context, total, distinct, below, symbols`` of all k-grams. No key here has more than _SYMBOLS rows, but for k = 1."""
    # a gram's suffix is counted as often as all grams that end in it
    below = F.sum("n").over(Window.partitionBy(_low(F.col("code"), k - 1))) if k > 1 else F.lit(0).cast("long")
    rows = grams_k.withColumn("below", below).groupBy(F.shiftright("code", _BITS).alias("context"))
    return rows.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("below").alias("below"), F.map_from_entries(F.collect_list(F.struct(_low(F.col("code"), 1).alias("symbol"), "n"))).alias("symbols"))


def train(docs: DataFrame, learn, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the rows where ``learn`` holds, and ``word binary, n`` of the words that it doesn't hold itself."""
    rows = docs.where(learn).select(F.col(text_col).alias("text")).mapInArrow(trimmed(_counted), "word binary, code long, n long")
    counts = written(rows.groupBy("word", "code").agg(F.sum("n").alias("n")))
    words = counts.where("word is not null").select("word", "n")
    tokens, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).collect()[0]
    ends = sum(r[0] for r in counts.where("code = -1").select("n").collect())
    bucket = F.floor(F.log2("n") * 8)
    least = _most(words, [], FREQUENT).get((), 0)
    often = words.where(bucket >= least).toArrow()
    grams_k = counts.where("code >= 0").select("code", "n")
    orders, tables = [], []
    for k in range(ORDER + 1, 0, -1):
        if grams_k.count() <= NODES:
            kept = grams_k.toArrow()
            codes, n = kept.column("code").to_numpy().astype(np.int64).view(np.uint64), kept.column("n").to_numpy().astype(np.float64)
            # each order is the sum of the next longer one
            for j in range(k, 0, -1):
                codes, at = np.unique(codes & np.uint64((1 << _BITS * j) - 1), return_inverse=True)
                n = np.bincount(at, n, len(codes))
                orders.append((codes, n, None))
            break
        contexts = written(_contexts(grams_k, k))
        tables.append(contexts)
        each = contexts.select("context", "total", "distinct", "below", F.explode("symbols").alias("symbol", "n"))
        kept = each.where(bucket >= _most(each, [], NODES).get((), 0)).select(F.shiftleft("context", _BITS).bitwiseOR(F.col("symbol")).alias("code"), "n", "total", "distinct", "below").toArrow()
        codes = kept.column("code").to_numpy().astype(np.int64).view(np.uint64)
        orders.append((codes, kept.column("n").to_numpy().astype(np.float64), tuple(kept.column(c).to_numpy().astype(np.float64) for c in ("total", "distinct", "below"))))
        del kept, codes
        release()
        grams_k = written(grams_k.groupBy(_low(F.col("code"), k - 1).alias("code")).agg(F.sum("n").alias("n"))) if k > 1 else grams_k
    held = dict(zip(often.column("word").to_pylist(), np.log10(often.column("n").to_numpy() + 1.0).tolist()))
    del often
    release()
    model = Model(Trie(orders), held, (tokens or 0) + ends, distinct + (ends > 0), ends, tables)
    release()
    return model, words.where(bucket < least)


def _told(asked: DataFrame, model: Model, sent) -> DataFrame:
    """``asked`` (distinct ``code`` and ``asked``) with ``log10``, order by order from the tables, and the rest from the trie's whole orders."""
    order, seen = len(model.trie.grams), []
    left = asked.select("code", "asked", F.lit(0.0).alias("so_far"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("d"))
    for contexts in model.tables:
        at = left.withColumn("context", F.shiftright(_low(F.col("code"), order), _BITS)).join(contexts, "context", "left")
        count = F.try_element_at("symbols", _low(F.col("code"), 1))
        d = F.coalesce("distinct", F.lit(0)) - F.col("d")
        both = F.coalesce("total", F.lit(0)) - F.col("t") + d
        step = F.when(count.isNotNull(), F.log10(count / both)).when(d > 0, F.log10(d / both)).otherwise(0.0)
        at = written(at.select("code", "asked", (F.col("so_far") + step).alias("so_far"), F.coalesce("below", "t").alias("t"), F.coalesce("distinct", "d").alias("d"), count.isNotNull().alias("seen")))
        seen.append(at.where("seen").select("code", "asked", F.col("so_far").alias("log10")))
        left, order = at.where("not seen").drop("seen"), order - 1

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, so_far, t, d = (b.column(c).to_numpy() for c in ("code", "so_far", "t", "d"))
            found = sent.value.trie.log10(codes.astype(np.int64).view(np.uint64), order, so_far, np.stack([t, d]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("code"), b.column("asked"), pa.array(found)], ["code", "asked", "log10"])

    out = left.mapInArrow(trimmed(shorter), "code long, asked long, log10 double")
    for s in seen:
        out = out.unionByName(s)
    return written(out)


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    A null text is empty: its one token is the end. Repeated rows are scored each, null ids too; texts of any length are
    scored whole. Where nothing was learned, no token is known and all symbols are equally likely. Which of equally
    frequent grams and words are broadcast changes no score. An empty table gives no rows; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 33
        known = m.words.get
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = {x: [] for x in ("row", "n_tokens", "n_known", "base", "score", "words", "times", "codes", "code_times")}
                for x in part.column(1).cast(pa.binary()):
                    text = (x.as_py() or b"").lower()
                    words = text.split()
                    found = [*map(known, words)]
                    there = [f for f in found if f is not None]
                    others = Counter(w for w, f in zip(words, found) if f is None) if len(there) < len(words) else {}
                    out["row"].append(row)
                    row += 1
                    out["n_tokens"].append(len(words) + 1)
                    out["n_known"].append(len(there) + (m.ends > 0))
                    out["base"].append(sum(there) + np.log10(m.ends + 1) - (len(words) + 1) * np.log10(m.tokens + m.distinct + 1))
                    codes = grams(text)
                    found = m.trie.log10(codes)
                    open_ones, n = np.unique(codes[np.isnan(found)], return_counts=True)
                    out["score"].append(float(np.nansum(found)))
                    out["words"].append([*others])
                    out["times"].append([*others.values()])
                    out["codes"].append(open_ones.view(np.int64))
                    out["code_times"].append(n)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["doc_id", *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(scored), "doc_id long, row long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>, codes array<long>, code_times array<long>")
    rows = written(rows)
    others = rows.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # no word of `rare` is frequent, so no key of this join is hot
    more = others.join(rare, "word").select("row", F.col("times").alias("more_known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"), F.lit(0.0).alias("more_score"))
    if model.tables:
        codes = rows.where(F.size("codes") > 0).select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.code_times").alias("times"))
        told = _told(codes.groupBy("code").agg(F.count(F.lit(1)).alias("asked")), model, sent)
        found = lookup_join(codes, told, "code", "asked", told.agg(F.sum("asked")).collect()[0][0] or 0)
        more = more.unionByName(found.select("row", F.lit(0).cast("long").alias("more_known"), F.lit(0.0).alias("more_base"), (F.col("times") * F.col("log10")).alias("more_score")))
    more = more.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score")))
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.drop("words", "times", "codes", "code_times").join(more, "row", "left").select("doc_id", "n_tokens", total("n_known", "more_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), total("base", "more_base").alias("base_score"), total("score", "more_score").alias("score"))


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; those without an id too."""
    return F.coalesce(crc_mod(F.col(id_col), 7) == 2, F.lit(True))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scored by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model, rare = train(docs, ~held_out())
    return score(docs, model, rare).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_ppm_scores": op8_ppm_scores}
ORACLES: dict[str, str] = {}
