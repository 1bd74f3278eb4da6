"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

A document's words are streamed through the automaton, whose state is the longest match that ends at each word. A match
of ``ngram`` words or more lies in windows of items; items shorter than a window count as a whole. The automaton of a
block of items (BLOCK_WORDS words at most, whatever the benchmark) is broadcast. Further blocks follow one after the other,
and documents are shuffled only then, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written
from .suffix import SuffixAutomaton

#: Words of the items whose automaton is broadcast at once.
BLOCK_WORDS = 200_000
#: A-Z to a-z; all ASCII but letters and digits to a blank; other bytes (of characters beyond ASCII) as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD_BYTES = re.compile(rb"[^ ]+")
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of a block of items ``(item_id, words)``."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], ngram: int):
        items = [(i, w) for i, w in items if w]
        a = SuffixAutomaton(w for _, w in items)
        self.ngram, self.link, self.length, self.step = ngram, a.link, a.length, a.step
        n = len(a.link)
        order = sorted(range(n), key=a.length.__getitem__)
        #: the state of the last ngram words of each state's strings, if they are that long
        self.gram = [-1] * n
        for s in order[1:]:
            if a.length[s] >= ngram:
                self.gram[s] = s if a.length[a.link[s]] < ngram else self.gram[a.link[s]]
        self.items: dict[int, set[str | None]] = {}
        whole: dict[int, set[str | None]] = {}
        for i, w in items:
            states = [*a.walk(w)]
            if len(w) < ngram:
                whole.setdefault(states[-1], set()).add(i)
            else:
                for s in states[ngram - 1 :]:
                    self.items.setdefault(self.gram[s], set()).add(i)
        self.whole = {s: (self.length[s], x) for s, x in whole.items()}
        #: the next state by suffix links, itself first, that is a short item; -1 if none
        self.short = [-1] * n
        for s in order[1:]:
            self.short[s] = s if s in self.whole else self.short[a.link[s]]

    def scan(self, words: list[bytes], spans: list[tuple[int, int]], found: set) -> None:
        """Adds the hit spans of word numbers, and the items that have an occurring window."""
        step, link, length, gram, short, ngram = self.step, self.link, self.length, self.gram, self.short, self.ngram
        s = n = 0
        grams = set()
        for i, w in enumerate(words):
            to = step[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = step[s].get(w)
            if to is None:
                continue
            s, n = to, n + 1
            if n >= ngram:
                grams.add(gram[s])
                spans.append((i - n + 1, i))
            k = short[s]
            while k > 0:
                if self.whole[k][0] <= n:
                    spans.append((i - self.whole[k][0] + 1, i))
                    found |= self.whole[k][1]
                k = short[link[k]]
        for g in grams:
            found |= self.items[g]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, size = [], 0
    for i, text in items.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        block.append((i, words_of(bytes(text) if text else None)))
        size += len(block[-1][1])
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


_SCHEMA = "doc_id long, row long, n_words long, items array<string>, spans array<struct<first: long, last: long>>, rest string"


def find_hits(docs: DataFrame, items: DataFrame, ngram: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, cut_over: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, items array<string>, spans array<struct<first, last>>, rest`` for every row of ``docs``, and its columns ``keep`` (as ``_keep`` struct).

    Spans are numbers of words, from 0, both ends included. ``rest``: the text without the spans of more than ``cut_over``
    words (null if that is not given). A null text has no words; a null or wordless item has no windows; the words of an
    item without id are hit, but it is not listed. Items with one id count as one. Repeated documents each get their row;
    texts of any length are scanned whole. An empty benchmark hits nothing; empty documents give no rows. Other columns
    play no part.

    A benchmark of more than one block is searched block by block: each leaves its hits alone in the shared folder before
    the next is broadcast, and documents are joined with all their hits once.
    """
    spark = docs.sparkSession
    extra = F.struct(*([docs[f"`{c}`"] for c in keep] if keep else [F.lit(True).alias("none")])).alias("_keep")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first: bigint, last: bigint>>").alias("spans"), extra)
    kept = rows.schema["_keep"].dataType.simpleString()

    def scan(rows: DataFrame, sent) -> DataFrame:
        """Hits of the automaton in ``sent``, if any, added to those that the rows have."""

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value if sent else None
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    n_words, items, spans, rest = [], [], [], []
                    texts = part.column("text").cast(pa.binary())
                    for text, i, s in zip(texts.to_pylist(), part.column("items").to_pylist(), part.column("spans").to_pylist()):
                        words = words_of(text)
                        s, found = [(x["first"], x["last"]) for x in s or ()], {*(i or ())}
                        if index:
                            index.scan(words, s, found)
                        s = merged(s)
                        n_words.append(len(words))
                        items.append(sorted(found - {None}))
                        spans.append([{"first": x, "last": y} for x, y in s])
                        if cut_over is not None:
                            rest.append(text if not s else cut_spans(text, [x for x in s if x[1] - x[0] + 1 > cut_over]))
                    cut = pa.array(rest, pa.binary()).cast(pa.string()) if rest else pa.nulls(part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS), cut, part.column("_keep")], ["doc_id", "row", "n_words", "items", "spans", "rest", "_keep"])

        return rows.mapInArrow(trimmed(scanned), f"{_SCHEMA}, _keep {kept}")

    blocks = _blocks(items, item_col, item_text_col)
    send = lambda block: spark.sparkContext.broadcast(Windows(block, ngram))
    block, more = next(blocks), next(blocks, None)
    if more is None:
        found = scan(rows, send(block))
    else:
        rows, hits = written(rows), None  # numbered once, whatever they come from
        while block is not None:
            sent = send(block)
            part = written(scan(rows.withColumn("_keep", F.lit(None).cast(kept)), sent).where(F.size("spans") > 0).select("row", "items", "spans"))
            sent.unpersist()
            hits = part if hits is None else hits.unionByName(part)
            block, more = more, next(blocks, None)
        hits = hits.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        found = scan(rows.drop("items", "spans").join(hits, "row", "left"), None)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", "rest", "_keep")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text's UTF-8 without the words of ``spans`` and what stands between them."""
    at, out = 0, []
    places = [m.span() for m in _WORD_BYTES.finditer(data.translate(_FOLD))]
    for first, last in spans:
        out.append(data[at : places[first][0]])
        at = places[last][1]
    return b"".join([*out, data[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, ngram: int = 10, max_words: int = 0, max_coverage: float = 0.0, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns: hit spans of more than ``max_words`` words are cut from the text, and documents with
    more than ``max_coverage`` of their words hit are left out (0: all that are hit at all). ``size_col``, if there,
    becomes the new length. Rows without a hit pass unchanged, null texts included; so do all with an empty benchmark.
    Repeated rows are treated each by itself; columns may have any names."""
    found = find_hits(docs, items, ngram, id_col, text_col, item_col, item_text_col, keep=docs.columns, cut_over=max_words)
    left = found.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    changed = F.col("n_hit") > 0
    own = {c: F.col("_keep")[c] for c in docs.columns}
    own[text_col] = F.when(changed, F.col("rest")).otherwise(own[text_col])
    if size_col in own:
        own[size_col] = F.when(changed, F.length("rest")).otherwise(own[size_col]).cast(docs.schema[size_col].dataType)
    return left.select(*[v.alias(c) for c, v in own.items()])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE}
