"""Repeated passages, by anchors at the positions of a difference cover.

A window is ``window`` consecutive words. Modulo a period every two positions get into a difference cover by one common step of
less than the period. So two equal windows share an anchor, the hash of ``window`` - period + 1 words, at one offset, and
anchors are made at the cover's positions only: five of 21 for a window of 35 words.

An anchor then extends to all words that a window with it can have. Where the extensions of two anchors are equal, hash and hash,
every window with them repeats (``whole``). An anchor that others share but whose extension is its own (``open``) stands at
the border of a repeat: its windows are hashed one by one and counted against those of the other open anchors and of one of
each group of equal extensions. Groups of equal anchors are counted by a sort, none is ever held; anchors that very many places
share are found in a sample first, which decides where they are counted and nothing else, and are summed up before they meet.

Anchors decide by two 64-bit hashes (of the anchor and of its extension), single windows by 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import HOT_SHARE, lookup_join, table, trimmed, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Perfect difference sets. Each step that is not 0 modulo the period is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: A group with more than one in so many of all anchors is one of the largest; there are at most so many of them.
LARGEST = 2000
#: One row in so many is looked at for anchors that very many places share.
SAMPLED = 64


def period_of(window: int) -> int:
    """The largest period of at most 0.6 windows, so that an anchor has 0.4 windows of words or more."""
    return max(p for p in COVERS if p <= max(1, 0.6 * window))


class Text:
    """A text's words, joined by one blank, as bytes; ``first[i]``, ``last[i]``: where word i begins and ends."""

    def __init__(self, text: str | None):
        self.words = WORD.findall(text or "")
        self.n = len(self.words)
        each = [w.encode("utf-8", "surrogatepass") for w in self.words]
        self.data = b" ".join(each)
        length = np.fromiter(map(len, each), np.int64, self.n)
        end = (length + 1).cumsum() - 1
        self.first, self.last = (end - length).tolist(), end.tolist()

    def part(self, a: int, z: int) -> bytes:
        """Of words a to z - 1."""
        return self.data[self.first[a] : self.last[z - 1]]


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """``h, c, row, pos``: hashes of each anchor and of its extension, in the texts ``row, text`` that hold a window."""
    period = period_of(window)
    cover, size, reach = COVERS[period], window - period + 1, period - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c, rows, places = [], [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = Text(text.as_py())
                if t.n < window:
                    continue
                last = t.n - size
                at = sorted(p for x in cover for p in range(x, last + 1, period))
                h += [xxh3_64_intdigest(t.part(p, p + size)) for p in at]
                # what a text's ends cut off is part of the hash
                c += [xxh3_64_intdigest(t.part(max(0, p - reach), min(t.n, p + size + reach)), min(p, reach)) for p in at]
                rows += [row] * len(at)
                places += at
                if len(h) > 200_000:
                    yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], names=["h", "c", "row", "pos"])
                    h, c, rows, places = [], [], [], []
            yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], names=["h", "c", "row", "pos"])

    return texts.select("row", "text").mapInArrow(trimmed(run), "h long, c long, row long, pos int")


def hot_anchors(texts: DataFrame, window: int, sampled: int) -> DataFrame:
    """``h`` of at most HOT_SHARE anchors that make up more than 1/HOT_SHARE of a sample's (and 16 of it at least)."""
    counted = written(anchors(texts.where(F.pmod(F.hash("row"), F.lit(sampled)) == 0), window).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counted.agg(F.sum("n")).collect()[0][0] or 0
    return counted.where(F.col("n") >= max(16, total // HOT_SHARE)).select("h")


def kinds(found: DataFrame, total: int) -> DataFrame:
    """``row, pos, kind`` of the shared ones of ``found(h, c, row, pos, hot)``: ``whole`` (another has the same extension), ``open`` (none
    has), ``one`` (besides being whole, the one of its group that open anchors are compared with)."""
    of_h, of_both = Window.partitionBy("h"), Window.partitionBy("h", "c")
    cold = found.where("not hot").repartition("h")
    counted = cold.withColumn("n", F.count(F.lit(1)).over(of_h)).where("n > 1")
    counted = counted.withColumns({"same": F.count(F.lit(1)).over(of_both), "nth": F.row_number().over(of_both.orderBy("row", "pos"))}).withColumn("least", F.min("same").over(of_h))
    cold_kinds = counted.select("row", "pos", F.when(F.col("same") == 1, "open").when((F.col("nth") == 1) & (F.col("least") == 1), "one").otherwise("whole").alias("kind"))
    # both firsts are of one row, since all rows have both
    at_hot = found.where("hot")
    groups = written(at_hot.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos")))
    alone = groups.select("row", "pos", F.when(F.col("n") == 1, "open").otherwise("one").alias("kind"))
    # groups of equal extensions: the few largest by a list of their hashes, the others by a join
    most = max(1000, total // LARGEST)
    several = groups.where("n > 1")
    largest = [c for (c,) in several.where(F.col("n") > most).select("c").collect()]
    in_largest = F.col("c").isin(largest) if largest else F.lit(False)
    rest = at_hot.where(~in_largest).select("h", "c", "row", "pos").join(several.where(F.col("n") <= most).select("h", "c"), ["h", "c"])
    members = at_hot.where(in_largest).select("row", "pos").unionByName(rest.select("row", "pos"))
    return cold_kinds.unionByName(alone).unionByName(members.select("row", "pos", F.lit("whole").alias("kind")))


def _starts(places: list[int], n: int, window: int, reach: int) -> set[int]:
    """Where the windows begin that hold an anchor at one of the places."""
    return {i for p in places for i in range(max(0, p - reach), min(p, n - window) + 1)}


def single_windows(packed: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """``w, row, start, asked``: 128-bit hashes of the windows of open and compared anchors; ``asked``: whether it isn't known yet to repeat."""
    reach = period_of(window) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            hashes, rows, starts, asked = [], [], [], []
            for row, z, whole, open_, one in zip(*(b.column(k).to_pylist() for k in range(5))):
                t = Text(unzip.decompress(z).decode("utf-8", "surrogatepass"))
                known = _starts([*whole, *one], t.n, window, reach)
                at = sorted(_starts([*open_, *one], t.n, window, reach))
                hashes += [xxh3_128_digest(t.part(i, i + window)) for i in at]
                rows += [row] * len(at)
                starts += at
                asked += [i not in known for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(asked, pa.bool_())], names=["w", "row", "start", "asked"])

    joined = packed.join(marks.where("size(open) > 0 or size(one) > 0"), "row").select("row", "z", "whole", "open", "one")
    return joined.mapInArrow(trimmed(run), "w binary, row long, start int, asked boolean")


def _packed(texts: DataFrame) -> DataFrame:
    """``row, id, z``: texts compressed for their way through a shuffle; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zipped = zstandard.ZstdCompressor(level=3)
            z = [zipped.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["row", "id", "z"])

    return texts.select("row", "id", "text").mapInArrow(trimmed(run), "row long, id long, z binary")


_SCHEMA = "id long, n_words long, spans array<struct<first: long, last: long>>, text string"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _cut(marked: DataFrame, window: int) -> DataFrame:
    reach = period_of(window) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            ids, out = b.column(0), [[], [], []]
            for z, whole, starts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                words = WORD.findall(unzip.decompress(z).decode("utf-8", "surrogatepass"))
                change = np.zeros(len(words) + 1, np.int64)
                for a, last in [*((max(0, p - reach), min(p, len(words) - window)) for p in whole or ()), *((s, s) for s in starts or ())]:
                    change[a] += 1  # windows from a to last
                    change[last + window] -= 1
                gone = change.cumsum()[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
                out[0].append(len(words))
                out[1].append([{"first": a, "last": z - 1} for a, z in zip(edges[::2], edges[1::2])])
                out[2].append(" ".join([w for w, x in zip(words, gone.tolist()) if not x] if edges else words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], _SPANS), pa.array(out[2], pa.string())], names=["id", "n_words", "spans", "text"])

    return marked.select("id", "z", "whole", "starts").mapInArrow(trimmed(run), _SCHEMA)


def cut_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False, sampled: int = SAMPLED) -> DataFrame:
    """``id, n_words, spans array<struct<first, last>>, text`` for every row of ``docs``: the words that stand in a window which
    also starts anywhere else, its own document included, as spans of word numbers, and the text of the other words, joined by one
    space. Windows are judged on the input, so of repeats no copy stays.

    Words are what stands between blanks. Null and empty texts, and those of less than ``window`` words, have no window and keep all
    their words. Repeated rows repeat each other; ids may be null or repeated. Texts of any length are taken whole. No rows give no
    rows; other columns play no part. ``from_files``: ``docs`` is a plain scan, whose rows are numbered alike each time; any
    other input is written once.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = (texts if from_files else written(texts)).withColumn("row", F.monotonically_increasing_id())
    hot = hot_anchors(texts, window, sampled).withColumn("hot", F.lit(True))
    found = written(anchors(texts, window).join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    marks = written(kinds(found, found.count()))
    pick = lambda *k: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*k), F.col("pos"))))
    by_row = marks.groupBy("row").agg(pick("whole").alias("whole"), pick("open").alias("open"), pick("one").alias("one"))
    windows = written(single_windows(_packed(texts), by_row, window))
    counts = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.bool_or("asked").alias("asked")).where("n > 1 and asked").select("w", "n")
    again = lookup_join(windows.where("asked").select("w", "row", "start"), written(counts), "w", "n", windows.count()).where("n is not null")
    starts = again.groupBy("row").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    known = marks.where("kind <> 'open'").groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("whole"))
    return _cut(_packed(texts).join(known.join(starts, "row", "full"), "row", "left"), window)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, windows of 35 words."""
    found = cut_repeats(table(spark, sf_dir, "documents"), from_files=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(o[i:i + 34], ' ')) AS h, md5_number(array_to_string(o[i:i + 34], ' ')) AS m FROM (SELECT doc_id, o, unnest(range(1, len(o) - 33)) AS i FROM d WHERE len(o) >= 35)),
again AS (SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT doc_id, i FROM win SEMI JOIN again USING (h, m)),
word AS (SELECT doc_id, unnest(o) AS w, unnest(range(1, len(o) + 1)) AS i FROM d),
seen AS (SELECT x.doc_id, w, x.i, max(y.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) AS last FROM word x LEFT JOIN hit y ON x.doc_id = y.doc_id AND x.i = y.i),
told AS (SELECT doc_id, (count(*) FILTER (i < last + 35))::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (last IS NULL OR i >= last + 35), '') AS t FROM seen GROUP BY doc_id)
SELECT d.doc_id, len(o)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN told USING (doc_id)
"""

QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op12_substring_dedup": ORACLE}
