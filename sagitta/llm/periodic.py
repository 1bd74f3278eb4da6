"""Periodic runs of words, by a suffix automaton whose sets of end positions are merged from the smaller into the larger.

Where an end position enters a set, its new neighbours at a distance of at most the state's length each stand for a square:
the state's strings end at both and so touch or overlap. Each square is a seed and is extended to the run that holds it. Every
maximal run of two periods or more is found that way: at the state where two ends a period apart meet, they are neighbours.

All of it happens in the document, so documents stay where they are: no shuffle. A run of four periods repeats each of its
three-word shingles within itself, so the automaton is built of the stretches that do (``stretches``) and not of all words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed
from .suffix import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of a shingle. A run of three words and two periods less one, or more, repeats each of its shingles within itself.
SHINGLE = 3

Run = tuple[int, int, int]


def stretches(symbols: np.ndarray, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Parts ``[first, end)`` outside which no run of ``least_words`` and LEAST_PERIODS can be: the longest in which each shingle
    occurs twice, taken apart again until that holds within each part."""
    todo, out = [(0, len(symbols))], []
    while todo:
        first, end = todo.pop()
        n = end - first - SHINGLE + 1
        if end - first < max(least_words, SHINGLE):
            continue
        part = np.unique(symbols[first:end], return_inverse=True)[1].astype(np.int64)
        k = int(part.max()) + 1
        if k >= 1 << 20:  # a shingle would not fit 64 bits
            pairs = np.unique(part[:-1] * k + part[1:], return_inverse=True)[1]
            keys = pairs[: n] * k + part[SHINGLE - 1 :]
        else:
            keys = (part[:-2] * k + part[1:-1]) * k + part[2:]
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[at] > 1
        if again.all():
            out.append((first, end))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
        todo += [(first + int(a), first + int(z) + SHINGLE - 1) for a, z in zip(edges[::2], edges[1::2])]
    return out


def squares(symbols: Sequence[int]) -> Iterator[tuple[int, int]]:
    """``(end, distance)``: the strings of some state end at ``end`` and ``distance`` before, which is no more than their length."""
    a = SuffixAutomaton([])
    last, ends = 0, {}
    for i, c in enumerate(symbols):
        last = a._extend(last, c)
        ends[last] = i
    # ends are kept negative, in order: in a long run a set grows at its lower ends, which is then an append
    held: dict[int, list[int]] = {s: [-i] for s, i in ends.items()}
    for s in sorted(range(1, len(a.link)), key=a.length.__getitem__, reverse=True):
        # all that link to s are longer, so its set is whole and goes to the state that it links to
        mine, to = held.pop(s), a.link[s]
        if not to:
            continue
        large = held.get(to)
        if large is None:
            held[to] = mine
            continue
        if len(large) < len(mine):
            large, mine = mine, large
            held[to] = large
        most = a.length[to]
        for e in mine:
            k = bisect_left(large, e)
            if k < len(large) and large[k] - e <= most:
                yield -e, large[k] - e
            if k and e - large[k - 1] <= most:
                yield -large[k - 1], e - large[k - 1]
            large.insert(k, e)


def _smallest_period(symbols: Sequence[int], start: int, length: int) -> int:
    """Of the stretch, by its borders."""
    border = [0] * length
    k = 0
    for i in range(1, length):
        while k and symbols[start + i] != symbols[start + k]:
            k = border[k - 1]
        k += symbols[start + i] == symbols[start + k]
        border[i] = k
    return length - border[-1]


def runs(symbols: Sequence[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """``(start, length, period)`` by start, then period: stretches of least ``least_words`` words and ``least_periods`` (2 or more)
    periods that no neighbouring word extends; the period is the stretch's smallest."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    n = len(symbols)
    parts = stretches(np.asarray(symbols, np.int64), least_words) if least_periods >= LEAST_PERIODS and least_words >= LEAST_WORDS else [(0, n)]
    found: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends of the runs so far, in order
    for first, stop in parts:
        for end, period in squares(symbols[first:stop]):
            starts, ends = found.setdefault(period, ([], []))
            end += first
            k = bisect_right(starts, end - period)
            if k and ends[k - 1] > end:
                continue  # this run is known
            lo, hi = end - period, end + 1
            while lo > 0 and symbols[lo - 1] == symbols[lo - 1 + period]:
                lo -= 1
            while hi < n and symbols[hi] == symbols[hi - period]:
                hi += 1
            k = bisect_left(starts, lo)
            starts.insert(k, lo)
            ends.insert(k, hi)
    out = [(lo, hi - lo, period) for period, both in found.items() for lo, hi in zip(*both) if hi - lo >= max(least_words, least_periods * period)]
    # the first two periods tell whether a smaller one holds, too
    return sorted({r for r in out if _smallest_period(symbols, r[0], 2 * r[2]) == r[2]}, key=lambda r: (r[0], r[2]))


def extra(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return change.cumsum()[:n] > 0


def numbered(words: Sequence[str]) -> list[int]:
    numbers: dict[str, int] = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]


_SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, words_of: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """``id, n_words, runs array<struct<start, length, period>>, text`` for every row of ``docs``: its runs by start, then period, and
    the text without the words that stand in a run after its first period, joined by one space.

    Words are what stands between blanks. ``words_of(id, words)`` may put other words in place of a document's. A null or empty
    text has no words and no runs. Ids may be null or repeated: each row is taken by itself. Texts of any length are taken whole, in
    memory by the length of the stretches that may hold runs. No rows give no rows; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = WORD.findall(t.as_py() or "")
                if words_of:
                    words = words_of(i, words)
                symbols = numbered(words)
                found = runs(symbols, least_words, least_periods)
                if found:
                    gone = extra(len(words), found).tolist()
                    words_left = [w for w, x in zip(words, gone) if not x]
                else:
                    words_left = words
                out[0].append(len(words))
                out[1].append([{"start": s, "length": n, "period": p} for s, n, p in found])
                out[2].append(" ".join(words_left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], _RUNS), pa.array(out[2], pa.string())], names=["id", "n_words", "runs", "text"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), _SCHEMA)


def looped(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with, in every tenth document by its checksum, the later ones replaced by a loop of some of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; a document without id has no checksum and keeps its words."""
    found = find_runs(table(spark, sf_dir, "documents"), words_of=looped)
    # the longest; of equal ones that with the smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumns({"best": best, "told": told})
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.call_function("div", F.col("best.length") * 1000, -F.col("best.period")).alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


#: Runs from pairs of equal three-word shingles: as many at one distance in a row as there are words less the distance and two.
ORACLE = r"""
WITH bytes AS (SELECT doc_id, text, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
  xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS h FROM bytes),
cut AS (SELECT doc_id, o, len(o) AS n, h, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM crc),
loop_ AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
word AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i >= a THEN o[1 + a + (i - a) % p] ELSE o[1 + i] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM loop_)),
tri AS MATERIALIZED (SELECT doc_id, n, i, hash(w || ' ' || w1 || ' ' || w2) AS t FROM (SELECT doc_id, n, i, w, lead(w) OVER s AS w1, lead(w, 2) OVER s AS w2 FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY i)) WHERE w2 IS NOT NULL),
pair AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM tri x JOIN tri y ON x.doc_id = y.doc_id AND x.t = y.t AND x.i < y.i WHERE 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS s, count(*) + q + 2 AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair) GROUP BY doc_id, q, g),
long_ AS MATERIALIZED (SELECT * FROM island WHERE l >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long_ x WHERE NOT EXISTS (SELECT 1 FROM long_ y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs, arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": ORACLE}
