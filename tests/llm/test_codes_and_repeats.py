"""Vector codes, substring dedup and periodic runs against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagitta.llm import codes, periodic, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- vector codes ---


def brute_codes(rows, parts, entries, rounds, scale):
    wide = max([1, *(-(-len(v) // parts) for _, v, _ in rows)])
    whole = [(i, [math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (wide * parts - len(v)), label) for i, v, label in rows]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * wide : (p + 1) * wide] for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in whole:
                x = v[p * wide : (p + 1) * wide]
                held[nearest(p, x)[1]].append(x)
            after.append([[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])])
        books = after
    out = []
    for i, v, label in whole:
        near = [nearest(p, v[p * wide : (p + 1) * wide]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), label))
    total = {}
    for _, _, d, label in out:
        total[label] = total.get(label, 0) + d
    return sorted(((i, c, d, total[label]) for i, c, d, label in out), key=repr), books


@pytest.mark.parametrize("size", [16, 13])
def test_vector_codes(spark, size, monkeypatch):
    monkeypatch.setattr("sagitta.llm.common.HOT_SHARE", 3)
    rng = random.Random(size)
    copy = [rng.uniform(-1, 1) for _ in range(size)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(size)] if i % 3 else copy, rng.choice([None, 1, 2])) for i in range(1300, 0, -1)]
    rows += [(5, copy, 1), (5, [0.5] * size, 1), (None, copy, None), (2000, [], 2), (2001, [0.25] * 3, 2), (2002, [3e4, -3e4] + copy[2:], 7)]
    odd = [(3000, None, 1), (3001, [float("nan")] * size, 1), (3002, [float("inf")] * size, 1), (3003, [None] + copy[1:], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, code string, part int")
    found, books = codes.compress(frame)
    want, want_books = brute_codes(rows, 8, 16, 6, 4096)
    assert books.tolist() == want_books
    assert sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()), key=repr) == want


def test_vector_codes_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    found, books = codes.compress(spark.createDataFrame([(7, [1.0, -1.0], None), (8, [1.0, -1.0], None)], schema))
    assert [tuple(r) for r in found.orderBy("vec_id").collect()] == [(7, "00" * 8, 0, 0), (8, "00" * 8, 0, 0)]
    assert books.shape == (8, 2, 1)
    for rows in ([], [(1, None, 2)]):
        found, books = codes.compress(spark.createDataFrame(rows, schema))
        assert found.collect() == [] and books.size == 0 and found.columns == ["vec_id", "code", "error", "label_error"]


def test_distinct_parts_have_weights(spark):
    frame = spark.createDataFrame([(i, [float(i % 2)] * 8, 0) for i in range(10)], "vec_id long, embedding array<float>, label int")
    rows, wide = codes.integer_vectors(frame, 4096.0, 8, "vec_id", "embedding", "label")
    assert wide == 1
    assert sorted(r["weight"] for r in codes.distinct_parts(rows, wide, 8).collect()) == [5] * 16


# --- repeated passages ---


def brute_repeats(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    count = {}
    for w in docs:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in docs:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeat_rows(found):
    return sorted(((r["id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["text"]) for r in found.collect()), key=repr)


def texts_with_repeats(rng, window):
    words = ["a", "b", "É", "日本", "Zz"] + [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=rng.choice([window - 1 or 1, window, window + 1, 2 * window, 90])) for _ in range(12)]
    texts = []
    for _ in range(150):
        out = []
        for _ in range(rng.randint(0, 5)):
            out += rng.choices(words, k=rng.randint(0, 40))
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            out += p if rng.random() < 0.8 else p[rng.randrange(len(p)) :]
        texts.append(rng.choice(["", " ", "\n\t"]) + rng.choice([" ", "  ", "\n"]).join(out))
    return texts


@pytest.mark.parametrize(("window", "sampled"), [(35, 64), (35, 1), (12, 2), (5, 1), (1, 1)])
def test_substring_dedup(spark, window, sampled, monkeypatch):
    if sampled == 1:
        monkeypatch.setattr(repeats, "HOT_SHARE", 10_000)  # nearly all shared anchors count as very frequent
    rng = random.Random(window)
    texts = texts_with_repeats(rng, window) + [None, "", " ", "x " * 3000, "x " * 34, "y " * 35, "z " * 36, "u v " * 40]
    texts += texts[:40]
    rows = [(None if i % 50 == 7 else i // 2, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pos string")
    want = sorted(((i, *w) for (i, *_), w in zip(rows, brute_repeats(texts, window))), key=repr)
    assert repeat_rows(repeats.cut_repeats(docs, window, sampled=sampled)) == want


def test_substring_dedup_of_one_very_long_and_none(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choices("abcdefgh", k=50))
    text = " ".join(f"v{rng.randrange(10**9)}" for _ in range(60_000)) + " " + passage
    docs = spark.createDataFrame([(1, text), (2, "so " + passage + " it is")], "doc_id long, text string")
    assert [(r[0], r[1], r[2]) for r in repeat_rows(repeats.cut_repeats(docs))] == [(1, 60_050, 50), (2, 53, 50)]
    assert repeats.cut_repeats(docs.limit(0)).collect() == []


def test_covers():
    for period, cover in repeats.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == {*range(period)}


# --- periodic runs ---


def brute_runs(w, least_words=6, least_periods=4):
    n, out = len(w), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i < n - q:
            k = i
            while k < n - q and w[k] == w[k + q]:
                k += 1
            if k - i + q >= max(least_words, least_periods * q):
                out.setdefault((i, k - i + q), q)
            i = k + 1
    # a stretch of a smaller period is that one's run, or part of it
    return sorted([(s, n, q) for (s, n), q in out.items() if not any(q2 < q and s2 <= s and s2 + n2 >= s + n for (s2, n2), q2 in out.items())], key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=7), st.integers(1, 7)), max_size=6))
def test_runs(pieces):
    w = [x for piece, times in pieces for x in piece * times]
    assert periodic.runs(w) == brute_runs(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_two_periods(w):
    assert periodic.runs(w, 2, 2) == brute_runs(w, 2, 2)


def test_all_squares_are_squares_and_no_run_lacks_one():
    rng = random.Random(1)
    for _ in range(50):
        w = rng.choices("ab", k=60)
        for end, d in periodic.squares(w):
            assert end + 1 >= 2 * d and w[end + 1 - d : end + 1] == w[end + 1 - 2 * d : end + 1 - d]


def test_periodic_runs_query_form(spark):
    rng = random.Random(2)
    texts = [None, "", "one", "a a a a a", "b b b b b b", "x y " * 4 + "x", "so " + "la la lu " * 5 + "end", " ".join(rng.choices("abc", k=400)), "q " * 30_000, "n1 n2 n3 n4 n5 " * 4_000 + "tail"]
    rows = [(i if i else None, t, 3, "x") for i, t in enumerate(texts)] + [(4, texts[4], 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    found = sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodic.find_runs(docs).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w) - (w[-1] == "tail"), 1 if w[0] == "q" else 5)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert found == sorted(want, key=repr)
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_looped_words_follow_the_checksum():
    done = 0
    for i in range(200):
        h, w = zlib.crc32(str(i).encode()), [f"w{k}" for k in range(57)]
        got = periodic.looped(i, w)
        if h % 10:
            assert got == w
            continue
        a = (h // 10) % 57
        p = 1 + (57 - a) // (3 + h // 10 % 8)
        assert got == [w[k] if k < a else w[a + (k - a) % p] for k in range(57)]
        done += 1
    assert done > 10 and periodic.looped(None, ["a"]) == ["a"] and periodic.looped(5, []) == []


def test_queries_hash_their_results(spark, tmp_path):
    docs = [(i, ("r s " * 6 if i % 4 else "plain words only ") + f"d{i}") for i in range(60)] + [(60, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, t in docs:
        w = periodic.looped(i, WORD.findall(t or ""))
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want = (i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(got[i]) == want
    assert repeats.op12_substring_dedup(spark, str(tmp_path)).where(F.col("doc_id") == 60).collect()[0]["n_words"] == 0
