"""The language classifier against a kernel ridge regression written out, and very long inputs of other operators."""

import base64
import hashlib
import random

import numpy as np

from sagitta.llm import html, jaccard, langid, warc


def spectrum(text):
    """Weighted distinct n-grams of letters, runs of other characters being one symbol, by their definition."""
    symbol = lambda c: 0 if not c.isalpha() else ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % 37
    s: list[int] = []
    for x in [0, *map(symbol, text), 0]:
        if x or not s or s[-1]:
            s.append(x)
    return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)} if any(s) else set()


def kernel(x, y):
    weigh = lambda grams: sum({1: 0.25, 2: 1.0, 3: 1.0}[len(g)] for g in grams)
    return weigh(x & y) / (weigh(x) * weigh(y)) ** 0.5


def test_language_scores_are_those_of_kernel_ridge_regression(monkeypatch):
    rng = random.Random(6)
    syllables = {"p": ["ka", "to", "mi", "re"], "q": ["scht", "une", "éa", "ol"], "r": ["да", "не", "мо", "лу"]}
    text = lambda lang: " ".join("".join(rng.choices(syllables[lang] + ["an"], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 25)))
    learned = [(lang, text(lang)) for lang in "pqr" for _ in range({"p": 20, "q": 12, "r": 5}[lang])]
    asked = [text(rng.choice("pqr")) + rng.choice(["", " 12, 3!", " Kato"]) for _ in range(40)]
    monkeypatch.setattr(langid, "LANDMARKS", 15)
    model = langid.Classifier([(lang, np.unique(langid.gram_codes(t)).astype(np.int32)) for lang, t in learned])
    langs, score = model.predict([*asked, None, "", " 1!"])

    sets = [spectrum(t) for _, t in learned]
    by_lang = {x: [i for i, (y, _) in enumerate(learned) if y == x] for x in "pqr"}
    turns = [of[k] for k in range(20) for of in by_lang.values() if k < len(of)][:15]
    marks = [sets[i] for i in turns]
    # n-grams that no landmark has are no part of the space
    space = set().union(*marks)
    sets, marks = [s & space for s in sets], [s & space for s in marks]
    of = lambda rows: np.c_[np.array([[kernel(x, y) for y in marks] for x in rows]), np.ones(len(rows))]
    z, n = of(sets), len(sets)
    penalty = np.eye(16)
    penalty[:15, :15] = np.array([[kernel(x, y) for y in marks] for x in marks])
    y = np.array([[1.0 if lang == x else -1.0 for x in "pqr"] for lang, _ in learned])
    each = np.diag([n / 3 / len(by_lang[lang]) for lang, _ in learned])
    theta = np.linalg.solve(z.T @ each @ z + langid.RIDGE * n * penalty, z.T @ each @ y)
    margins = of([spectrum(t) & space for t in asked]) @ theta
    assert np.allclose(score[:-3], np.clip((margins.max(1) + 1) / 2, 0, 1), atol=2e-3)
    sure = np.diff(np.sort(margins, axis=1)[:, -2:], axis=1)[:, 0] > 1e-2
    assert sure.sum() > 30 and [a for a, s in zip(langs, sure) if s] == ["pqr"[k] for k, s in zip(margins.argmax(1), sure) if s]
    assert langs[-3:] == ["und"] * 3 and not score[-3:].any()


def test_very_long_inputs(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**7)}" for _ in range(120_000)]
    long, near = " ".join(words), " ".join([*words[:-100], "other", *words[-99:]])
    docs = spark.createDataFrame([(1, long), (2, near), (3, "short one here now"), (4, "x" * 3_000_000 + " y z u")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, 85).collect()}
    assert found[1][1] == found[2][1] == 1 and found[1][0] > 119_000 and found[3] == (1, 3) and found[4] == (1, 4)
    lines = "".join(f"<p>line {k} of a long page</p>" for k in range(30_000))
    pages = spark.createDataFrame([(1, "http://h/a", f"<article>{lines}</article>"), (2, "http://h/b", f"<article><p>mine</p>{lines[:9000]}</article>"), (3, "http://h/c", "<p>z</p>")], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert text[1].count("\n") == 29_999 and text[2].startswith("mine\nline 0 of")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    digests = {r["page_id"]: r["payload_digest"] for r in warc.op6_warc_revisits(spark, str(tmp_path)).collect()}
    assert digests[1] == base64.b32encode(hashlib.sha1(f"<article>{lines}</article>".encode()).digest()).decode()
