"""Decontamination, licences, BPE and language ID against brute force and edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sagitta.llm import bpe, decontaminate, langid, licences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, n_words string, spans int, items int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2) for i, t in texts], SCHEMA)


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "日本", "x1", "Zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, "..."), (None, "only here and nowhere else at all my dear old friend"), (3, "a second text of three")]
    docs = [(i, " ,".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", " " + (items[i % 12][1] or "") + "! "])) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "!?"), (63, "A Second TEXT of thrée"), (None, items[5][1]), (5, docs[5][1]), (64, "so only here and nowhere else at all my dear old friend it is"), (65, "q " * 30000 + items[4][1])]
    found = {}
    for r in decontaminate.find_hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect():
        found.setdefault((r["doc_id"], r["n_words"]), []).append((r["n_hit"], r["items"], [(s["first"], s["last"]) for s in r["spans"]]))
    assert sum(map(len, found.values())) == len(docs)
    for i, t in docs:
        w, hit, which = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= {*range(p, p + n)}
                        which |= {str(item)} if item is not None else set()
        for n_hit, got, spans in found[i, len(w)]:
            assert (n_hit, got) == (len(hit), sorted(which))
            assert {p for a, z in spans for p in range(a, z + 1)} == hit


def test_decontamination_blocks_and_removal(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "alpha beta gamma"), (3, "delta epsilon")], "item_id long, text string")
    docs = frame(spark, [(1, "Start. One two three four five six seven eight nine ten! End of a long text that goes on and on."), (2, "alpha, Beta gamma delta epsilon"), (3, None), (4, "clean")])
    one = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_hits(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_hits(docs, items).collect()} == one
    assert one == {1: (10, ["1"]), 2: (5, ["2", "3"]), 3: (0, []), 4: (0, [])}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()) == [3, 4]
    cut = decontaminate.decontaminate(docs, items, max_coverage=0.6)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Start. ! End of a long text that goes on and on.", 3: None, 4: "clean"}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).count() == 4 and decontaminate.find_hits(docs.limit(0), items).count() == 0


def test_licences(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "x All rights reserved. all Rights\nRESERVED cc by cc by", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.", "mit license is not released", None, "", "...", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "apache version license 2 0 licensed the under", "allrights reserved", "word " * 20000 + "All rights reserved", "reserved all rights reserved",
    ]
    docs = frame(spark, [*enumerate(texts), (None, texts[0]), (0, texts[0])])
    rows = licences.licence_labels(docs).collect()
    assert len(rows) == len(texts) + 2
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    by_id = {}
    for r in rows:
        text = texts[r["doc_id"] or 0]
        w = words(text)
        places = sorted(i for p in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r["n_words"] == len(w) and sorted(r["places"]) == places and {*r["base_labels"]} == {base[p] for p in base if f" {p} " in f" {' '.join(w)} "}
        assert 0 <= r["score"] <= 1
        by_id[r["doc_id"]] = {x["label"] for x in r["found"]}
    assert [by_id[i] for i in (0, 2, 3, 4, 9)] == [{"cc-by-nc"}, {"gpl", "gpl-3.0"}, {"mit"}, {"apache-2.0"}, {"mit"}]
    assert by_id[10] == set() and by_id[11] == set() and by_id[6] == set()
    assert licences.licence_labels(docs.limit(0)).count() == 0


def test_licences_of_several_notices(spark):
    ts = licences.TEMPLATES
    # in the first texts the ordinary words are the rarest, or stand often
    texts = [" ".join(t.words) for t in ts] + [" ".join(ts[i].words) + " and so on " + " ".join(ts[j].words) for i in range(len(ts)) for j in range(len(ts)) if i != j]
    texts += [" x ".join(" ".join(t.words) for t in ts), " y ".join(" ".join(t.words) for t in reversed(ts)), "the terms of mozilla public license is in it and " * 300 + "subject one two three four five mozilla public license"]
    texts += [" ".join(t.key) for t in ts] + ["word the of and or license " * 4000 + " ".join(ts[0].words) + " " + " ".join(ts[13].words)]
    found = {r["doc_id"]: sorted((x["label"], x["at"]) for x in r["found"]) for r in licences.licence_labels(frame(spark, [*enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        w, want = words(text), []
        for t in ts:
            for at in range(-len(t.words), len(w)):
                k = at + t.key_at
                if k >= 0 and tuple(w[k : k + len(t.key)]) == t.key and sum(0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(t.words)) >= t.need:
                    want.append((t.label, at))
        assert found[i] == sorted(want), text[:200]
    assert {x[0] for x in found[len(ts) * len(ts)]} == {t.label for t in ts}


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    rng = random.Random(5)
    texts = ["", None, "<|endoftext|>Hello <|startoftext|> world<|", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ á 'S'T I'll they'RE 1234 ½ ² ///...!!!", "a\x1cb\x85c​d﻿ 日本語 テスト 😀😀 العربية", "x" * 3000, "ab" * 500, "aaa" * 99, " \n\t "]
    texts += ["".join(rng.choices("aeinrsthoAB '.,", k=rng.randint(1, 80))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x370, 0x7FF), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(100)]
    docs = frame(spark, [*enumerate(texts), (None, "same"), (2, texts[2])])
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "same" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        want = library.encode(text, add_special_tokens=False)
        assert [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)] == want.ids, text
        assert r["decoded"] == library.decode(want.ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_bpe_new_words_go_together(monkeypatch):
    """Of a batch's thousands of new words only the few longest may be worked on one by one; the ids stay the library's."""
    tokenizers = pytest.importorskip("tokenizers")
    library, v = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary(open(bpe.default_path(), encoding="utf-8").read(), remembered=1000)
    rng, single, alone = random.Random(8), [], bpe.Vocabulary.symbols
    monkeypatch.setattr(bpe.Vocabulary, "symbols", lambda self, s: single.append(s) or alone(self, s))
    word = lambda: "".join(rng.choices("aeinrsthoücß'AÜİȺ²7.,-" if rng.random() < 0.9 else "aé日\u0301Σ😀\x1c", k=rng.randint(1, 14)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(20)] + ["Ab" * 400 + " end<|endoftext|>" + "é" * 900]
    for _ in range(2):  # the second time after all were forgotten
        for text, (ids, decoded) in zip(texts, v.encode(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert [*memoryview(ids).cast("I")] == want, text
            assert decoded == library.decode(want, skip_special_tokens=False)
    assert 0 < len(single) < 2 * bpe.TOGETHER
    pairs = [(rng.randrange(len(v.names)), rng.randrange(len(v.names))) for _ in range(5000)] + [*v.parts.values()][:5000]
    for _ in range(2):  # computed, then looked up
        assert v._fit(*bpe.np.array(pairs).T).tolist() == [v.compatible(a, b) for a, b in pairs]


def test_bpe_query_digests(spark, tmp_path):
    docs = frame(spark, [(1, "The cat"), (2, None)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in bpe.op5_bpe(spark, str(tmp_path)).collect()}
    assert rows[2]["n_tokens"] == 0 and rows[2]["ids_sha256"] == rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"the</w> cat</w>").hexdigest()


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "er", "th"], "de": ["sch", "ung", "ä", "ei"], "fr": ["eau", "é", "oi", "ç"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang, rng.choice([3, 30, 300])), lang) for i, lang in enumerate(rng.choices([*syllables], k=400))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, text("de", 20), None), (None, text("fr", 20), "fr"), (0, rows[0][1], rows[0][2]), (1004, text("en", 20000), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = ~langid.held_out()
    model = langid.fit(docs, learn)
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["lang_pred"] == "de" and found[None]["lang_pred"] == "fr" and found[1004]["lang_pred"] == "en"
    out = [(i, lang) for i, t, lang in rows if t and lang and i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i]["lang_pred"] == lang for i, lang in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = langid.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = langid.fit(docs.where(F.lit(False)), learn)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    # the kernel of two texts is what its definition says, up to the map's rank
    same = langid.Classifier([("x", langid.np.unique(langid.gram_codes("abc"))), ("y", langid.np.unique(langid.gram_codes("xyz")))])
    assert same.predict(["abc", "xyz"])[0] == ["x", "y"]


def test_language_stage_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "été", None), (3, "123 !?", None), (4, "", None), (5, None, None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert not model.langs and sorted(r["doc_id"] for r in langid.keep_known(docs, model, 0.0).collect()) == [1, 2]
