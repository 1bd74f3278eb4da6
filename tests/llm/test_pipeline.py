"""The pipeline's stages and all of it against brute force."""

import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sagitta.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(12)
    words = {"en": ["the", "and", "of", "house", "river", "stone", "light", "winter"], "de": ["und", "der", "haus", "fluß", "stein", "licht", "über", "nicht"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en", str(rng.randint(0, 9))]) for _ in range(n))
    items = [(i, text("en", n)) for i, n in enumerate([12, 15, 10, 4, 30])] + [(9, None)]
    rows = [(i, text(lang, rng.choice([3, 20, 60, 200])), lang) for i, lang in enumerate(rng.choices(["en", "de"], k=80))]
    copies = [(100 + i, rows[i % 10][1] + rng.choice(["", " one more", ""]), rows[i % 10][2]) for i in range(30)]
    dirty = [(200 + i, f"{text('en', 9)} {items[i % 5][1].upper()}, {text('en', 7)}", "en") for i in range(10)]
    odd = [(300, None, "en"), (301, "", None), (302, "12 34 !?", "en"), (303, "été", None), (304, "a " * 20000 + "river", "en"), (305, rows[0][1], "en"), (306, rows[0][1].upper(), None)]
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in [*rows, *copies, *dirty, *odd, rows[0], (5, "another text of an id that is there", "en")]]
    return docs, items


def brute(docs, items):
    """What is left after all stages: (id, text) of each row."""
    left = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    # near duplicates
    nodes = {}
    for i, t in left:
        w = BLANK.findall(t.translate(LOWER))
        shingles = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        nodes.setdefault(shingles, []).append((i, t))
    groups = {s: s for s in nodes}

    def root(s):
        while groups[s] is not s:
            s = groups[s]
        return s

    sets = [s for s in nodes if s]
    for n, a in enumerate(sets):
        for b in sets[:n]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                groups[root(a)] = root(b)
    first = {}
    for s in sets:
        for i, t in nodes[s]:
            first.setdefault(root(s), []).append((i, t))
    left = [min(rows, key=lambda r: r[0]) for rows in first.values()]
    # benchmark
    windows = set()
    for _, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    def hit(t):
        w = WORD.findall(t.translate(LOWER))
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    return [(i, t) for i, t in left if not hit(t)]


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs, items = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in want)
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    # of texts with one set, any may be the one that stays
    texts = {i: {t for j, t, *_ in docs if j == i and t} for i, _ in want}
    for r in rows:
        ids = [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)]
        assert len(ids) == r["n_tokens"] and any(library.encode(t, add_special_tokens=False).ids == ids and library.decode(ids, skip_special_tokens=False) == r["decoded"] for t in texts[r["doc_id"]])


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame(docs, COLUMNS).withColumn("n", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("row", F.lit(2)).withColumn("spans", F.lit(None).cast("string"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and out.count() > 0, name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, table.limit(0), str(tmp_path)).count() == 0


def test_pipeline_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "corpus_pipeline" in sys.modules


def test_languages_are_identified_and_kept(spark, tmp_path):
    """Every row has the language of its text, also where none or a wrong one is given, and brings it to the end."""
    docs, items = corpus()
    given = {i: (t, lang) for i, t, lang, *_ in docs if i < 80 and i != 5}
    # of documents that nothing is learned from some have no language, others a wrong one
    held = [i for i in given if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = {i: None if k % 2 else {"en": "de", "de": "en"}[given[i][1]] for k, i in enumerate(held)}
    table = spark.createDataFrame([(i, t, wrong.get(i, lang), s, n) for i, t, lang, s, n in docs], COLUMNS)
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, table, str(tmp_path)).collect()}
    assert len(held) > 10 and set(found.values()) == {"de", "en"}
    assert all(found[i] == given[i][1] for i in held if len(given[i][0].split()) >= 20)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "lang").collect()
    assert rows and all(found[r["doc_id"]] == r["lang"] for r in rows if r["doc_id"] != 5)
