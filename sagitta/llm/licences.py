"""Licence labels by a positional rare-token index, in DataFrame functions only.

One pass over the texts counts words and base phrases, lists the licence words of each, and keeps the words of those that have
all key words of a template (few; the others are never read again). From the lists comes in how many texts each licence word
stands, and from that the index: postings (template, position) of each template's anchors, which are as many highest-IDF words
of its key as must agree, so that no place where the key stands is missed, or all its words if the key has fewer. A text's
words are looked up in the index, postings that agree on the relative position of text and template make a candidate, and the
mandatory key phrase must stand, word by word, where that position says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key)] == self.key)

    @property
    def need(self) -> int:
        """Postings that must agree: of short templates two, of long ones four."""
        return 2 if len(self.words) <= 8 else 4


def _template(label: str, text: str, key: str) -> Template:
    return Template(label, tuple(text.split()), tuple(key.split()))


#: Openings of well-known licence notices (words in lower case, without punctuation) and the phrase that must stand in each.
TEMPLATES = (
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    _template("gpl", "this work is licensed under the gnu general public license version", "gnu general public license"),
    _template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    _template("gpl-2.0", "the gnu general public license version 2", "general public license version 2"),
    _template("gpl-3.0", "the gnu general public license version 3", "general public license version 3"),
    _template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    _template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    _template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    _template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    _template("cc-by", "licensed under the creative commons attribution license", "creative commons attribution"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    _template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    _template("apache-1.1", "licensed under the apache software license version 1 1", "apache software license version 1 1"),
    _template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "neither the name of the copyright holder nor the names"),
    _template("bsd", "released under the bsd license", "bsd license"),
    _template("bsd-2-clause", "licensed under the simplified bsd license", "simplified bsd license"),
    _template("bsd-3-clause", "licensed under the new bsd license", "new bsd license"),
    _template("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials mentioning features"),
    _template("mit", "the software is provided as is without warranty of any kind express or implied", "the software is provided as is without warranty"),
    _template("mit", "use of this source code is governed by an mit style license that can be found in the license file", "mit style license"),
    _template("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd style license"),
    _template("mit-0", "released under the mit no attribution license", "mit no attribution"),
    _template("isc", "released under the isc license", "isc license"),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    _template("zlib", "released under the zlib license", "zlib license"),
    _template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    _template("lgpl-2.1", "the gnu lesser general public license version 2 1", "lesser general public license version 2 1"),
    _template("lgpl-3.0", "the gnu lesser general public license version 3", "lesser general public license version 3"),
    _template("lgpl-2.0", "under the terms of the gnu library general public license as published by the free software foundation", "library general public license"),
    _template("agpl-3.0", "the gnu affero general public license version 3", "affero general public license version 3"),
    _template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    _template("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla public license version 1 1"),
    _template("epl-1.0", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    _template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    _template("epl", "under the terms of the eclipse public license", "eclipse public license"),
    _template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    _template("cpl-1.0", "made available under the terms of the common public license v1 0", "common public license v1 0"),
    _template("eupl", "licensed under the european union public licence", "european union public licence"),
    _template("artistic-2.0", "under the terms of the artistic license version 2 0", "artistic license version 2 0"),
    _template("artistic", "under the terms of the artistic license", "artistic license"),
    _template("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    _template("ms-rl", "licensed under the microsoft reciprocal license", "microsoft reciprocal license"),
    _template("psf-2.0", "licensed under the python software foundation license version 2", "python software foundation license"),
    _template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    _template("wtfpl", "do what the fuck you want to public license", "want to public license"),
    _template("postgresql", "released under the postgresql license", "postgresql license"),
    _template("upl-1.0", "licensed under the universal permissive license v 1 0", "universal permissive license"),
    _template("afl-3.0", "licensed under the academic free license version 3 0", "academic free license version 3 0"),
    _template("osl-3.0", "licensed under the open software license version 3 0", "open software license version 3 0"),
    _template("odbl", "made available under the open database license", "open database license"),
    _template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights"),
    _template("cc0", "released under the cc0 1 0 universal public domain dedication", "public domain dedication"),
    _template("public-domain", "this work is in the public domain", "work is in the public domain"),
    _template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    _template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    _template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    _template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    _template("cc-by-nc-sa", "licensed under cc by nc sa", "cc by nc sa"),
    _template("cc-by-nc-nd", "licensed under cc by nc nd", "cc by nc nd"),
    _template("proprietary", "this software contains confidential and proprietary information", "confidential and proprietary information"),
)


#: What WORD leaves out, after lower-casing.
_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _words(text: Column) -> Column:
    """The words of WORD in the text, A-Z lower-cased; splitting at a blank is faster than a pattern."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper + _BETWEEN, upper.lower() + " " * len(_BETWEEN)), " "), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; looked for only where its longest word stands at all."""
    parts = phrase.split()
    here = lambda i: F.get(words, i) == parts[0]
    at = lambda i: [F.get(words, i + k) == w for k, w in enumerate(parts)]
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: here(i) & F.coalesce(_all(at(i)), F.lit(False)))
    return F.when(F.array_contains(words, max(parts, key=len)), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def licence_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, base_labels, found, score`` for every row of ``docs``.

    ``places``: starts of the base phrases, words from 0; ``base_labels``: array of their labels; ``found``: array of
    ``label, at`` of the verified templates; ``score``: the largest share of a verified template's words that stand in
    place, 1 where a base phrase stands, else 0. A null text has no words and no labels. Repeated rows are treated each
    by itself; texts of any length are read whole; an empty table gives no rows; other columns play no part. Which words are
    anchors, ties by the alphabet, changes the work only, not what is found.
    """
    base = BASE if base is None else base
    vocabulary = sorted({w for t in templates for w in t.words})
    # one word of each key, without which no template can be verified
    marks = _strings(sorted({max(t.key, key=len) for t in templates}))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), _strings(sorted({*t.key})).alias("key")) for i, t in enumerate(templates)])
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words")).withColumn("known", F.array_intersect("words", _strings(vocabulary)))
    likely = F.transform(F.filter(keys, lambda t: F.size(F.array_except(t["key"], F.col("known"))) == 0), lambda t: t["t"])
    rows = rows.withColumn("likely", F.when(F.arrays_overlap("known", marks), likely).otherwise(F.array().cast("array<int>")))
    rows = written(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array(*[_places(F.col("words"), p) for p in base]).alias("by_phrase"), "known", "likely", F.when(F.size("likely") > 0, F.col("words")).alias("words")))
    df = dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in rows.select(F.explode("known").alias("w")).groupBy("w").count().collect()}

    index: dict[str, list[Column]] = {}
    for n, t in enumerate(templates):
        rarest = sorted({*t.key}, key=lambda w: (df[w], w))
        chosen = rarest[: t.need] if len(rarest) >= t.need else t.words
        for j, w in enumerate(t.words):
            if w in chosen:
                index.setdefault(w, []).append(F.struct(F.lit(n).alias("t"), F.lit(j).alias("j"), F.lit(t.need).alias("need")))
    postings_of = F.create_map(*[x for w, of in index.items() for x in (F.lit(w), F.array(*of))])
    all_templates = F.array(*[F.struct(F.lit(t.label).alias("label"), _strings(t.words).alias("words"), _strings(t.key).alias("key"), F.lit(t.key_at).alias("key_at")) for t in templates])
    # postings of the text's words in templates that are likely, by template and relative position
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(_strings(sorted(index)), x["w"]))
    agreeing = F.flatten(F.transform(places, lambda x: F.transform(F.filter(postings_of[x["w"]], lambda y: F.array_contains("likely", y["t"])), lambda y: F.struct(y["t"].alias("t"), (x["i"] - y["j"]).alias("at"), y["j"].alias("j"), y["need"].alias("need")))))
    rows = rows.withColumn("postings", F.when(F.size("likely") > 0, F.array_sort(agreeing)))
    # in sorted order, ``need`` of one template and position stand in a row
    same = lambda x, i: F.coalesce((F.get("postings", i + x["need"] - 1)["t"] == x["t"]) & (F.get("postings", i + x["need"] - 1)["at"] == x["at"]), F.lit(False))
    tried = F.transform(F.filter("postings", same), lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at")))
    rows = rows.withColumn("tried", F.array_distinct(F.coalesce(tried, F.array().cast("array<struct<t: int, at: int>>"))))
    of = lambda c: F.element_at(all_templates, c["t"] + 1)
    right = lambda c: (c["at"] + of(c)["key_at"] >= 0) & (F.slice("words", F.greatest(c["at"] + of(c)["key_at"], F.lit(0)) + 1, F.size(of(c)["key"])) == of(c)["key"])
    share = lambda c: F.size(F.filter(F.transform(of(c)["words"], lambda w, j: F.get("words", c["at"] + j) == w), lambda x: F.coalesce(x, F.lit(False)))) / F.size(of(c)["words"])
    rows = rows.withColumn("found", F.transform(F.filter("tried", right), lambda c: F.struct(of(c)["label"].alias("label"), c["at"].alias("at"), share(c).alias("share"))))
    labels = F.filter(F.transform(F.arrays_zip(_strings(list(base.values())).alias("label"), F.col("by_phrase").alias("places")), lambda x: F.when(F.size(x["places"]) > 0, x["label"])), lambda x: x.isNotNull())
    score = F.greatest(F.when(F.size(F.flatten("by_phrase")) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.flatten("by_phrase").alias("places"), labels.alias("base_labels"), "found", score.alias("score"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all ``documents``."""
    rows = licence_labels(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"), joined(F.concat("base_labels", F.transform("found", lambda x: x["label"]))).alias("labels"), "score",
    )


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b(label, key) AS (VALUES {", ".join(f"('{label}', {_listed(p.split())})" for p, label in BASE.items())}),
bp AS (SELECT doc_id, label, i - 1 AS p FROM (SELECT doc_id, w, label, key, unnest(range(1, len(w) - len(key) + 2)) AS i FROM d JOIN b ON list_has_all(w, key)) WHERE w[i:i + len(key) - 1] = key),
ba AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM bp GROUP BY doc_id),
t(label, words, key, key_at, need) AS (VALUES {", ".join(f"('{t.label}', {_listed(t.words)}, {_listed(t.key)}, {t.key_at}, {t.need})" for t in TEMPLATES)}),
c AS (SELECT doc_id, w, label, words, need, i - 1 - key_at AS pos FROM (SELECT doc_id, w, t.*, unnest(range(1, len(w) - len(key) + 2)) AS i FROM d JOIN t ON list_has_all(w, key)) WHERE w[i:i + len(key) - 1] = key),
m AS (SELECT doc_id, label, need, len(words) AS n, len(list_filter(range(0, len(words)), lambda j: pos + j >= 0 AND pos + j < len(w) AND w[pos + j + 1] = words[j + 1])) AS hits FROM c),
tl AS (SELECT doc_id, label, max(hits::DOUBLE / n) AS share FROM m WHERE hits >= need GROUP BY doc_id, label),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bp UNION ALL SELECT doc_id, label FROM tl) GROUP BY doc_id),
ts AS (SELECT doc_id, max(share) AS share FROM tl GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(ba.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(ba.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, greatest(CASE WHEN ba.n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(share, 0.0)) AS score
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN ts USING (doc_id)
"""

QUERIES = {"op4_licence_scan": op4_licence_scan}
ORACLES = {"op4_licence_scan": ORACLE}
