"""Every training-data query by its name, and its SQL where SQL can express it."""

from __future__ import annotations

from . import bpe, codes, decontaminate, html, jaccard, langid, licences, periodic, ppm, repeats, sharding, topk, warc

_MODULES = (decontaminate, html, sharding, licences, bpe, warc, langid, ppm, topk, jaccard, codes, repeats, periodic)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
