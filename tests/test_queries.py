"""Every query against its SQL in DuckDB, on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from sagitta.plans.oracles import ORACLES
from sagitta.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(str([dict(zip(names, r))[c] for c in columns]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_the_library_does_not_import_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "sagitta")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read()), f


def test_local_acyclicity_of_all_classes(spark):
    from sagitta.operators.generate import decoded
    from sagitta.plans.queries import generation

    def mutate(q, k):
        return tuple(tuple(-b if k in (i, j) else b + (abs(q[i][k]) * q[k][j] + q[i][k] * abs(q[k][j])) // 2 for j, b in enumerate(r)) for i, r in enumerate(q))

    def without(q, *gone):
        return tuple(tuple(b for j, b in enumerate(r) if j not in gone) for i, r in enumerate(q) if i not in gone)

    def acyclic(q):
        n = len(q)
        paths = [[b > 0 for b in r] for r in q]
        for k in range(n):
            paths = [[paths[i][j] or paths[i][k] and paths[k][j] for j in range(n)] for i in range(n)]
        return not any(paths[i][i] for i in range(n))

    def state(q, kind, depth, known):
        """True or False, or None where an unfound member may lie beyond the depth or an entry of 8."""
        if q not in known:
            seen, layer, cut = {q}, {q}, False
            for _ in range(depth):
                near = {mutate(x, k) for x in layer for k in range(len(x))}
                layer = {x for x in near if all(abs(b) <= 8 for r in x for b in r)}
                cut |= layer != near
                layer -= seen
                seen |= layer
            cut |= bool(layer)
            sub = lambda x, *gone: state(without(x, *gone), kind, depth, known)
            good = any(map(acyclic, seen))
            for x in () if good else seen:
                for k in (k for k in range(len(x)) if all(b >= 0 for b in x[k])):
                    parts = [[sub(x, k)]] if kind == "p_prime" else [[sub(x, k), sub(x, j), *([sub(x, k, j)] if kind == "louise" else [])] for j in range(len(x)) if x[k][j]]
                    good |= any(all(p) for p in parts)
                    cut |= any(None in p for p in parts)
            known[q] = True if good else None if cut else False
        return known[q]

    g = generation(spark, DATA)
    classes = decoded(g.classes, g.bound, g.max_vertices).select("mc_id", "n", "matrix", "is_open").collect()
    assert {r["n"] for r in classes} == {1, 2, 3, 4}
    kept = {(kind, depth): {} for kind in ("banff", "louise", "p_prime") for depth in (8, 64)}
    want = {}
    for r in classes:
        depth = 8 if r["is_open"] else 64
        q = tuple(tuple(int(b) for b in row) for row in r["matrix"])
        want[r["mc_id"]] = tuple(state(q, kind, depth, kept[kind, depth]) for kind in ("banff", "louise", "p_prime"))
    rows = QUERIES["local_acyclicity_all"](spark, DATA).collect()
    assert len(rows) == len(classes) and {r["mc_id"]: (r["is_banff"], r["is_louise"], r["is_p_prime"]) for r in rows} == want
    proved = [r[f"{c}_proved"] for r in rows for c in ("banff", "louise", "p_prime") if r[f"is_{c}"]]
    assert proved and all(proved)
    said = {True: "true", False: "false", None: "unknown"}
    rows = QUERIES["provenance"](spark, DATA).collect()
    assert len(rows) == len(classes) and {r["mc_id"]: (r["banff"], r["louise"], r["p_prime"], r["method"] is not None) for r in rows} == {r["mc_id"]: (*(said[x] for x in want[r["mc_id"]]), r["is_open"]) for r in classes}


def test_false_witnesses_prove_nothing(spark):
    from sagitta.operators.acyclicity import certified

    star, cycle = [[0, 1, 1], [-1, 0, 0], [-1, 0, 0]], [[0, 1, -1], [-1, 0, 1], [1, -1, 0]]
    acyclic, moved = '{"mutations":[],"condition":"acyclic"}', '{"mutations":[0],"condition":"acyclic"}'
    source = lambda k, j, *w: '{"mutations":[],"condition":{"source":%d,"neighbor":%d,"witness_k":%s,"witness_j":%s%s}}' % (k, j, *w, "")
    cases = [
        ("a", "banff", star, acyclic, True), ("b", "banff", cycle, acyclic, False), ("c", "louise", cycle, moved, True), ("d", "banff", star, source(0, 1, acyclic, acyclic), True),
        ("e", "banff", star, source(1, 0, acyclic, acyclic), False), ("f", "banff", star, source(1, 2, acyclic, acyclic), False), ("g", "banff", star, source(0, 1, acyclic, "null"), False), ("h", "p_prime", star, None, False), ("i", "p_prime", star, "{}", False),
        ("j", "louise", star, source(0, 1, acyclic, acyclic), False), ("k", "p_prime", star, '{"mutations":[],"condition":{"source":0,"witness_k":' + acyclic + "}}", True),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "key string, kind string, matrix array<array<int>>, witness string")
    found = {r["key"]: r["valid"] for r in certified(rows).collect()}
    assert found == {c[0]: c[4] for c in cases}
