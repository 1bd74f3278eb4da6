"""Closure, components and overlaps of orbits against brute force."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sagitta.operators import closure as C
from sagitta.operators import components as K
from sagitta.operators import generate as G


def mutate(q, k):
    return tuple(tuple(-b if k in (i, j) else b + (abs(q[i][k]) * q[k][j] + q[i][k] * abs(q[k][j])) // 2 for j, b in enumerate(r)) for i, r in enumerate(q))


def within(q, bound=2):
    return all(abs(b) <= bound for r in q for b in r)


def reached(q):
    seen, todo = {q}, [q]
    while todo:
        at = todo.pop()
        for k in range(len(at)):
            to = mutate(at, k)
            if within(to) and to not in seen:
                seen.add(to)
                todo.append(to)
    return seen


def quiver(rng, n, values=(0, 0, 1, -1, 2, -2)):
    m = [[0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            m[i][j] = rng.choice(values)
            m[j][i] = -m[i][j]
    return tuple(map(tuple, m))


def relabeled(q, p):
    return tuple(tuple(q[i][j] for j in p) for i in p)


def test_orbits_of_seeds_that_share_quivers(spark):
    rng = random.Random(4)
    seeds = [("none", None), ("one", ((0,),))]
    for n in (2, 3, 4, 5):
        q = quiver(rng, n, (0, 0, 1, -1))
        seeds += [(f"{len(seeds)}", q), (f"{len(seeds) + 1}", relabeled(q, rng.sample(range(n), n)))]
    frame = spark.createDataFrame([(s, None if q is None else [list(r) for r in q]) for s, q in seeds], "seed string, matrix array<array<int>>")
    found = {}
    for r in G.bfs_orbit(spark, frame).collect():
        assert found.setdefault(r["seed"], {}).setdefault(tuple(map(tuple, r["matrix"])), r["is_boundary"]) == r["is_boundary"]
    for s, q in seeds[1:]:
        want = {x: any(not within(mutate(x, k)) for k in range(len(x))) for x in reached(q)}
        assert found[s] == want
    assert "none" not in found
    # a seed with two matrices has what both reach, once
    twice = spark.createDataFrame([("s", [[0, 1], [-1, 0]]), ("s", [[0, -1], [1, 0]]), ("s", [[0, 2], [-2, 0]])], "seed string, matrix array<array<int>>")
    assert G.bfs_orbit(spark, twice).count() == 4
    large = spark.createDataFrame([("big", [[0] * 8] * 8)], "seed string, matrix array<array<int>>")
    with pytest.raises(ValueError):
        G.bfs_orbit(spark, large)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_rounds_of_any_depth_find_the_same(spark, levels):
    path = [[(j == i + 1) - (j == i - 1) for j in range(5)] for i in range(5)]
    start = C.canonical_codes(spark.createDataFrame([(path,)], "matrix array<array<int>>").select(F.lit(5).alias("n"), C.coded(F.col("matrix")).alias("code"))).select("n", F.col("ccode").alias("code"))
    steps = C.steps_from(start, levels=levels).collect()
    forms = {min(relabeled(q, p) for p in permutations(range(5))) for q in reached(tuple(map(tuple, path)))}
    assert len(steps) == 5 * len(forms) and len({r["code"] for r in steps}) == len(forms)


def test_seven_vertices(spark):
    kern = C.kernel(7, 2)
    rng = random.Random(9)
    qs = [quiver(rng, 7) for _ in range(5)]
    import numpy as np

    m = np.array(qs)
    codes = kern.codes(m)
    assert (kern.matrices(codes) == m).all()
    form, which = kern.canonical(codes)
    for q, f, w in zip(qs, form, which):
        assert kern.codes(np.array([relabeled(q, kern.perms[w])]))[0] == f
        assert f == min(int(kern.codes(np.array([relabeled(q, p)]))[0]) for p in [*permutations(range(7))][::97]) or f <= int(codes.min())
    assert [tuple(map(tuple, r["matrix"])) for r in G.decoded(spark.createDataFrame([(7, int(c)) for c in codes], "n int, code long"), most=7).collect()] == qs
    with pytest.raises(ValueError):
        C.kernel(8, 2)


def test_generation_of_five_vertices(spark):
    """The quivers on five vertices that one of them reaches, with the sizes that brute force finds."""
    a5 = [[0, 2, 0, 0, 0], [-2, 0, 1, 0, 0], [0, -1, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, -1, 0]]
    g = G.generation_of(spark, spark.createDataFrame([(a5,), (None,), ([],)], "matrix array<array<int>>"), max_vertices=5)
    row = g.classes.collect()[0]
    orbit = reached(tuple(map(tuple, a5)))
    assert (row["n"], row["is_open"], row["labeled_size"], row["merged_orbit_count"]) == (5, True, len(orbit), 1)
    assert G.consistency_violations(g).count() == 0
    assert G.all_seeds(spark, 5).where("n = 5").count() == 82_880
    with pytest.raises(ValueError):
        G.generation_of(spark, spark.createDataFrame([([[0, 3], [-3, 0]],)], "matrix array<array<int>>"))


def roots(nodes, edges):
    parent = {x: x for x in [*nodes, *(v for e in edges for v in e)]}

    def of(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = of(a), of(b)
        parent[max(a, b)] = min(a, b)
    return {x: of(x) for x in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, monkeypatch):
    rng = random.Random(seed)
    n = 400
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((60, 180, 330)[seed])] + [(5, 5), (1, 2), (2, 1), (-7, 3)]
    path = [(1000 + i, 1001 + i) for i in range(150)]
    nodes = [*range(n), *range(1000, 1151)]
    frame = spark.createDataFrame([*edges, *path, (None, 4), (4, None)], "src long, dst long")
    found = {r["node"]: r["root"] for r in K.connected_components(spark.createDataFrame([(x,) for x in nodes], "node long"), frame).collect()}
    assert found == roots(nodes, edges + path)


def test_components_with_a_node_in_half_of_all_edges(spark):
    """The hot node's edges are joined by broadcast: no partition of the joined rows holds more than its share."""
    n = 20_000
    star = spark.range(1, n).select(F.lit(n + 5).cast("long").alias("src"), F.col("id").alias("dst"))
    pairs = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 2 * n).alias("dst"))
    edges = star.unionByName(pairs)
    nodes = spark.range(1, 3 * n).withColumnRenamed("id", "node")
    sizes = K.connected_components(nodes, edges).groupBy("root").count().collect()
    assert max(r["count"] for r in sizes) == 2 * (n - 1) + 1 and min(r["root"] for r in sizes) == 1
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).repartition(8)
    joined = K.lookup_join(both, K._least(both), "u", "degree", 2 * (n - 1))
    assert joined.count() == 2 * (n - 1)
    of_hot = [r["count"] for r in joined.where(F.col("u") == n + 5).groupBy(F.spark_partition_id()).count().collect()]
    assert len(of_hot) == 8 and max(of_hot) < 2 * sum(of_hot) / 8


def test_one_quiver_in_ten_thousand_orbits(spark):
    many = spark.range(10_000).select(F.col("id").alias("orbit"), F.lit(True).alias("is_open"), F.lit("q").alias("qid"))
    own = spark.range(10_000).select(F.col("id").alias("orbit"), F.lit(True).alias("is_open"), F.concat(F.lit("own"), F.col("id").cast("string")).alias("qid"))
    over = G.orbit_overlaps(many.unionByName(own))
    assert over.count() == 9_999 and over.agg(F.max("a"), F.min("quivers"), F.max("quivers")).collect()[0][:] == (0, 1, 1)
    assert G.gluing_counters(many.unionByName(own)).collect()[0][:] == (0, 0, 9_999)


def test_gluing_counts_unions(spark):
    rows = [(0, False, "a"), (1, False, "a"), (2, False, "a"), (3, True, "a"), (3, True, "b"), (4, True, "b"), (5, True, "b"), (6, False, "c"), (7, True, "d"), (4, True, "b")]
    frame = spark.createDataFrame(rows, "orbit int, is_open boolean, qid string")
    # three closed ones are one, three open ones are one, and these two are one
    assert G.gluing_counters(frame).collect()[0][:] == (2, 1, 2)
    assert sorted(map(tuple, G.orbit_overlaps(frame).collect())) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (3, 4, 1), (3, 5, 1)]


def test_orbits_of_many_seeds_are_dealt_to_many_tasks(spark, monkeypatch):
    """Five hundred seeds of one orbit, read once: no task makes a large part of the result, and relabeled orbits are made once."""
    for name, value in (("SEEDS_OF_KEY", 20), ("MEMBERS_OF_KEY", 10), ("ROWS_OF_TASK", 500)):
        monkeypatch.setattr(G, name, value, raising=False)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    q = ((0, 1, 0, 0), (-1, 0, 1, 0), (0, -1, 0, 1), (0, 0, -1, 0))
    ids = spark.range(500, numPartitions=2).mapInArrow(counted, "id long")
    seeds = ids.select(F.col("id").alias("seed"), F.lit([[*r] for r in q]).alias("matrix"))
    found = G.bfs_orbit(spark, seeds).select("seed", F.to_json("matrix").alias("m"), F.spark_partition_id().alias("p")).cache()
    want = len(reached(q))
    assert found.count() == found.distinct().count() == 500 * want and {r[0] for r in found.groupBy("seed").count().select("count").distinct().collect()} == {want}
    assert max(r[0] for r in found.groupBy("p").count().select("count").collect()) < 500 * want / 4
    assert read.value == 500


def test_components_delete_the_tables_of_their_rounds(spark, tmp_path, monkeypatch):
    from sagitta.sources import storage

    monkeypatch.setattr(storage, "work_dir", lambda _: f"{tmp_path}/sagitta-{len([*tmp_path.iterdir()])}-{random.random()}")
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [r[:] for r in K.connected_components(path.select(F.col("src").alias("node")), path).groupBy("root").count().collect()] == [(0, 300)]
    assert len([*tmp_path.iterdir()]) <= 2


def test_ends_of_edges_as_nodes(spark):
    rows = [(1, 2), (2, 3), (5, 5), (7, None), (None, 8), (2, 1)]
    frame = spark.createDataFrame(rows, "src long, dst long")
    assert {r[:] for r in K.connected_components(None, frame).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 8), (None, None)}


@pytest.mark.parametrize("end", ["src", "dst"])
def test_components_with_hot_nodes_of_either_end(spark, end):
    """A hot node in the middle of the numbers has thousands of smaller and of larger neighbours."""
    n, other = 3000, "dst" if end == "src" else "src"
    star = spark.range(2 * n).select(F.lit(n).cast("long").alias(end), F.col("id").alias(other))
    tail = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 10 * n).alias("dst"))
    found = K.connected_components(None, star.unionByName(tail)).groupBy("root").count().collect()
    assert [r[:] for r in found] == [(0, 2 * n + n - 1)]


@pytest.mark.parametrize("shift", [0, 999_999_990])
def test_trade_components_by_numbers_and_by_names(spark, tmp_path, shift):
    """Keys that names don't put in order, and null keys, give what the SQL does."""
    import duckdb

    from sagitta.plans import oracles, queries

    rng = random.Random(5)
    orders = [(i, rng.choice([None, *range(1 + shift, 21 + shift)]), rng.choice(["1995-01-31", "1995-02-01", "2001-12-31"])) for i in range(60)]
    lines = [(rng.randrange(70), rng.choice([None, *range(1 + shift, 16 + shift)])) for _ in range(110)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.col("d").cast("date")).drop("d").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = c.execute(oracles.SQL["trade_components"]).fetchall()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted((r[:] for r in queries.trade_components(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
