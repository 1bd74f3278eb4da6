import pytest
from pyspark.sql import functions as F

from sagitta.operators import acyclicity as ac
from sagitta.operators import generate as G
from sagitta.operators.catalogue import catalogue, generation
from sagitta.plans.queries import SEEDS, seed_frame


def test_counts(spark):
    g = generation(spark)
    assert {r[0]: r[1] for r in g.quivers.groupBy("n").count().collect()} == {1: 1, 2: 3, 3: 25, 4: 695}
    sizes = {r["dynkin_type"]: r["labeled_size"] for r in catalogue(spark).classes.where("dynkin_type is not null").collect()}
    assert (sizes["A2"], sizes["A3"], sizes["D4"], sizes["A4"], sizes["A1 + A2"]) == (2, 14, 50, 144, 2)
    assert g.quivers.select("mc_id").distinct().join(g.classes, "mc_id").count() == g.classes.count()
    assert G.consistency_violations(g).count() == 0


def test_packed_codes_order_as_matrices(spark):
    rows = G.decoded(G.labeled_matrices(spark, 3), most=3).orderBy("matrix").select("code").collect()
    assert [r[0] for r in rows] == [*range(125)]
    with pytest.raises(ValueError):
        G.Packed(6)


def test_five_vertices_canonical_code(spark):
    p = G.Packed(5)
    one = spark.createDataFrame([(123456,), (9765624,)], "code long").withColumns(p.digits(F.col("code"))).select("code", p.canonical().alias("c"), p.matrix().alias("m"))
    from sagitta.functions import matrix as mx

    again = one.withColumn("want", mx.canonical_form(F.col("m"))).select("want", F.lit(5).alias("n"), F.col("c").alias("code"))
    assert all(r["want"] == r["matrix"] for r in G.decoded(again).collect())


def test_bfs(spark):
    found = {r[0]: (r[1], r[2]) for r in G.bfs_orbit(spark, seed_frame(spark)).groupBy("seed").agg(F.count(F.lit(1)), F.count_if("is_boundary")).collect()}
    assert {k: found[k][0] for k in ("A2", "A3", "D4", "zero2", "markov", "kronecker")} == {"A2": 2, "A3": 14, "D4": 50, "zero2": 1, "markov": 2, "kronecker": 2}
    assert found["open3"][1] > 0 and found["D4"][1] == 0
    with pytest.raises(ValueError):
        G.bfs_orbit(spark, spark.createDataFrame([("bad", [[0, 3], [-3, 0]])], "seed string, matrix array<array<int>>"))


def test_gluing(spark):
    row = lambda o, p, q: (o, p, q)
    frame = lambda rows: spark.createDataFrame(rows, "orbit int, is_open boolean, qid string")
    with pytest.raises(AssertionError):
        G.check_gluing(frame([row(0, False, "a"), row(0, False, "b"), row(1, False, "a")]))
    with pytest.raises(AssertionError):
        G.check_gluing(frame([row(0, False, "a"), row(1, True, "a")]))
    assert G.check_gluing(frame([row(0, True, "a"), row(1, True, "a")])) == {"closed_closed": 0, "closed_open": 0, "open_open": 1}


def test_mutation_acyclicity(spark):
    c = catalogue(spark)
    assert c.classes.where("mc_id = 'MC.n3.7405511b230b7552'").select("is_mutation_acyclic", "is_banff", "is_louise", "is_p_prime").collect()[0][:] == (False, False, False, False)
    assert c.quivers.where("quiver_id = 'Q.n4.128d2df494351df3'").join(c.classes, "mc_id").select("is_mutation_acyclic").collect()[0][0] is False
    base = ac.base_state(generation(spark)).join(c.classes.select("mc_id", "is_mutation_acyclic"), "mc_id").where("not base <=> is_mutation_acyclic")
    assert base.count() >= 1 and base.where("base is not null or is_mutation_acyclic").count() == 0


def test_search():
    assert ac.status(SEEDS["D4"], "louise") == ("true", {"mutations": [], "condition": "acyclic"})
    cycle = [[0, 1, -1], [-1, 0, 1], [1, -1, 0]]
    assert ac.mutation_path(cycle) == ("true", [0]) and ac.mutation_path(SEEDS["markov"]) == ("false", None) and ac.mutation_path(SEEDS["open3"], max_depth=0) == ("true", [])
    assert ac.status(cycle, "banff")[0] == "true"
    assert ac.status(SEEDS["markov"], "p_prime") == ("false", None)
    assert ac.status([[0, 3, -3], [-3, 0, 3], [3, -3, 0]], "banff", max_depth=2, cap=8, timeout=None)[0] == "unknown"
    # a vertex that only gives, on top of a cycle that never becomes acyclic
    hung = [[0, 1, 0, 0], [-1, 0, 2, -2], [0, -2, 0, 2], [0, 2, -2, 0]]
    assert ac.status(hung, "p_prime", max_depth=3, timeout=None, max_nodes=500)[0] in ("unknown", "false")
    assert ac.status(SEEDS["markov"], "banff", max_nodes=0)[0] == "unknown"
