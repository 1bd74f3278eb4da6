import itertools
import math
import random
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagitta.functions import invariants as inv
from sagitta.functions import matrix as mx
from sagitta.operators import acyclicity as ac

# Matrices and ids that must come out the same.
A2, A3 = [[0, 1], [-1, 0]], [[0, 1, 0], [-1, 0, 1], [0, -1, 0]]
D4 = [[0, 1, 1, 1], [-1, 0, 0, 0], [-1, 0, 0, 0], [-1, 0, 0, 0]]
D4_PERM = [[0, -1, 0, 0], [1, 0, 1, 1], [0, -1, 0, 0], [0, -1, 0, 0]]
MARKOV = [[0, 2, -2], [-2, 0, 2], [2, -2, 0]]


def frame(spark, matrices):
    return spark.createDataFrame([(i, m) for i, m in enumerate(matrices)], "i int, m array<array<int>>")


def values(spark, matrices, of):
    return [r[0] for r in frame(spark, matrices).orderBy("i").select(of(F.col("m"))).collect()]


def test_golden(spark):
    assert values(spark, [[[0]], [[0, 0], [0, 0]], A2, [[0, 2], [-2, 0]], A3, MARKOV], mx.quiver_id) == [
        "Q.n1.db407f11d7ede59a", "Q.n2.fa99b1ac5b3d7708", "Q.n2.fa39ed964134c564", "Q.n2.572777783b0eef76", "Q.n3.760c251bd59844de", "Q.n3.7405511b230b7552"]
    assert values(spark, [D4, D4_PERM], mx.quiver_id)[0] == values(spark, [D4_PERM], mx.quiver_id)[0]
    assert values(spark, [A2, A2], lambda m: mx.mutate(m, 0)) == [[[0, -1], [1, 0]]] * 2
    assert values(spark, [[[0, 1], [1, 0]], A3], mx.is_skew_symmetric) == [False, True]
    assert values(spark, [[[0, 3], [-3, 0]], [[0, 2], [-2, 0]]], mx.is_bounded) == [False, True]
    assert values(spark, [MARKOV, D4, [[0]]], inv.symmetry_name) == ["Z/3", "S_3", "1"]
    assert values(spark, [D4], inv.symmetry_generators) == [[[0, 1, 3, 2], [0, 2, 1, 3]]]
    assert values(spark, [A3, [[0, 2], [-2, 0]], MARKOV], inv.representation_type_native) == ["finite", "tame", None]


@st.composite
def matrices(draw):
    n = draw(st.integers(1, 4))
    upper = {(i, j): draw(st.integers(-3, 3)) for i, j in combinations(range(n), 2)}
    return [[upper.get((i, j), -upper.get((j, i), 0)) for j in range(n)] for i in range(n)]


def brute(m):
    n = len(m)
    perms = [*permutations(range(n))]
    of = lambda p: [[m[i][j] for j in p] for i in p]
    reach = {(i, j) for i in range(n) for j in range(n) if m[i][j] > 0}
    for _ in range(n):
        reach |= {(i, k) for i, j in reach for j2, k in reach if j == j2}
    part = [{i} for i in range(n)]
    for _ in range(n):
        part = [{w for v in p for w in range(n) if m[v][w] or w == v} for p in part]
    det = sum((-1) ** sum(p[i] > p[j] for i, j in combinations(range(n), 2)) * eval("*".join(f"({m[i][p[i]]})" for i in range(n))) for p in perms)
    return min(of(p) for p in perms), all((i, i) not in reach for i in range(n)), part[0] == {*range(n)}, det, sum(of(p) == m for p in perms), [[[m[i][j] for j in sorted(p)] for i in sorted(p)] for i0, p in enumerate(part) if min(p) == i0]


@settings(max_examples=6, deadline=None)
@given(st.lists(matrices(), min_size=20, max_size=30))
def test_against_brute_force(spark, ms):
    m = F.col("m")
    rows = frame(spark, ms).orderBy("i").select(mx.canonical_form(m), mx.is_acyclic(m), mx.is_connected(m), inv.determinant_native(m), inv.symmetry_order(m), mx.connected_components(m)).collect()
    assert [tuple(r) for r in rows] == [brute(x) for x in ms]


def test_mutation_is_an_involution(spark):
    back = values(spark, [A3, D4, MARKOV], lambda m: mx.mutate(mx.mutate(m, 1), 1))
    assert back == [A3, D4, MARKOV]
    for m in (A3, D4, MARKOV):
        for k in range(len(m)):
            assert values(spark, [m], lambda c, k=k: mx.mutate(c, k))[0] == [list(r) for r in ac.mutated(tuple(map(tuple, m)), k)]


def test_larger_matrices_use_exact_integers(spark):
    big = [[0, 9, 0, 0, 7], [-9, 0, 1, 2, 0], [0, -1, 0, 3, 1], [0, -2, -3, 0, 5], [-7, 0, -1, -5, 0]]
    path = [[0, 1, 0, 0, 0], [-1, 0, 1, 0, 0], [0, -1, 0, 1, 0], [0, 0, -1, 0, 1], [0, 0, 0, -1, 0]]
    rows = inv.exact_invariants(frame(spark, [big, path, D4]), "i", "m").orderBy("i").collect()
    assert [tuple(r) for r in rows] == [("0", "0", "wild"), ("1", "0", "finite"), ("2", "0", "finite")]  # odd skew-symmetric
    assert inv.exact_determinant([]) == 1 and inv.exact_determinant([[0, 2], [-2, 0]]) == 4 and inv.exact_determinant([[7]]) == 7
    rng = random.Random(1)
    for n in range(1, 6):
        a = [[rng.randint(-9, 9) for _ in range(n)] for _ in range(n)]
        want = sum((-1) ** sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) * math.prod(a[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert inv.exact_determinant(a) == want
    assert values(spark, [path], mx.quiver_id) == values(spark, [[r[::-1] for r in path[::-1]]], mx.quiver_id)


def test_larger_matrices_in_expressions(spark):
    rng = random.Random(7)
    ms = []
    for n in (5, 5, 5, 6, 6):
        m = [[0] * n for _ in range(n)]
        for i, j in combinations(range(n), 2):
            m[i][j] = rng.choice([0, 0, 1, -1, 2])
            m[j][i] = -m[i][j]
        ms.append(m)
    path = [[(j == i + 1) - (j == i - 1) for j in range(6)] for i in range(6)]
    # a four-valent star is tame, a five-valent one wild, a three-valent one with legs 1, 2, 3 finite
    star = lambda n: [[0] + [1] * n, *[[-1] + [0] * n for _ in range(n)]]
    cycle = [[(j == (i + 1) % 6) - (j == (i - 1) % 6) for j in range(6)] for i in range(6)]
    tree = [[0] * 6 for _ in range(6)]
    for i, j in ((0, 1), (0, 2), (2, 3), (0, 4), (4, 5)):
        tree[i][j], tree[j][i] = 1, -1
    ms += [path, star(4), star(5), cycle, tree, [[0] * 6 for _ in range(6)]]
    det = [inv.exact_determinant(m) for m in ms]
    kinds = [inv.exact_representation_type(m) if ac.acyclic(m) else None for m in ms]
    assert values(spark, ms, inv.determinant_native) == det
    assert values(spark, ms, inv.representation_type_native) == kinds
    assert kinds[5:] == ["finite", "tame", "wild", None, "finite", "finite"]
    smallest, order, top = [], [], []
    for m in ms:
        perms = [*permutations(range(len(m)))]
        of = lambda p, m=m: [[m[i][j] for j in p] for i in p]
        smallest.append(min(map(of, perms)))
        group = [p for p in perms if of(p) == m]
        order.append(len(group))
        top.append(max(map(inv.element_order, group)))
    assert values(spark, ms, mx.canonical_form) == smallest
    assert values(spark, ms, inv.symmetry_order) == order
    assert values(spark, ms, lambda m: F.array_max(F.transform(inv.automorphisms(m), lambda x: x["k"]))) == top
    assert values(spark, [path], mx.quiver_id) == values(spark, [[r[::-1] for r in path[::-1]]], mx.quiver_id)
    assert values(spark, [[], [[0]]], inv.determinant_native) == [1, 0] and values(spark, [[], [[0]]], inv.representation_type_native) == ["finite", "finite"]
    none = spark.range(1).select(F.lit(None).cast("array<array<int>>").alias("m"))
    assert [*none.select(*[of(F.col("m")) for of in (inv.determinant_native, inv.is_positive_definite, inv.representation_type_native, mx.canonical_form)]).collect()[0]] == [None] * 4
    general = [[[rng.randint(-5, 5) for _ in range(n)] for _ in range(n)] for n in (5, 6, 7)]
    assert values(spark, general, inv.determinant_native) == [inv.exact_determinant(a) for a in general]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_subgroups(n):
    assert len(inv.subgroups(n)) == {1: 1, 2: 2, 3: 6, 4: 30}[n]
    for g in inv.subgroups(n):
        assert inv._closure([tuple(x) for x in inv.generating_set([*g])], n) == g
