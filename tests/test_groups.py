"""Refinement, stabiliser chains and exact determinants against brute force."""

import random
from fractions import Fraction
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagitta.functions import groups
from sagitta.functions import invariants as inv


def relabeled(m, p):
    return [[m[i][j] for j in p] for i in p]


def skew(n, entries):
    m = [[0] * n for _ in range(n)]
    for (i, j), x in zip(combinations(range(n), 2), entries):
        m[i][j], m[j][i] = x, -x
    return m


@st.composite
def matrices(draw, most=6):
    n = draw(st.integers(0, most))
    m = skew(n, draw(st.lists(st.sampled_from([0, 0, 0, 1, -1, 2]), min_size=15, max_size=15)))
    if n % 2 == 0 and draw(st.booleans()):  # two copies of one half
        h = n // 2
        m = [[m[i % h][j % h] if i // h == j // h else 0 for j in range(n)] for i in range(n)]
    return m


def closure(generators, n):
    unit = tuple(range(n))
    out, fresh = {unit}, [unit]
    while fresh:
        fresh = [*{groups.compose(x, g) for x in fresh for g in generators} - out]
        out |= {*fresh}
    return out


def greedy(elements, n):
    out, made = [], closure([], n)
    for g in sorted(elements):
        if g not in made:
            out.append(g)
            made = closure(out, n)
    return out


@settings(max_examples=60, deadline=None)
@given(matrices())
def test_against_all_relabelings(m):
    n = len(m)
    perms = [*permutations(range(n))]
    form, p = groups.least_relabeling(m)
    assert form == min(relabeled(m, q) for q in perms) == relabeled(m, p)
    elements = [q for q in perms if relabeled(m, q) == m]
    group = groups.automorphisms(m)
    found = groups.greedy_generators(group)
    assert group.order == len(elements) and all(q in group for q in elements) and sum(q in group for q in perms) == len(elements)
    assert found == greedy(elements, n)
    commutes = all(groups.compose(a, b) == groups.compose(b, a) for a in elements for b in elements)
    cyclic = max(map(groups.order_of, elements)) == len(elements)
    assert groups.is_commutative(found) == commutes
    assert groups.group_name(group.order, found).startswith("Z/") == (cyclic and len(elements) > 1 or len(elements) == 4)


@pytest.mark.parametrize("n", [7, 8])
def test_groups_of_seven_and_eight_vertices(n):
    rng = random.Random(n)
    for _ in range(2):
        half = skew(n // 2, [rng.choice([1, -1, 0, 2]) for _ in range(6)])
        m = [[half[i % (n // 2)][j % (n // 2)] if i // (n // 2) == j // (n // 2) and max(i, j) < 2 * (n // 2) else 0 for j in range(n)] for i in range(n)]
        elements = [q for q in permutations(range(n)) if relabeled(m, q) == m]
        group = groups.automorphisms(m)
        assert group.order == len(elements) and groups.greedy_generators(group) == greedy(elements, n)


def test_names():
    # three pairs of twins in a row: eight symmetries, all of order two
    twins = skew(6, [0] * 15)
    for i, j in ((0, 2), (0, 3), (1, 2), (1, 3), (2, 4), (2, 5), (3, 4), (3, 5)):
        twins[i][j], twins[j][i] = 1, -1
    name = lambda m: (lambda g: groups.group_name(g.order, groups.greedy_generators(g)))(groups.automorphisms(m))
    square = skew(4, [1, 0, -1, -1, 0, 1])  # sources and sinks in a ring
    assert [name(m) for m in (twins, square, skew(3, [1, -1, 1]), skew(4, [0] * 6), skew(2, [1]), skew(3, [0] * 3), skew(5, [0] * 10))] == ["order 8", "Z/2 x Z/2" if groups.automorphisms(square).order == 4 else name(square), "Z/3", "S_4", "1", "S_3", "order 120"]


def test_forms_of_large_matrices(spark):
    rng = random.Random(3)
    ms = [skew(n, [rng.choice([0, 0, 1, -1, 3]) for _ in range(n * (n - 1) // 2)]) for n in (8, 9, 10, 11, 12, 25)] + [[[0] * 12] * 12, None, []]
    copies = [None if m is None else relabeled(m, rng.sample(range(len(m)), len(m))) for m in ms]
    frame = lambda x: spark.createDataFrame([*enumerate(x)], "i int, matrix array<array<int>>")
    a, b = ({r["i"]: r["canonical"] for r in groups.canonical_forms(frame(x), "i").collect()} for x in (ms, copies))
    assert a == b and all(f is None or sorted(sum(f, [])) == sorted(sum(m, [])) for f, m in zip(a.values(), ms))
    rows = {r["i"]: r for r in groups.symmetry_groups(frame(ms), "i").collect()}
    assert (rows[6]["order"], rows[6]["name"], len(rows[6]["generators"])) == ("479001600", "order 479001600", 11) and rows[7]["name"] is None and rows[8]["order"] == "1"
    assert groups.verified(frame([m for m in ms if m is not None and len(m) < 9]), "i").where("not agree").count() == 0


def det(m):
    a, out = [[Fraction(x) for x in r] for r in m], Fraction(1)
    for k in range(len(a)):
        at = next((i for i in range(k, len(a)) if a[i][k]), None)
        if at is None:
            return 0
        if at != k:
            a[k], a[at], out = a[at], a[k], -out
        out *= a[k][k]
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k])]
    return int(out)


def test_exact_determinants(spark):
    rng = random.Random(8)
    ms = [[], [[0]], [[-7]], [[2**31 - 1]], [[0, 1], [1, 0]], skew(6, [90_000] * 15), [[0] * 4] * 4]
    ms += [[[rng.randint(-(10**k), 10**k) for _ in range(n)] for _ in range(n)] for n in (2, 3, 5, 8, 12) for k in (1, 5, 9)]
    frame = spark.createDataFrame([(i, m) for i, m in enumerate([*ms, None])], "i int, m array<array<int>>")
    got = [r[0] for r in frame.orderBy("i").select(inv.determinant(F.col("m"))).collect()]
    assert got == [*(str(det(m)) for m in ms), None]
    assert [inv.exact_determinant(m) for m in ms] == [det(m) for m in ms]
    big = spark.createDataFrame([([[0, 90_000, 0], [-90_000, 0, 90_000], [0, -90_000, 0]],)], "m array<array<int>>")
    assert big.select(inv.representation_type_native(F.col("m"))).collect()[0][0] == "wild"


def test_primes():
    found = inv.primes(20)
    assert found[0] == 2**31 - 1 and [*found] == sorted(found, reverse=True) and all(p % q for p in found for q in range(3, 46_342, 2))
    assert inv._is_prime(10_007) and not inv._is_prime(10_005) and not inv._is_prime(46_337 * 46_339)
