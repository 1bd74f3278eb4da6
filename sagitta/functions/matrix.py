"""Exchange matrices as ``array<array<int>>`` columns: skew-symmetric, ``b_ij > 0`` for so many arrows from i to j.

All functions are built-in expressions. Those that go over relabelings have their permutations in the plan for up to
MAX_RELABELED vertices and make them for each row beyond that, which is factorial work: eight vertices are 40,320.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RELABELED = 5


def _literal(value, kind: str) -> Column:
    """A constant that is folded into the plan once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def by_size(m: Column, of, most: int = MAX_RELABELED) -> Column:
    """``of(n)`` for the matrix's number of vertices n, null beyond ``most``."""
    out = F.when(F.size(m) == 1, of(1))
    for n in range(2, most + 1):
        out = out.when(F.size(m) == n, of(n))
    return out


def permutation_list(n: int) -> list[list[int]]:
    return [[*p] for p in permutations(range(n))]


def all_permutations(m: Column) -> Column:
    """Those of any number of vertices, made by inserting each vertex at every place of the permutations of those before."""
    inserted = lambda p, v: F.transform(F.sequence(F.lit(0), F.size(p)), lambda at: F.concat(F.slice(p, F.lit(1), at), F.array(v), F.slice(p, at + 1, F.size(p) - at)))
    return F.aggregate(vertices(m), F.array(F.array().cast("array<int>")), lambda ps, v: F.flatten(F.transform(ps, lambda p: inserted(p, v))))


def vertices(m: Column) -> Column:
    return F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))


def entry(m: Column, i, j) -> Column:
    return F.get(F.get(m, i), j)


def is_skew_symmetric(m: Column) -> Column:
    return F.forall(vertices(m), lambda i: F.forall(vertices(m), lambda j: entry(m, i, j) == -entry(m, j, i)))


def max_edge(m: Column) -> Column:
    return F.array_max(F.transform(F.flatten(m), F.abs))


def is_bounded(m: Column, bound: int = 2) -> Column:
    return max_edge(m) <= bound


def is_connected(m: Column) -> Column:
    """By growing what vertex 0 reaches, one step for each vertex; one vertex is connected."""
    grown = lambda got: F.filter(vertices(m), lambda v: F.array_contains(got, v) | F.exists(got, lambda r: entry(m, r, v) != 0))
    return F.size(F.aggregate(vertices(m), F.array(F.lit(0)), lambda got, _: grown(got))) >= F.size(m)


def is_acyclic(m: Column) -> Column:
    """No vertex is left when those without arrows to what is left are taken away, once for each vertex."""
    return F.size(F.aggregate(vertices(m), vertices(m), lambda left, _: F.filter(left, lambda v: F.exists(left, lambda w: entry(m, v, w) > 0)))) == 0


def mutate(m: Column, k) -> Column:
    """Mutation at vertex ``k``: its row and column change sign; every path through it adds an arrow."""
    k = F.lit(k) if isinstance(k, int) else k

    def through(b_ik, b_kj):
        return F.abs(b_ik) * b_kj + b_ik * F.abs(b_kj)

    return F.transform(m, lambda row, i: F.transform(row, lambda b, j: F.when((i == k) | (j == k), -b).otherwise(b + F.shiftright(through(F.get(row, k), entry(m, k, j)), 1))))


def relabel(m: Column, p: Column) -> Column:
    """Entry (i, j) of the result is entry (p_i, p_j). With part of the vertices: an induced subquiver."""
    return F.transform(p, lambda i: F.transform(p, lambda j: entry(m, i, j)))


def canonical_form(m: Column) -> Column:
    """The smallest of all relabelings, row by row; beyond MAX_RELABELED vertices one is held at a time."""
    smallest = F.aggregate(all_permutations(m), m, lambda best, p: F.least(best, relabel(m, p)))
    few = by_size(m, lambda n: F.array_min(F.transform(_literal(permutation_list(n), "array<array<int>>"), lambda p: relabel(m, p))))
    return F.when(F.size(m) == 0, m).when(F.size(m) > MAX_RELABELED, smallest).otherwise(few)


def canonical_permutation(m: Column) -> Column:
    """The first permutation, in lexicographic order, that takes the matrix to its canonical form."""
    made = lambda p: F.struct(relabel(m, p).alias("m"), p.alias("p"))
    few = by_size(m, lambda n: F.array_min(F.transform(_literal(permutation_list(n), "array<array<int>>"), made)))
    return F.when(F.size(m) > MAX_RELABELED, F.array_min(F.transform(all_permutations(m), made))).otherwise(few)["p"]


def certificate(m: Column) -> Column:
    """SHA-256 of the canonical form's compact JSON, as bytes."""
    return F.unhex(F.sha2(F.to_json(canonical_form(m)), 256))


def _id(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{prefix}.n"), F.size(canonical).cast("string"), F.lit("."), F.substring(F.sha2(F.to_json(canonical), 256), 1, 16))


def quiver_id(m: Column) -> Column:
    return _id("Q", canonical_form(m))


def quiver_id_of_canonical(canonical: Column) -> Column:
    return _id("Q", canonical)


def mutation_class_id(canonical_rep: Column) -> Column:
    return _id("MC", canonical_rep)


def are_isomorphic(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (canonical_form(a) == canonical_form(b))


def is_bipartite(m: Column) -> Column:
    """Every vertex is a source or a sink."""
    return F.forall(m, lambda row: ~(F.exists(row, lambda b: b > 0) & F.exists(row, lambda b: b < 0)))


def is_abundant(m: Column) -> Column:
    """At least two arrows between any two vertices."""
    return (F.size(m) >= 2) & F.forall(vertices(m), lambda i: F.forall(vertices(m), lambda j: (i == j) | (F.abs(entry(m, i, j)) >= 2)))


def is_planar(m: Column) -> Column:
    """Known up to four vertices only."""
    return F.when(F.size(m) <= 4, F.lit(True))


def sources(m: Column) -> Column:
    return F.filter(vertices(m), lambda k: F.forall(F.get(m, k), lambda b: b >= 0))


def delete_vertex(m: Column, k) -> Column:
    return relabel(m, F.filter(vertices(m), lambda v: v != k))


def connected_components(m: Column) -> Column:
    """The submatrices of the connected parts, ordered by their smallest vertex."""
    nearer = lambda label: F.transform(vertices(m), lambda v: F.array_min(F.transform(F.filter(vertices(m), lambda w: (w == v) | (entry(m, v, w) != 0)), lambda w: F.get(label, w))))
    label = F.aggregate(vertices(m), vertices(m), lambda label, _: nearer(label))
    return F.transform(F.array_sort(F.array_distinct(label)), lambda c: relabel(m, F.filter(vertices(m), lambda v: F.get(label, v) == c)))


def compose(p: Column, q: Column) -> Column:
    return F.transform(q, lambda i: F.get(p, i))


def matrix_json(m: Column) -> Column:
    return F.to_json(m)


def matrix_from_json(s: Column) -> Column:
    return F.from_json(s, "array<array<int>>")
