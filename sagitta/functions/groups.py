"""Canonical forms and symmetry groups of matrices of any size, by refinement and stabiliser chains.

The least relabeling is searched row by row. Vertices not yet placed stand in ordered cells: the first row is least for a vertex whose
sorted entries are least, and with it the others fall into cells by their entries; the next vertex comes from the first cell, and its
entries refine the cells again. Only the least rows go on, and of vertices that may change places one does for all.

A symmetry group is held as a chain of stabilisers of the vertices 0, 1, 2, ...: for each vertex its orbit under what fixes those before,
with a permutation for each member. Orders are products of orbit lengths, so no group is ever listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import canonical_form

Permutation = tuple[int, ...]


def _twins(m, u: int, v: int) -> bool:
    """Whether the two may change places and nothing changes."""
    return m[u][v] == 0 and all(m[u][w] == m[v][w] for w in range(len(m)))


def least_relabeling(m) -> tuple[list[list[int]], Permutation]:
    """The least of all relabelings of a skew-symmetric matrix, row by row, and a permutation that makes it."""
    n = len(m)
    # each state: the vertices placed so far, and the cells of the others, in order
    states: list[tuple[Permutation, tuple[Permutation, ...]]] = [((), (tuple(range(n)),))]
    for _ in range(n):
        best, after = None, []
        for placed, cells in states:
            tried: list[int] = []
            for v in cells[0]:
                if any(_twins(m, v, u) for u in tried):
                    continue
                tried.append(v)
                row, left = [m[v][p] for p in placed] + [0], []
                for cell in cells:
                    entries: dict[int, list[int]] = {}
                    for w in cell:
                        if w != v:
                            entries.setdefault(m[v][w], []).append(w)
                    for x in sorted(entries):
                        row += [x] * len(entries[x])
                        left.append(tuple(entries[x]))
                if best is None or row < best:
                    best, after = row, []
                if row == best:
                    after.append(((*placed, v), tuple(left)))
        states = after
    p = states[0][0]
    return [[m[i][j] for j in p] for i in p], p


def compose(p: Permutation, q: Permutation) -> Permutation:
    return tuple(p[i] for i in q)


def inverse(p: Permutation) -> Permutation:
    return tuple(sorted(range(len(p)), key=p.__getitem__))


def order_of(p: Permutation) -> int:
    """The least number that all cycles' lengths divide."""
    seen, out = set(), 1
    for i in range(len(p)):
        k = 0
        while i not in seen:
            seen.add(i)
            i, k = p[i], k + 1
        out = math.lcm(out, max(k, 1))
    return out


class Chain:
    """A group of permutations of ``n`` things: ``across[i][j]`` fixes 0 to i - 1 and takes i to j."""

    def __init__(self, n: int, generators: Iterable[Permutation] = ()):
        self.n = n
        self.across: list[dict[int, Permutation]] = [{i: tuple(range(n))} for i in range(n)]
        self.strong: list[Permutation] = []
        for g in generators:
            self.add(g)

    @property
    def order(self) -> int:
        return math.prod(map(len, self.across))

    def sifted(self, g: Permutation) -> Permutation:
        """What is left of ``g`` when the chain has taken what it can: nothing but the unit for its members."""
        for i in range(self.n):
            if g[i] not in self.across[i]:
                break
            g = compose(inverse(self.across[i][g[i]]), g)
        return g

    def __contains__(self, g: Permutation) -> bool:
        return self.sifted(g) == tuple(range(self.n))

    def add(self, g: Permutation) -> None:
        """Takes in a generator. By Schreier's lemma the chain is whole when each product across an orbit sifts to the unit."""
        todo = [g]
        while todo:
            g = self.sifted(todo.pop())
            if g == tuple(range(self.n)):
                continue
            self.strong.append(g)
            for i in range(self.n - 1, -1, -1):
                fixing = [s for s in self.strong if all(s[k] == k for k in range(i))]
                orbit = [*self.across[i]]
                for at in orbit:
                    for s in fixing:
                        if s[at] not in self.across[i]:
                            self.across[i][s[at]] = compose(s, self.across[i][at])
                            orbit.append(s[at])
            for i in range(self.n):
                fixing = [s for s in self.strong if all(s[k] == k for k in range(i))]
                for at, t in self.across[i].items():
                    for s in fixing:
                        back = compose(inverse(self.across[i][s[at]]), compose(s, t))
                        if back not in self:
                            todo.append(back)

    def least_outside(self, part: Chain) -> Permutation:
        """The first element in lexicographic order that the subgroup ``part`` lacks.

        Elements that fix more vertices come first. Where both have the same stabilisers from i + 1 on, an element that takes i where
        ``part`` does is in ``part``; so it takes i to the least vertex that ``part`` can't, and the next ones as low as that allows."""
        i = max(k for k in range(self.n) if len(self.across[k]) > len(part.across[k]))
        g = self.across[i][min(j for j in self.across[i] if j not in part.across[i])]
        for k in range(i + 1, self.n):
            g = compose(g, self.across[k][min(self.across[k], key=g.__getitem__)])
        return g


def automorphisms(m) -> Chain:
    """The chain of all relabelings that leave the matrix as it is."""
    n = len(m)
    kinds = [tuple(sorted(row)) for row in m]

    def extended(image: list[int], used: set[int]) -> Permutation | None:
        k = len(image)
        if k == n:
            return tuple(image)
        for v in range(n):
            if v not in used and kinds[v] == kinds[k] and all(m[v][image[i]] == m[k][i] for i in range(k)):
                if (found := extended([*image, v], used | {v})) is not None:
                    return found
        return None

    out = Chain(n)
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n):
            fixed = [*range(i)]
            if j not in out.across[i] and kinds[i] == kinds[j] and all(m[j][k] == m[i][k] for k in fixed):
                if (g := extended([*fixed, j], {*fixed, j})) is not None:
                    out.add(g)
    return out


def greedy_generators(group: Chain) -> list[Permutation]:
    """In lexicographic order, each element that those before it don't generate."""
    out: list[Permutation] = []
    part = Chain(group.n)
    while part.order < group.order:
        out.append(group.least_outside(part))
        part.add(out[-1])
    return out


def is_commutative(generators: list[Permutation]) -> bool:
    return all(compose(p, q) == compose(q, p) for p in generators for q in generators)


#: What groups of some orders are called if they don't commute, and the one of order 4 that isn't cyclic.
NAMES = {6: "S_3", 8: "D_4", 12: "A_4", 24: "S_4"}
FOUR = "Z/2 x Z/2"


def group_name(order: int, generators: list[Permutation]) -> str:
    if order == 1:
        return "1"
    if is_commutative(generators):
        # the least number that all elements' orders divide is that of an element
        return f"Z/{order}" if math.lcm(*map(order_of, generators)) == order else FOUR if order == 4 else f"order {order}"
    return NAMES.get(order, f"order {order}")


def _lists(column) -> Iterator[list[list[int]] | None]:
    return iter(column.to_pylist())


def canonical_forms(matrices: DataFrame, key: str, m: str = "matrix") -> DataFrame:
    """``key`` and ``canonical``, the least relabeling, for matrices of any size; null for a null matrix."""
    kind, name = matrices.schema[key].dataType.simpleString(), key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if q is None else least_relabeling(q)[0] for q in _lists(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=[name, "canonical"])

    return matrices.select(key, F.col(m).alias("m")).mapInArrow(run, f"`{key}` {kind}, canonical array<array<int>>")


def symmetry_groups(matrices: DataFrame, key: str, m: str = "matrix") -> DataFrame:
    """``key, order, name, generators`` of the symmetry groups of matrices of any size; null for a null matrix."""
    kind, name = matrices.schema[key].dataType.simpleString(), key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for q in _lists(b.column(1)):
                group = None if q is None else automorphisms(q)
                found = [] if group is None else greedy_generators(group)
                out[0].append(None if group is None else str(group.order))
                out[1].append(None if group is None else group_name(group.order, found))
                out[2].append(None if group is None else [[*p] for p in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.list_(pa.int32())))], names=[name, "order", "name", "generators"])

    return matrices.select(key, F.col(m).alias("m")).mapInArrow(run, f"`{key}` {kind}, order string, name string, generators array<array<int>>")


def verified(matrices: DataFrame, key: str, m: str = "matrix") -> DataFrame:
    """``key, canonical, agree``: the canonical form, and whether the least of all relabelings written out is the same."""
    both = matrices.select(key, canonical_form(F.col(m)).alias("tried")).join(canonical_forms(matrices, key, m), key)
    return both.select(key, "canonical", F.col("canonical").eqNullSafe(F.col("tried")).alias("agree"))
