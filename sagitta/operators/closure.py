"""Closure of given quivers under bounded mutation, from whatever table they come.

Quivers are ``(n, code)``, as in ``generate``. The frontier holds canonical codes of all seeds at once, so work doesn't depend on
how many seeds share a quiver or a class. Mutation undoes itself, so a layer's neighbours lie in the layers around it: new ones are
those that the last two rounds haven't expanded, and no round reads all that was visited. Labeled orbits are made once for each
class, from its representative; a seed's own orbit is that one relabeled, by the permutation that takes a member onto the seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .components import connected_components

#: Codes of eight vertices don't fit 63 bits at bound 2; those of seven are exact in floating point, too.
MAX_PACKED = 7
#: Steps that a task takes from its part of the frontier in one round.
LEVELS = 4
#: Bits of a code in a node's number; the vertices stand above.
CODE_BITS = 58


def check_size(n: int, bound: int) -> None:
    if not 1 <= n <= MAX_PACKED or (2 * bound + 1) ** (n * (n - 1) // 2) >= 1 << 53:
        raise ValueError(f"codes of {n} vertices with entries to {bound} are too large")


class Kernel:
    """Arrays of codes of matrices of ``n`` vertices."""

    def __init__(self, n: int, bound: int):
        check_size(n, bound)
        self.n, self.bound, self.base = n, bound, 2 * bound + 1
        self.rows, self.columns = np.triu_indices(n, 1)
        self.weights = self.base ** np.arange(len(self.rows) - 1, -1, -1, dtype=np.int64)
        self.perms = np.array([*permutations(range(n))], np.int64).reshape(-1, n)
        number = np.zeros((n, n), np.int64)
        number[self.rows, self.columns] = number[self.columns, self.rows] = np.arange(len(self.rows))
        #: a relabeled code is linear in the entries: what each entry adds, for each permutation
        self.places = np.zeros((len(self.rows), len(self.perms)))
        for i, j, w in zip(self.rows, self.columns, self.weights):
            a, b = self.perms[:, i], self.perms[:, j]
            np.add.at(self.places, (number[a, b], np.arange(len(self.perms))), np.where(a < b, w, -w))

    def matrices(self, codes: np.ndarray) -> np.ndarray:
        entries = codes[:, None] // self.weights % self.base - self.bound
        m = np.zeros((len(codes), self.n, self.n), np.int64)
        m[:, self.rows, self.columns] = entries
        return m - m.transpose(0, 2, 1)

    def codes(self, m: np.ndarray) -> np.ndarray:
        return ((m[:, self.rows, self.columns] + self.bound) * self.weights).sum(1)

    def canonical(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest codes of all relabelings, and the number of the first permutation that leads there."""
        out, which = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        for a in range(0, len(codes), size := max(1, 4_000_000 // len(self.perms))):
            entries = codes[a : a + size, None] // self.weights % self.base - self.bound
            all_codes = entries.astype(np.float64) @ self.places
            which[a : a + size] = all_codes.argmin(1)
            out[a : a + size] = all_codes.min(1).astype(np.int64) + self.bound * self.weights.sum()
        return out, which

    def mutated(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes after mutation at vertex ``k``, and whether they stay within the bound."""
        m = self.matrices(codes)
        x, y = m[:, :, k, None], m[:, None, k, :]
        new = m + (np.abs(x) * y + x * np.abs(y)) // 2
        new[:, k, :], new[:, :, k] = -m[:, k, :], -m[:, :, k]
        stays = (np.abs(new) <= self.bound).all((1, 2))
        new[~stays] = 0
        return self.codes(new), stays


@cache
def kernel(n: int, bound: int) -> Kernel:
    return Kernel(n, bound)


def coded(m: Column, bound: int = 2) -> Column:
    """The code of a matrix of any size that fits."""
    upper = F.flatten(F.transform(m, lambda row, i: F.slice(row, i + 2, F.size(m))))
    return F.aggregate(upper, F.lit(0).cast("long"), lambda t, x: t * (2 * bound + 1) + x + bound)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    n, code = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        yield int(size), at, code[at]


def canonical_codes(rows: DataFrame, bound: int = 2) -> DataFrame:
    """``n, code, ccode, perm`` of ``rows(n, code)``: the canonical code and the number, in lexicographic order, of the permutation to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, which = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for n, at, codes in _by_size(b):
                c[at], which[at] = kernel(n, bound).canonical(codes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c), pa.array(which.astype(np.int32))], names=["n", "code", "ccode", "perm"])

    return rows.select(F.col("n").cast("int"), F.col("code").cast("long")).mapInArrow(run, "n int, code long, ccode long, perm int")


def _expanded(frontier: DataFrame, bound: int, canonical: bool, levels: int) -> DataFrame:
    """``n, code, k, dst`` of what lies less than ``levels`` steps from ``frontier(n, code)``: the code (canonical, or as it is) after each mutation, null where
    it leaves the bound."""

    def of(n: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        kern, seen = kernel(n, bound), np.unique(codes)
        layer, out = seen, []
        for _ in range(levels):
            near = []
            for k in range(n):
                dst, stays = kern.mutated(layer, k)
                if canonical and stays.any():
                    dst[stays] = kern.canonical(dst[stays])[0]
                out.append((layer, np.full(len(layer), k), dst, stays))
                near.append(dst[stays])
            layer = np.setdiff1d(np.concatenate(near), seen)
            if not len(layer):
                break
            seen = np.union1d(seen, layer)
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, _, codes in _by_size(b):
                code, k, dst, stays = of(n, codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), n, np.int32)), pa.array(code), pa.array(k.astype(np.int32)), pa.array(dst, mask=~stays)], names=["n", "code", "k", "dst"])

    return frontier.select("n", "code").mapInArrow(run, "n int, code long, k int, dst long")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def steps_from(start: DataFrame, bound: int = 2, canonical: bool = True, levels: int = LEVELS) -> DataFrame:
    """``n, code, k, dst``: every mutation of all that is reached from ``start(n, code)`` within the bound."""
    frontier = written(start.select(F.col("n").cast("int"), F.col("code").cast("long")).distinct())
    rounds: list[DataFrame] = []
    before: list[DataFrame] = []
    while frontier.limit(1).count():
        made = written(_expanded(frontier, bound, canonical, levels).distinct())
        known = _union([x.select("n", "code").distinct() for x in [*before, made]])
        rounds.append(made)
        before = [made]
        # what this round didn't expand is `levels` steps ahead of the frontier, or behind it, where the round before expanded it
        frontier = written(made.where("dst is not null").select("n", F.col("dst").alias("code")).distinct().join(known, ["n", "code"], "left_anti"))
        if len(rounds) > 8:  # keep the plan short
            rounds = [written(_union(rounds).distinct())]
    return _union(rounds).distinct() if rounds else _expanded(frontier, bound, canonical, levels)


def node(code: str = "code") -> Column:
    """Number and code as one number, ordered by both."""
    return F.shiftleft(F.col("n").cast("long"), CODE_BITS) + F.col(code)


@dataclass(frozen=True)
class Closure:
    """``quivers(n, code, class_code)``: canonical codes reached and the least of their class;
    ``labeled(n, code, ccode, perm, class_code, is_boundary)``: the labeled orbit of each class's least."""

    quivers: DataFrame
    labeled: DataFrame
    bound: int


def classes_of(start: DataFrame, bound: int = 2) -> DataFrame:
    """``n, code, class_code`` of all quivers reached from the canonical codes ``start(n, code)``, written."""
    steps = written(steps_from(start, bound))
    nodes = steps.select(node().alias("node")).distinct()
    roots = connected_components(nodes, steps.where("dst is not null").select(node().alias("src"), node("dst").alias("dst")))
    low = (1 << CODE_BITS) - 1
    return written(roots.select(F.shiftright("node", CODE_BITS).cast("int").alias("n"), F.col("node").bitwiseAND(low).alias("code"), F.col("root").bitwiseAND(low).alias("class_code")))


def closure(start: DataFrame, bound: int = 2) -> Closure:
    """Of the canonical codes ``start(n, code)``: all quivers reached within the bound, their classes and the classes' labeled orbits."""
    quivers = classes_of(start, bound)
    steps = written(steps_from(quivers.where("code = class_code"), bound, canonical=False))
    members = steps.groupBy("n", "code").agg(F.bool_or(F.col("dst").isNull()).alias("is_boundary"))
    named = canonical_codes(members.select("n", "code"), bound).join(members, ["n", "code"])
    labeled = named.join(quivers.select("n", F.col("code").alias("ccode"), "class_code"), ["n", "ccode"])
    return Closure(quivers, written(labeled.select("n", "code", "ccode", "perm", "class_code", "is_boundary")), bound)


def relabelings(seeds: DataFrame, c: Closure) -> DataFrame:
    """``n, code, class_code, by`` of ``seeds(n, code, ccode, perm)``: the permutation that takes the class's labeled orbit onto the seed's own.

    A member m with the seed's canonical form is taken there by its permutation p; the seed s by q. So p, then the inverse of q, takes m to s.
    A seed that is a member itself stays as it is, so all seeds of one labeled orbit that holds the representative share it."""
    member = c.labeled.groupBy("n", "ccode").agg(F.min(F.struct("code", "perm", "class_code")).alias("m")).select("n", "ccode", F.col("m.perm").alias("p"), F.col("m.class_code").alias("class_code"))
    itself = c.labeled.select("n", "code", F.col("perm").alias("own"))
    both = seeds.select("n", "code", "ccode", F.col("perm").alias("q")).join(member, ["n", "ccode"]).join(itself, ["n", "code"], "left").withColumn("p", F.coalesce("own", "p"))
    bound = c.bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = []
            for n, p, q in zip(*(b.column(k).to_pylist() for k in (0, 3, 4))):
                perms = kernel(n, bound).perms
                by.append(perms[p][np.argsort(perms[q])].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(by, pa.list_(pa.int32()))], names=["n", "code", "class_code", "by"])

    return both.select("n", "code", "class_code", "p", "q").mapInArrow(run, "n int, code long, class_code long, by array<int>")
