"""Mutation-acyclicity, and searched local-acyclicity conditions with three states."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as mx
from ..sources.storage import written
from .generate import Generation, decoded

#: Budgets of the searches: steps from the start, seconds, largest entry.
CLOSED = {"max_depth": 64, "timeout": 15.0, "cap": 8}
OPEN = {"max_depth": 8, "timeout": 3.0, "cap": 8}
DIRECT = {"max_depth": 64, "timeout": 60.0, "cap": 32}
#: In place of seconds, so that no state hangs on the clock; the longest search of a class up to four vertices takes 970.
COUNTED = {"timeout": None, "max_nodes": 1_000_000}
CONDITIONS = ("banff", "louise", "p_prime")

#: The deletions that must meet a condition again: of a source (k), of a neighbour of it (j), of both.
DELETIONS = {"p_prime": ("k",), "banff": ("k", "j"), "louise": ("k", "j", "kj")}

Matrix = tuple[tuple[int, ...], ...]


def base_state(g: Generation) -> DataFrame:
    """``mc_id, n, base``: true if a member is acyclic, else false for a closed class, else null."""
    members = decoded(g.quivers, g.bound, g.max_vertices).select("mc_id", "n", mx.is_acyclic(F.col("matrix")).alias("acyclic"))
    found = members.groupBy("mc_id", "n").agg(F.bool_or("acyclic").alias("some"))
    return found.join(g.classes.select("mc_id", "is_open"), "mc_id").select("mc_id", "n", F.when(F.col("some"), True).when(~F.col("is_open"), False).alias("base"))


def resolved_state(g: Generation) -> DataFrame:
    """``mc_id, n, base, resolved``: a class of four vertices or more whose state is null gets false if a vertex deleted from
    a member leaves a quiver whose class is known to be false. Deleting lowers the rank by one, so each rank is one join."""
    base = written(base_state(g))
    done = base.where("n < 4").withColumn("resolved", F.col("base"))
    for n in range(4, g.max_vertices + 1):
        known_false = g.quivers.join(done.where((F.col("n") == n - 1) & ~F.col("resolved")).select("mc_id"), "mc_id", "left_semi").select("qid")
        open_ones = decoded(g.quivers.where(F.col("n") == n).join(base.where("base is null").select("mc_id"), "mc_id", "left_semi"), g.bound, g.max_vertices)
        below = open_ones.select("mc_id", F.explode(F.transform(mx.vertices(F.col("matrix")), lambda k: mx.delete_vertex(F.col("matrix"), k))).alias("m")).select("mc_id", mx.quiver_id(F.col("m")).alias("qid"))
        hit = below.join(known_false, "qid", "left_semi").select("mc_id").distinct().withColumn("hit", F.lit(True))
        done = done.unionByName(base.where(F.col("n") == n).join(hit, "mc_id", "left").select("mc_id", "n", "base", F.coalesce("base", F.when(F.col("hit"), F.lit(False))).alias("resolved")))
    return done


# --- bounded search: semidecidable, so it runs in Python, one class at a time on the executors ---


class OutOfBudget(Exception):
    pass


@dataclass
class Budget:
    """Steps, entries and seconds; ``nodes`` counts expanded quivers, so that a limit can be set that doesn't depend on the clock."""

    max_depth: int = 64
    timeout: float | None = 60.0
    cap: int = 32
    max_nodes: int | None = None
    nodes: int = 0
    truncated: bool = False
    began: float = field(default_factory=time.monotonic)

    def spend(self) -> None:
        self.nodes += 1
        if self.timeout is not None and time.monotonic() - self.began > self.timeout or self.max_nodes is not None and self.nodes > self.max_nodes:
            self.truncated = True
            raise OutOfBudget


def mutated(q: Matrix, k: int) -> Matrix:
    column = [row[k] for row in q]

    def through(x: int, y: int) -> int:
        return abs(x) * y if x * y > 0 else 0

    return tuple(tuple(-b if k in (i, j) else b + through(column[i], q[k][j]) for j, b in enumerate(row)) for i, row in enumerate(q))


def without(q: Matrix, *gone: int) -> Matrix:
    left = [i for i in range(len(q)) if i not in gone]
    return tuple(tuple(q[i][j] for j in left) for i in left)


def acyclic(q: Matrix) -> bool:
    left = {*range(len(q))}
    while ends := {v for v in left if all(q[v][w] <= 0 for w in left)}:
        left -= ends
    return not left


class Search:
    """Whether a quiver is mutation-equivalent to one that meets a condition; sub-results are kept with their truncation."""

    def __init__(self, kind: str, budget: Budget):
        self.kind, self.budget = kind, budget
        self.known: dict[Matrix, tuple[dict | None, bool]] = {}

    def reached(self, q: Matrix) -> Iterator[tuple[Matrix, list[int]]]:
        """The quivers met breadth first, q itself first, with the mutations that lead there; neighbours by vertex."""
        seen, layer, depth = {q}, [(q, [])], 0
        yield q, []
        while layer:
            after = []
            for at, path in layer:
                self.budget.spend()
                if depth >= self.budget.max_depth:
                    self.budget.truncated = True
                    continue
                for k in range(len(at)):
                    to = mutated(at, k)
                    if max((abs(b) for row in to for b in row), default=0) > self.budget.cap:
                        self.budget.truncated = True
                    elif to not in seen:
                        seen.add(to)
                        after.append((to, [*path, k]))
                        yield after[-1]
            layer, depth = after, depth + 1

    def witness(self, q: Matrix) -> dict | None:
        if q not in self.known:
            before, self.budget.truncated = self.budget.truncated, False
            found = next(({"mutations": p, "condition": "acyclic"} for x, p in self.reached(q) if acyclic(x)), None)
            if found is None:
                found = next(({"mutations": p, "condition": c} for x, p in self.reached(q) if (c := self.condition(x)) is not None), None)
            self.known[q] = found, self.budget.truncated
            self.budget.truncated |= before
        found, truncated = self.known[q]
        self.budget.truncated |= truncated
        return found

    def condition(self, q: Matrix) -> dict | str | None:
        """What of ``q`` itself meets the condition: acyclic, or a source (with a neighbour) whose DELETIONS all have a witness."""
        if acyclic(q):
            return "acyclic"
        parts = DELETIONS[self.kind]
        for k in (k for k in range(len(q)) if min(q[k]) >= 0):
            for j in [j for j in range(len(q)) if q[k][j]] if "j" in parts else [None]:
                gone = {"k": k, "j": j}
                found = {"source": k} | ({} if j is None else {"neighbor": j})
                for part in parts:
                    if (below := self.witness(without(q, *map(gone.__getitem__, part)))) is None:
                        break
                    found[f"witness_{part}"] = below
                else:
                    return found
        return None


def status(matrix, kind: str, **budget) -> tuple[str, dict | None]:
    """``true`` with a witness, ``false`` (only if nothing was cut short) or ``unknown``."""
    search = Search(kind, Budget(**{**DIRECT, **budget}))
    try:
        found = search.witness(tuple(tuple(int(x) for x in row) for row in matrix))
    except OutOfBudget:
        return "unknown", None
    return ("true", found) if found is not None else ("unknown" if search.budget.truncated else "false", None)


def mutation_path(matrix, **budget) -> tuple[str, list[int] | None]:
    """``true`` and the mutations to an acyclic quiver, ``false`` (only if nothing was cut short) or ``unknown``."""
    search = Search("p_prime", Budget(**{**DIRECT, **budget}))
    try:
        found = next((p for x, p in search.reached(tuple(tuple(int(v) for v in row) for row in matrix)) if acyclic(x)), None)
    except OutOfBudget:
        return "unknown", None
    return ("true", found) if found is not None else ("unknown" if search.budget.truncated else "false", None)


def mutation_paths(matrices: DataFrame, key: str, **budget) -> DataFrame:
    """``key, matrix, state, path`` of ``matrices(key, matrix)``: mutations that lead to an acyclic quiver, if ``state`` is true.

    Each isomorphism class is searched once, from its canonical form; a path's vertices are then the matrix's own. A null
    matrix has no row."""
    # written before it is used, so that the permutation is not looked for again for each entry
    own = written(matrices.where("matrix is not null").select(key, "matrix", mx.canonical_permutation(F.col("matrix")).alias("_p")))
    own = own.withColumn("_c", mx.relabel(F.col("matrix"), F.col("_p")))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [mutation_path([list(r) for r in m], **budget) for m in b["_c"]]
            yield pd.DataFrame({"_c": b["_c"], "state": [s for s, _ in found], "_path": [p for _, p in found]})

    forms = own.select("_c").distinct().repartition(matrices.sparkSession.sparkContext.defaultParallelism)
    paths = written(forms.mapInPandas(searched, "_c array<array<int>>, state string, _path array<int>"))
    return own.join(paths, "_c").select(key, "matrix", "state", F.transform("_path", lambda k: F.get("_p", k)).alias("path"))


def replayed(m, path):
    """The matrix after the mutations of an array column, as an expression."""
    return F.aggregate(path, m, lambda q, k: mx.mutate(q, k))


#: What is read of a witness: its condition is ``acyclic`` or an object with further witnesses, here as text.
_WITNESS = "mutations array<int>, condition string"
_CONDITION = "source int, neighbor int, witness_k string, witness_j string, witness_kj string"


def certified(rows: DataFrame) -> DataFrame:
    """``key, kind, valid, steps`` of ``rows(key, kind, matrix, witness)``: whether a witness (JSON) proves what it says, and of how many
    witnesses it is made.

    A witness is replayed: its mutations, then either nothing is left but to be acyclic, or the vertex that it names is a source, its
    neighbour is one, and each deletion that ``kind`` asks for has a witness of its own. One round checks all witnesses of a depth,
    so rounds are at most as many as vertices; no witness proves nothing."""
    level, checked = rows.select("key", "kind", "matrix", "witness"), []
    m = F.col("at")
    while True:
        told = level.select("key", "kind", "matrix", F.from_json("witness", _WITNESS).alias("w"))
        at = told.select("key", "kind", replayed(F.col("matrix"), F.col("w.mutations")).alias("at"), F.col("w.condition").alias("condition"))
        at = at.withColumn("c", F.when(F.col("condition") != "acyclic", F.from_json("condition", _CONDITION)))
        k, j = F.col("c.source"), F.col("c.neighbor")
        paired = F.col("kind") != "p_prime"
        is_source = F.array_contains(mx.sources(m), k) & (~paired | (mx.entry(m, k, j) != 0))
        valid = F.when(F.col("condition") == "acyclic", mx.is_acyclic(m)).otherwise(is_source)
        one = F.struct(mx.delete_vertex(m, k).alias("matrix"), F.col("c.witness_k").alias("witness"))
        two = F.struct(mx.delete_vertex(m, j).alias("matrix"), F.col("c.witness_j").alias("witness"))
        both = F.struct(mx.relabel(m, F.filter(mx.vertices(m), lambda v: (v != k) & (v != j))).alias("matrix"), F.col("c.witness_kj").alias("witness"))
        below = F.when(F.col("kind") == "p_prime", F.array(one)).when(F.col("kind") == "banff", F.array(one, two)).otherwise(F.array(one, two, both))
        made = written(at.select("key", "kind", F.coalesce(valid, F.lit(False)).alias("valid"), F.when(F.col("c").isNotNull() & F.coalesce(valid, F.lit(False)), below).alias("below")))
        checked.append(made.select("key", "kind", "valid"))
        level = made.select("key", "kind", F.explode("below").alias("b")).select("key", "kind", "b.matrix", "b.witness")
        if not level.limit(1).count():
            break
    out = checked[0]
    for x in checked[1:]:
        out = out.unionByName(x)
    return out.groupBy("key", "kind").agg(F.bool_and("valid").alias("valid"), F.count(F.lit(1)).alias("steps"))


_STATE = {"true": True, "false": False, "unknown": None}
_SCHEMA = "key string, " + ", ".join(f"is_{c} boolean, {c}_witness string" for c in CONDITIONS)


def local_acyclicity(matrices: DataFrame, tasks: int | None = None, **budget) -> DataFrame:
    """``key`` and for each condition its state and witness (JSON), of ``matrices(key, matrix, is_open)``.

    ``budget`` goes before OPEN and CLOSED. Rows are dealt out one by one, since a search takes between microseconds and its whole budget."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, matrix, is_open in zip(rows["key"], rows["matrix"], rows["is_open"]):
                row = {"key": key}
                for c in CONDITIONS:
                    state, witness = status(matrix, c, **{**(OPEN if is_open else CLOSED), **budget})
                    row[f"is_{c}"], row[f"{c}_witness"] = _STATE[state], None if witness is None else json.dumps(witness, separators=(",", ":"))
                out.append(row)
            yield pd.DataFrame(out, columns=["key", *[x for c in CONDITIONS for x in (f"is_{c}", f"{c}_witness")]]).astype({f"is_{c}": "object" for c in CONDITIONS})

    dealt = matrices.select("key", "matrix", "is_open").repartition(tasks or matrices.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(searched, _SCHEMA)


def class_conditions(g: Generation, **budget) -> DataFrame:
    return local_acyclicity(decoded(g.classes, g.bound, g.max_vertices).select(F.col("mc_id").alias("key"), "matrix", "is_open"), **budget).withColumnRenamed("key", "mc_id")
