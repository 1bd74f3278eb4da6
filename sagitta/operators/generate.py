"""Generation of the catalogue: every quiver up to a size and bound, closed under bounded mutation.

Inside, a labeled matrix is ``(n, code)``: the entries above the diagonal, row by row, as digits of base 2 * bound + 1.
Codes order as the matrices do, so a canonical form is the smallest code over all relabelings, and every step is
arithmetic in generated code or on arrays of codes. All seeds are closed at once (``closure``): classes are the components of
the graph of canonical codes, and each class's labeled orbit is closed from its representative.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import invariants as inv
from ..functions import matrix as mx
from ..sources.storage import written
from .closure import MAX_PACKED, canonical_codes, check_size, closure, coded, relabelings
from .components import connected_components, lookup_join

#: Up to so many vertices relabelings are written out in expressions; codes go on to MAX_PACKED.
MAX_VERTICES = 5
#: Seeds and members of an orbit that meet under one key of a join, and rows of the result that a task makes.
SEEDS_OF_KEY, MEMBERS_OF_KEY, ROWS_OF_TASK = 200, 5000, 2_000_000


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def digits(n: int, bound: int, code: Column) -> dict[str, Column]:
    """Columns of the entries above the diagonal."""
    base, pairs = 2 * bound + 1, _pairs(n)
    # whole-number division: a quotient of doubles would round the codes of seven vertices
    return {f"b{i}{j}": (F.call_function("div", code, F.lit(base ** (len(pairs) - 1 - k))) % base - bound).cast("long") for k, (i, j) in enumerate(pairs)}


class Packed:
    """Expressions on the codes of matrices of ``n`` vertices."""

    def __init__(self, n: int, bound: int = 2):
        if not 1 <= n <= MAX_VERTICES:
            raise ValueError(f"1 to {MAX_VERTICES} vertices, not {n}")
        self.n, self.bound, self.base, self.pairs = n, bound, 2 * bound + 1, _pairs(n)

    @property
    def count(self) -> int:
        return self.base ** len(self.pairs)

    def digits(self, code: Column) -> dict[str, Column]:
        return digits(self.n, self.bound, code)

    def b(self, i: int, j: int) -> Column:
        return F.lit(0).cast("long") if i == j else F.col(f"b{i}{j}") if i < j else -F.col(f"b{j}{i}")

    def code(self, b) -> Column:
        return reduce(lambda total, p: total * self.base + b(*p) + self.bound, self.pairs, F.lit(0).cast("long"))

    def canonical(self) -> Column:
        if self.n > 4:  # written out, so many relabelings don't fit one generated method
            entries = F.array(*[self.b(i, j) for i in range(self.n) for j in range(self.n)])
            places = mx._literal([[p[i] * self.n + p[j] for i, j in self.pairs] for p in permutations(range(self.n))], "array<array<int>>")
            return F.array_min(F.transform(places, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda total, x: total * self.base + F.get(entries, x) + self.bound)))
        codes = [self.code(lambda i, j, p=p: self.b(p[i], p[j])) for p in permutations(range(self.n))]
        return codes[0] if len(codes) == 1 else F.least(*codes)

    def mutated(self, k: int) -> dict[tuple[int, int], Column]:
        def entry(i, j):
            if k in (i, j):
                return -self.b(i, j)
            x, y = self.b(i, k), self.b(k, j)
            return self.b(i, j) + F.shiftright(F.abs(x) * y + x * F.abs(y), 1)

        return {p: entry(*p) for p in self.pairs}

    def matrix(self) -> Column:
        return F.array(*[F.array(*[self.b(i, j).cast("int") for j in range(self.n)]) for i in range(self.n)])


def labeled_matrices(spark: SparkSession, n: int, bound: int = 2) -> DataFrame:
    """``n, code, ccode``: every labeled matrix and its canonical code."""
    p = Packed(n, bound)
    return spark.range(p.count).withColumnRenamed("id", "code").withColumns(p.digits(F.col("code"))).select(F.lit(n).alias("n"), "code", p.canonical().alias("ccode"))


def mutations(labeled: DataFrame, n: int, bound: int = 2) -> DataFrame:
    """``n, code, k, dst``: the mutation at each vertex; ``dst`` is null where it leaves the bound."""
    p = Packed(n, bound)
    rows = labeled.where(F.col("n") == n).select("n", "code").withColumns(p.digits(F.col("code")))
    steps = []
    for k in range(n):
        m = p.mutated(k)
        stays = reduce(lambda a, c: a & (F.abs(c) <= bound), m.values(), F.lit(True))
        steps.append(F.struct(F.lit(k).alias("k"), F.when(stays, p.code(lambda i, j, m=m: m[i, j])).alias("dst")))
    return rows.select("n", "code", F.explode(F.array(*steps)).alias("s")).select("n", "code", "s.k", "s.dst")


def decoded(rows: DataFrame, bound: int = 2, most: int = MAX_VERTICES, code: str = "code", name: str = "matrix") -> DataFrame:
    """``rows(n, code, ...)`` with the matrix of ``code``."""

    def of(n: int) -> Column:
        d = digits(n, bound, F.col(code))
        b = lambda i, j: F.lit(0) if i == j else d[f"b{i}{j}"].cast("int") if i < j else -d[f"b{j}{i}"].cast("int")
        return F.array(*[F.array(*[b(i, j) for j in range(n)]) for i in range(n)])

    out = F.when(F.col("n") == 1, of(1))
    for n in range(2, most + 1):
        out = out.when(F.col("n") == n, of(n))
    return rows.withColumn(name, out)


def seed_quivers(spark: SparkSession, max_vertices: int = 4, bound: int = 2) -> DataFrame:
    """``n, code, matrix``: each isomorphism class once, as its canonical form."""
    seeds = reduce(DataFrame.unionByName, [labeled_matrices(spark, n, bound).where("code = ccode").select("n", "code") for n in range(1, max_vertices + 1)])
    return decoded(seeds, bound, max_vertices)


def _check_seeds(seeds: DataFrame, bound: int) -> None:
    m = F.col("matrix")
    bad = seeds.where(~(mx.is_skew_symmetric(m) & mx.is_bounded(m, bound))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]!r} is not a bounded skew-symmetric matrix")


def _expanded_orbits(by_seed: DataFrame, members: DataFrame) -> DataFrame:
    """``by_seed(seed, orbit)`` and ``members(orbit, matrix, is_boundary)`` joined: a row for each seed and member of its orbit.

    Few orbits may hold nearly all seeds, so those of one orbit are dealt to many keys: SEEDS_OF_KEY seeds meet MEMBERS_OF_KEY members."""
    sizes = by_seed.groupBy("orbit").agg(F.count(F.lit(1)).alias("seeds")).join(members.groupBy("orbit").agg(F.count(F.lit(1)).alias("members")), "orbit")
    sizes = written(sizes.select("orbit", F.ceil(F.col("seeds") / SEEDS_OF_KEY).cast("int").alias("a"), F.ceil(F.col("members") / MEMBERS_OF_KEY).cast("int").alias("b"), (F.col("seeds") * F.col("members")).alias("rows")))
    tasks = (sizes.agg(F.sum("rows")).collect()[0][0] or 0) // ROWS_OF_TASK
    dealt = lambda rows, own, by, other, each: rows.join(sizes.select("orbit", "a", "b"), "orbit").select("*", F.pmod(F.xxhash64(by), F.col(own)).cast("int").alias(f"in_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"in_{other}")).select("orbit", "in_a", "in_b", *each)
    key = ["orbit", "in_a", "in_b"]
    left, right = dealt(by_seed, "a", "seed", "b", ["seed"]), dealt(members, "b", "matrix", "a", ["matrix", "is_boundary"])
    if tasks > 1:  # by rows of the result: the joined tables are small, and would be put into a few tasks
        left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    return left.join(right, key).select("seed", "matrix", "is_boundary")


def bfs_orbit(spark: SparkSession, seeds: DataFrame, bound: int = 2, form: Callable[[Column], Column] = lambda m: m) -> DataFrame:
    """``seed, matrix, is_boundary``: all labeled matrices reached from each ``seeds(seed, matrix)`` by mutations within the bound.

    ``is_boundary``: some mutation of the matrix leaves the bound. All seeds are closed at once, each class's labeled orbit is made
    once, and a seed's own is that one relabeled: the closure's work depends on the classes and not on the seeds. Relabeled orbits,
    with ``form`` of each matrix, are made once, too, and only rows of the result are made for each seed. Seeds without a matrix
    have no orbit; a seed with several matrices has theirs together. Raises ValueError for a seed that is not skew-symmetric or
    not within the bound, or that has more than MAX_PACKED vertices.
    """
    seeds = written(seeds.select("seed", "matrix"))  # they are read several times
    _check_seeds(seeds, bound)
    check_size(seeds.agg(F.max(F.size("matrix"))).collect()[0][0] or 1, bound)
    own = written(seeds.where(F.size("matrix") > 0).select("seed", F.size("matrix").alias("n"), coded(F.col("matrix"), bound).alias("code")).distinct())
    named = written(canonical_codes(own.select("n", "code").distinct(), bound))
    c = closure(named.select("n", F.col("ccode").alias("code")), bound)
    orbit_of = F.concat_ws(" ", "n", "class_code", F.array_join("by", ",")).alias("orbit")
    relabeled = written(relabelings(named, c).select("n", "code", "class_code", "by", orbit_of))
    orbit = decoded(c.labeled.select("n", "code", "class_code", "is_boundary"), bound, MAX_PACKED).drop("code")
    members = relabeled.select("n", "class_code", "by", "orbit").distinct().join(orbit, ["n", "class_code"])
    members = written(members.select("orbit", form(mx.relabel(F.col("matrix"), F.col("by"))).alias("matrix"), "is_boundary"))
    found = _expanded_orbits(written(own.join(relabeled.select("n", "code", "orbit"), ["n", "code"]).select("seed", "orbit")), members)
    several = own.groupBy("seed").count().where("count > 1").limit(1).count()
    return found.distinct() if several else found


def merge_orbits(orbits: DataFrame) -> DataFrame:
    """``class, n_vertices, canonical_rep, mc_id, is_open, labeled_size, distinct_quiver_count, merged_orbit_count, frontier`` of ``orbits(class, orbit, matrix, is_boundary, is_open)``: matrices that several orbits hold count once."""
    m = F.col("matrix")
    one = orbits.groupBy("class", "matrix").agg(F.bool_or("is_boundary").alias("is_boundary")).withColumns({"canonical": mx.canonical_form(m)})
    sizes = one.groupBy("class").agg(F.min("canonical").alias("canonical_rep"), F.count(F.lit(1)).cast("int").alias("labeled_size"), F.countDistinct("canonical").cast("int").alias("distinct_quiver_count"), F.count_if("is_boundary").cast("int").alias("frontier"))
    orbit = orbits.groupBy("class").agg(F.bool_or("is_open").alias("is_open"), F.countDistinct("orbit").cast("int").alias("merged_orbit_count"))
    return sizes.join(orbit, "class").withColumns({"n_vertices": F.size("canonical_rep"), "mc_id": mx.mutation_class_id(F.col("canonical_rep"))})


def orbit_overlaps(orbits: DataFrame) -> DataFrame:
    """``a, b, quivers``: pairs of orbits of ``orbits(orbit, qid)`` that span what orbits share, and for how many quivers they do.

    Of each quiver's orbits the least is paired with each of the others: one edge less than orbits, whatever their number, and
    orbits hang together by these pairs if and only if they do by all that share a quiver."""
    rows = orbits.select("orbit", "qid").distinct()
    least = rows.groupBy("qid").agg(F.min("orbit").alias("a"), F.count(F.lit(1)).alias("least_of"))
    return lookup_join(rows, least.where("least_of > 1"), "qid", "least_of", rows.count()).where("orbit <> a").groupBy("a", F.col("orbit").alias("b")).agg(F.count(F.lit(1)).alias("quivers"))


def _glued(orbits: DataFrame) -> DataFrame:
    """``node, root`` of orbits that hang together by quivers they share."""
    over = written(orbit_overlaps(orbits))
    return connected_components(orbits.select(F.col("orbit").alias("node")).distinct(), over.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def gluing_counters(orbits: DataFrame) -> DataFrame:
    """One row ``closed_closed, closed_open, open_open`` of ``orbits(orbit, is_open, qid)``: how many unions glue closed orbits to closed
    ones, then open ones to open ones, then one kind to the other. A union glues two components, so their numbers before and
    after count the unions: in all, orbits less components."""
    parts = lambda rows: _glued(rows).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("k"))
    rows = written(orbits.select("orbit", "is_open", "qid").distinct())
    closed, opened, both = (written(parts(x)).collect()[0] for x in (rows.where("not is_open"), rows.where("is_open"), rows))
    counts = closed["n"] - closed["k"], closed["k"] + opened["k"] - both["k"], opened["n"] - opened["k"]
    return orbits.sparkSession.createDataFrame([counts], "closed_closed long, closed_open long, open_open long")


def check_gluing(orbits: DataFrame) -> dict:
    """The counters; raises AssertionError if a closed orbit is glued to any other."""
    found = gluing_counters(orbits).collect()[0].asDict()
    if found["closed_closed"] or found["closed_open"]:
        raise AssertionError(f"a closed orbit shares a quiver with another orbit: {found}")
    return found


def check_shared(orbits: DataFrame) -> None:
    """Raises AssertionError if a quiver of ``orbits(mc_id, qid, is_open)`` is in a closed orbit and in another one: what
    ``check_gluing`` finds, by one aggregate."""
    shared = orbits.groupBy("qid").agg(F.countDistinct("mc_id").alias("orbits"), F.bool_or(~F.col("is_open")).alias("closed")).where("orbits > 1 and closed")
    if found := shared.take(3):
        raise AssertionError(f"a closed orbit shares a quiver with another orbit: {found}")


@dataclass(frozen=True)
class Generation:
    """``quivers(n, code, qid, class_code, mc_id)``, ``labeled(n, code, ccode, class_code, qid, mc_id, is_boundary)``: the orbit of
    each class's representative; ``classes(n, code, mc_id, is_open, labeled_size, distinct_quiver_count, merged_orbit_count, frontier)``."""

    quivers: DataFrame
    labeled: DataFrame
    classes: DataFrame
    max_vertices: int
    bound: int


def _with_id(rows: DataFrame, prefix: str, code: str, name: str, bound: int, most: int) -> DataFrame:
    made = mx.quiver_id_of_canonical if prefix == "Q" else mx.mutation_class_id
    return decoded(rows, bound, most, code, "_m").withColumn(name, made(F.col("_m"))).drop("_m")


def closed_generation(spark: SparkSession, start: DataFrame, max_vertices: int = 4, bound: int = 2) -> Generation:
    """All that is reached from the canonical codes ``start(n, code)``."""
    c = closure(start, bound)
    roots = c.quivers.select("n", "code", "class_code")
    quivers = written(_with_id(_with_id(roots, "Q", "code", "qid", bound, max_vertices), "MC", "class_code", "mc_id", bound, max_vertices).select("n", "code", "qid", "class_code", "mc_id"))
    labeled = c.labeled.join(quivers.select("n", F.col("code").alias("ccode"), "qid", "mc_id"), ["n", "ccode"])
    labeled = written(labeled.select("n", "code", "ccode", "class_code", "qid", "mc_id", "is_boundary"))
    check_shared(labeled.join(labeled.groupBy("mc_id").agg(F.bool_or("is_boundary").alias("is_open")), "mc_id"))
    classes = labeled.groupBy("n", F.col("class_code").alias("code"), "mc_id").agg(
        F.bool_or("is_boundary").alias("is_open"), F.count(F.lit(1)).cast("int").alias("labeled_size"), F.countDistinct("qid").cast("int").alias("distinct_quiver_count"),
        # one orbit is explored for each class, that of its least, and none is glued to it
        F.countDistinct("class_code").cast("int").alias("merged_orbit_count"), F.count_if("is_boundary").cast("int").alias("frontier"),
    )
    return Generation(quivers, labeled, written(classes), max_vertices, bound)


def all_seeds(spark: SparkSession, max_vertices: int, bound: int = 2) -> DataFrame:
    """``n, code`` of all canonical quivers up to a size; those of five vertices by adding one to those of four."""
    made = [augmented_seeds(spark, bound) if n == 5 else labeled_matrices(spark, n, bound).where("code = ccode").select("n", "code") for n in range(1, max_vertices + 1)]
    return reduce(DataFrame.unionByName, made)


def run_generation(spark: SparkSession, max_vertices: int = 4, bound: int = 2) -> Generation:
    return closed_generation(spark, all_seeds(spark, max_vertices, bound), max_vertices, bound)


def generation_of(spark: SparkSession, matrices: DataFrame, max_vertices: int = 4, bound: int = 2) -> Generation:
    """All that is reached from the matrices in ``matrices(matrix)``, of up to ``max_vertices``; null ones count for nothing. Raises ValueError as
    ``bfs_orbit`` does."""
    if not 1 <= max_vertices <= MAX_VERTICES:
        raise ValueError(f"1 to {MAX_VERTICES} vertices")
    own = matrices.where(F.size("matrix").between(1, max_vertices)).select("matrix").distinct()
    _check_seeds(own, bound)
    codes = own.select(F.size("matrix").alias("n"), coded(F.col("matrix"), bound).alias("code"))
    return closed_generation(spark, canonical_codes(codes, bound).select("n", F.col("ccode").alias("code")).distinct(), max_vertices, bound)


def consistency_violations(g: Generation) -> DataFrame:
    """``what, id``: ids that don't follow from their matrices, members without a class, classes whose representative isn't their least."""
    m = F.col("matrix")
    wrong_q = decoded(g.quivers, g.bound, g.max_vertices).where(F.col("qid") != mx.quiver_id(m)).select(F.lit("quiver id").alias("what"), F.col("qid").alias("id"))
    wrong_c = decoded(g.classes, g.bound, g.max_vertices).where(F.col("mc_id") != mx.mutation_class_id(mx.canonical_form(m))).select(F.lit("class id").alias("what"), F.col("mc_id").alias("id"))
    lost = g.quivers.join(g.classes.select("mc_id"), "mc_id", "left_anti").select(F.lit("membership").alias("what"), F.col("qid").alias("id"))
    least = g.labeled.groupBy("mc_id").agg(F.min("ccode").alias("least"), F.first("class_code").alias("rep")).where("least <> rep").select(F.lit("representative").alias("what"), F.col("mc_id").alias("id"))
    return wrong_q.unionByName(wrong_c).unionByName(lost).unionByName(least)


def augmented_seeds(spark: SparkSession, bound: int = 2) -> DataFrame:
    """``n, code`` of all canonical quivers on five vertices: each canonical one on four gets a vertex in all ways.

    Every quiver on five vertices is a relabeling of such an extension, so 695 * 5**4 candidates stand for 5**10 matrices.
    """
    four, five = Packed(4, bound), Packed(5, bound)
    small = labeled_matrices(spark, 4, bound).where("code = ccode").select("code").withColumns(four.digits(F.col("code")))
    ways = spark.range(five.base**4).select(*[(F.floor(F.col("id") / five.base**k) % five.base - bound).cast("long").alias(f"b{k}4") for k in range(4)])
    rows = small.crossJoin(F.broadcast(ways))  # 695 quivers, 625 ways each: fixed sizes
    codes = rows.select(F.lit(5).alias("n"), five.code(five.b).alias("code"))
    return canonical_codes(codes, bound).select("n", F.col("ccode").alias("code")).distinct()


def bundle(matrices: DataFrame, m: str = "matrix") -> DataFrame:
    """``matrices`` with all invariants of a quiver (up to four vertices)."""
    return matrices.withColumns({"max_edge": mx.max_edge(F.col(m)), "is_acyclic": mx.is_acyclic(F.col(m)), "is_connected": mx.is_connected(F.col(m)), **inv.quiver_invariants(F.col(m))})
