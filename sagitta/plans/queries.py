"""One query for each operator: (spark, sf_dir) to a DataFrame whose columns its SQL has, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import groups
from ..functions import invariants as inv
from ..functions import matrix as mx
from ..operators import acyclicity as ac
from ..operators import closure, dynkin, generate
from ..operators.catalogue import Catalogue
from ..operators.components import connected_components
from ..sources import sinks
from ..sources.derived import data_quivers, event_quivers, nation_quivers, subquivers, trade_quivers
from ..sources.storage import table, written

json_of = F.to_json


#: Keys of customers and suppliers whose names stand in their order: nine digits.
KEYS = 1_000_000_000
#: Mutations from each user's quiver that la_path looks at.
LA_DEPTH = 4


def M():  # noqa: N802
    return F.col("matrix")

_kept: dict = {}


def _once(of):
    """``of(spark, sf_dir)``, made once in a session and for each folder."""

    def kept(spark: SparkSession, sf_dir: str):
        key = (of, spark.sparkContext.applicationId, sf_dir)
        if key not in _kept:
            _kept[key] = of(spark, sf_dir)
        return _kept[key]

    return kept


@_once
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``owner, part, matrix``: what the quivers of users and months induce on each set of vertices."""
    return written(subquivers(data_quivers(spark, sf_dir), most=5))


@_once
def generation(spark: SparkSession, sf_dir: str) -> generate.Generation:
    """All that is reached from those of up to four vertices."""
    return generate.generation_of(spark, parts(spark, sf_dir).where("size(part) <= 4"), max_vertices=4)


@_once
def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue.of(spark, generation(spark, sf_dir))


@_once
def closed_owners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, closure.Closure]:
    """``owner, n, ccode`` of the whole quivers of users and months, and their closure."""
    own = data_quivers(spark, sf_dir).select("owner", F.size("matrix").alias("n"), closure.coded(M()).alias("code"))
    named = written(own.join(closure.canonical_codes(own.select("n", "code").distinct()), ["n", "code"]).select("owner", "n", "ccode"))
    return named, closure.closure(named.select("n", F.col("ccode").alias("code")).distinct())


def _found(matrices: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``matrices(matrix)`` with how many of the parts are isomorphic to each (``found``)."""
    coded = lambda rows: rows.withColumns({"_n": F.size("matrix"), "_code": closure.coded(M())})
    canonical = lambda rows: rows.join(closure.canonical_codes(rows.select(F.col("_n").alias("n"), F.col("_code").alias("code")).distinct()).select(F.col("n").alias("_n"), F.col("code").alias("_code"), "ccode"), ["_n", "_code"])
    counts = canonical(coded(parts(spark, sf_dir)).groupBy("_n", "_code").count()).groupBy("_n", "ccode").agg(F.sum("count").alias("found"))
    return canonical(coded(matrices)).join(counts, ["_n", "ccode"], "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))).drop("_n", "_code", "ccode")


#: Fixed matrices that orbits are explored from.
SEEDS = {
    "A2": [[0, 1], [-1, 0]], "A3": [[0, 1, 0], [-1, 0, 1], [0, -1, 0]], "D4": [[0, 1, 1, 1], [-1, 0, 0, 0], [-1, 0, 0, 0], [-1, 0, 0, 0]],
    "kronecker": [[0, 2], [-2, 0]], "markov": [[0, 2, -2], [-2, 0, 2], [2, -2, 0]], "zero2": [[0, 0], [0, 0]], "open3": [[0, 2, 0], [-2, 0, 1], [0, -1, 0]],
}


def _scalar(**columns):
    """A query of expressions on each user's matrix."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return event_quivers(spark, sf_dir).select("user_id", *[of(M()).alias(name) for name, of in columns.items()])

    return query


def seed_frame(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n, SEEDS[n]) for n in names or SEEDS], "seed string, matrix array<array<int>>")


SCALARS = {
    "is_skew_symmetric": _scalar(is_skew_symmetric=mx.is_skew_symmetric),
    "max_edge": _scalar(max_edge=mx.max_edge),
    "is_bounded": _scalar(bounded1=lambda m: mx.is_bounded(m, 1), bounded2=mx.is_bounded),
    "is_connected": _scalar(is_connected=mx.is_connected),
    "is_acyclic": _scalar(is_acyclic=mx.is_acyclic),
    "apply_permutation": _scalar(relabeled=lambda m: json_of(mx.relabel(m, F.array(*map(F.lit, (2, 0, 4, 3, 1)))))),
    "canonical_form": _scalar(canonical=lambda m: json_of(mx.canonical_form(m))),
    "certificate": _scalar(certificate=lambda m: F.lower(F.hex(mx.certificate(m)))),
    "quiver_id": _scalar(quiver_id=mx.quiver_id),
    "mutation_class_id": _scalar(id_of_form=lambda m: mx.mutation_class_id(mx.canonical_form(m))),
    "is_bipartite": _scalar(is_bipartite=mx.is_bipartite),
    "is_abundant": _scalar(is_abundant=mx.is_abundant),
    "is_planar": _scalar(is_planar=mx.is_planar, four_of_it=lambda m: mx.is_planar(mx.delete_vertex(m, 4))),
    "determinant": _scalar(determinant=inv.determinant_native, of_form=lambda m: inv.determinant_native(inv.tits_form(m))),
    "representation_type": _scalar(representation_type=inv.representation_type_native),
    "rep_finite": _scalar(rep_finite=inv.is_representation_finite),
    "rep_tame": _scalar(rep_tame=inv.is_representation_tame),
    "symmetry_order": _scalar(symmetry_order=inv.symmetry_order),
    "symmetry_name": _scalar(symmetry_name=inv.symmetry_name),
    "quiver_invariants": lambda spark, sf_dir: event_quivers(spark, sf_dir).select("user_id", *[c.alias(n) for n, c in inv.quiver_invariants(M()).items()]),
    "connected_components": _scalar(components=lambda m: json_of(mx.connected_components(m))),
    "sources": _scalar(sources=lambda m: json_of(mx.sources(m))),
    "matrix_roundtrip": _scalar(matrix=lambda m: json_of(mx.matrix_from_json(mx.matrix_json(m)))),
    "compose": _scalar(composed=lambda m: json_of(mx.compose(mx.canonical_permutation(m), F.array(*map(F.lit, (1, 0, 2, 3, 4)))))),
}


def symmetry_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetry groups of all users' and months' quivers, with their greedy generators."""
    return groups.symmetry_groups(data_quivers(spark, sf_dir), "owner").withColumn("generators", json_of("generators"))


def canonical_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each month's quiver of all nations."""
    return groups.canonical_forms(nation_quivers(spark, sf_dir), "month").select("month", F.size("canonical").alias("n"), F.sha2(json_of("canonical"), 256).alias("certificate"))


def canonical_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's quivers of six nations in a row: both ways to the canonical form."""
    rows = nation_quivers(spark, sf_dir).select("month", M(), F.explode(F.sequence(F.lit(0), F.size("matrix") - 6)).alias("first"))
    six = rows.select(F.concat_ws(" ", "month", "first").alias("key"), mx.relabel(M(), F.sequence("first", F.col("first") + 5)).alias("matrix"))
    return groups.verified(six, "key").select("key", json_of("canonical").alias("canonical"), "agree")


def exact_determinants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinants of each month's quiver of all nations but the last and of its form, whatever their size."""
    rows = nation_quivers(spark, sf_dir).select("month", mx.delete_vertex(M(), F.size("matrix") - 1).alias("matrix"))
    return rows.select("month", inv.determinant(M()).alias("determinant"), inv.determinant(inv.tits_form(M())).alias("of_form"))


def mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_quivers(spark, sf_dir).select("user_id", M(), F.explode(mx.vertices(M())).alias("k")).select("user_id", "k", json_of(mx.mutate(M(), F.col("k"))).alias("mutated"))


def delete_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_quivers(spark, sf_dir).select("user_id", M(), F.explode(mx.vertices(M())).alias("k")).select("user_id", "k", json_of(mx.delete_vertex(M(), F.col("k"))).alias("deleted"))


def are_isomorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's matrix against that of the user before."""
    rows = event_quivers(spark, sf_dir)
    before = rows.select((F.col("user_id") + 1).alias("user_id"), M().alias("other"))
    return rows.join(before, "user_id", "left").select("user_id", mx.are_isomorphic(M(), F.col("other")).alias("isomorphic"))


def trade_quiver_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_quivers(spark, sf_dir).withColumn("quiver_id", mx.quiver_id(M())).select("month", json_of(M()).alias("matrix"), "quiver_id")


def join_events_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' quivers without each of their vertices, found in the catalogue with their classes."""
    c = catalogue(spark, sf_dir)
    rows = event_quivers(spark, sf_dir).select("user_id", F.posexplode(F.transform(mx.vertices(M()), lambda k: mx.delete_vertex(M(), k))).alias("k", "m")).select("user_id", "k", mx.quiver_id(F.col("m")).alias("quiver_id"))
    return rows.join(c.joined().select("quiver_id", "mc_id", "representation_type", F.col("mc.is_open").alias("is_open"), F.col("mc.dynkin_type").alias("dynkin_type")), "quiver_id", "left").select("user_id", "k", "quiver_id", "mc_id", "representation_type", "is_open", "dynkin_type")


def seed_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seed of up to four vertices, and how many parts of users' and months' quivers it is the form of."""
    seeds = generate.decoded(generate.all_seeds(spark, 4), 2, 4).select("n", "matrix")
    return _found(seeds, spark, sf_dir).select(F.col("n").cast("int").alias("n"), json_of(M()).alias("matrix"), "found")


def dynkin_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(dynkin.family_seeds(spark), spark, sf_dir).select("name", "n", json_of(M()).alias("matrix"), "found")


def bfs_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the quiver of each user and month reaches."""
    return generate.bfs_orbit(spark, data_quivers(spark, sf_dir).withColumnRenamed("owner", "seed"), form=json_of).withColumnRenamed("seed", "owner")


def _explored(name: str):
    """The class of each different labeled part that is isomorphic to a seed, explored from it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        form = seed_frame(spark, name).select(mx.canonical_form(M()).alias("form"))
        like = parts(spark, sf_dir).where(F.size("part") == len(SEEDS[name])).select("matrix").distinct().join(F.broadcast(form), mx.canonical_form(M()) == F.col("form"))  # one row
        orbit = written(generate.bfs_orbit(spark, like.select(json_of(M()).alias("seed"), "matrix")))
        is_open = orbit.groupBy("seed").agg(F.bool_or("is_boundary").alias("is_open"))
        rows = orbit.join(is_open, "seed").withColumns({"class": F.col("seed"), "orbit": F.lit(0)})
        return generate.merge_orbits(rows).select(F.col("class").alias("seed"), "mc_id", json_of("canonical_rep").alias("canonical_rep"), "is_open", "labeled_size", "distinct_quiver_count", "frontier")

    return query


def canonical_class_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of the class of each user's and month's quiver."""
    own, c = closed_owners(spark, sf_dir)
    rows = own.join(c.quivers.select("n", F.col("code").alias("ccode"), F.col("class_code").alias("code")), ["n", "ccode"])
    return generate.decoded(rows, 2, 5).select("owner", json_of(M()).alias("canonical_rep"))


def _orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orbit, is_open, qid``: the quivers in the orbit of each user's and month's quiver."""
    own, c = closed_owners(spark, sf_dir)
    of_class = c.labeled.groupBy("n", "class_code").agg(F.bool_or("is_boundary").alias("is_open"))
    members = c.quivers.join(of_class, ["n", "class_code"]).select("n", "class_code", "is_open", F.concat_ws(".", "n", "code").alias("qid"))
    named = own.join(c.quivers.select("n", F.col("code").alias("ccode"), "class_code"), ["n", "ccode"])
    return named.join(members, ["n", "class_code"]).select(F.col("owner").alias("orbit"), "is_open", "qid")


def orbit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that span the orbits which share quivers, with how many."""
    return generate.orbit_overlaps(_orbits(spark, sf_dir))


#: Vertices of the quivers whose orbits are merged.
FIRST_FOUR = (0, 1, 2, 3)


def merge_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orbits of all owners' parts on the first four vertices, those that share a quiver merged under the least owner."""
    seeds = parts(spark, sf_dir).where(F.col("part") == F.array(*map(F.lit, FIRST_FOUR))).select(F.col("owner").alias("seed"), "matrix")
    orbit = written(generate.bfs_orbit(spark, seeds).withColumn("code", closure.coded(M())))
    qids = closure.canonical_codes(orbit.select(F.lit(4).alias("n"), "code").distinct()).select("code", F.col("ccode").alias("qid"))
    shared = written(orbit.select(F.col("seed").alias("orbit"), "code").join(qids, "code").select("orbit", "qid").distinct())
    over = generate.orbit_overlaps(shared)
    glued = connected_components(shared.select(F.col("orbit").alias("node")).distinct(), over.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    is_open = orbit.groupBy("seed").agg(F.bool_or("is_boundary").alias("is_open"))
    rows = orbit.join(is_open, "seed").join(glued.select(F.col("node").alias("seed"), F.col("root").alias("class")), "seed").withColumnRenamed("seed", "orbit")
    return generate.merge_orbits(rows).select("class", "mc_id", json_of("canonical_rep").alias("canonical_rep"), "is_open", "labeled_size", "distinct_quiver_count", "merged_orbit_count", "frontier")


def gluing_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gluing the orbits of all owners' quivers takes."""
    return generate.gluing_counters(_orbits(spark, sf_dir))


def generated_gluing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the generated classes' own orbits: all zero."""
    g = generation(spark, sf_dir)
    orbits = g.labeled.join(g.classes.select("mc_id", "is_open"), "mc_id").select(F.col("mc_id").alias("orbit"), "is_open", "qid")
    return generate.gluing_counters(orbits)


def run_generation(n: int):
    """The classes of all parts of up to ``n`` vertices."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = generation(spark, sf_dir) if n == 4 else generate.generation_of(spark, parts(spark, sf_dir).where(F.size("part") <= n), n)
        return generate.decoded(g.classes, 2, n).select(F.col("n").cast("int").alias("n"), "mc_id", json_of(M()).alias("canonical_rep"), "is_open", "labeled_size", "distinct_quiver_count", "merged_orbit_count", "frontier")

    return query


def mutation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quiver's class: the component of the graph of canonical forms and mutations."""
    g = generation(spark, sf_dir)
    return g.quivers.select(F.col("n").cast("int").alias("n"), "qid", "mc_id")


def nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("long").alias("node"))
    edges = nation.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") * 5).cast("long").alias("dst"))
    return connected_components(nodes, edges)


def trade_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of each month, linked by its order lines.

    Nodes are numbers in the order of their names: month, kind and key, which take a fraction of the names' room. Keys of more
    than nine digits (or less than 0) don't stand in order in names; then the names themselves are linked."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    span = lambda rows, key, *more: rows.agg(F.coalesce(F.min(key) >= 0, F.lit(True)) & F.coalesce(F.max(key) < KEYS, F.lit(True)), *more).collect()[0]
    years = F.coalesce((F.year(F.min("o_orderdate")) >= 0) & (F.year(F.max("o_orderdate")) < 10_000), F.lit(True))
    by_number = all(span(orders, "o_custkey", years)) and all(span(lines, "l_suppkey"))
    if by_number:
        month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long")
        node = lambda kind, key: ((F.col("month") * 2 + kind) * KEYS + F.col(key)).alias("src" if kind == 0 else "dst")
    else:
        month = F.date_format("o_orderdate", "yyyy-MM")
        node = lambda kind, key: F.when(F.col(key).isNotNull(), F.concat("month", F.format_string(f"/{'cs'[kind]}%09d", key))).alias("src" if kind == 0 else "dst")
    met = lines.join(orders.select("o_orderkey", "o_custkey", month.alias("month")), F.col("l_orderkey") == F.col("o_orderkey"))
    found = connected_components(None, met.select(node(0, "o_custkey"), node(1, "l_suppkey")))
    if not by_number:
        return found

    def name(x: str):
        div = lambda by: F.call_function("div", F.col(x), F.lit(by))
        text = lambda number, width: F.lpad(number.cast("string"), width, "0")
        return F.concat(text(div(24 * KEYS), 4), F.lit("-"), text(div(2 * KEYS) % 12 + 1, 2), F.when(div(KEYS) % 2 == 0, "/c").otherwise("/s"), text(F.col(x) % KEYS, 9)).alias(x)

    return found.select(name("node"), name("root"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = generation(spark, sf_dir)
    return g.labeled.select("qid", "mc_id").distinct()


def consistency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.consistency_violations(generation(spark, sf_dir))


def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation(spark, sf_dir).classes.groupBy(F.col("n").cast("int").alias("n")).agg(F.count_if(~F.col("is_open")).alias("closed"), F.count_if("is_open").alias("open"))


def labeling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).labeled.groupBy("quiver_id").agg(F.count(F.lit(1)).alias("labeling_count"))


def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).classes.select("mc_id", "labeled_size", "distinct_quiver_count")


def class_openness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).classes.select("mc_id", "is_open")


def class_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalogue(spark, sf_dir)
    return c.joined().select("quiver_id", c.class_size().alias("class_size"))


def frontier_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).classes.select("mc_id", "size_of_explored_frontier", F.size("boundary_quivers").alias("boundary"))


def distinct_quivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).distinct_quivers().orderBy("mc_id", F.desc("is_canonical"), F.desc("labeling_count"), "quiver_id").withColumn("matrix", json_of("matrix"))


def class_mutation_acyclic_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.base_state(generation(spark, sf_dir)).select("mc_id", "base")


def resolve_mutation_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).classes.select("mc_id", "is_mutation_acyclic")


def dynkin_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference types' classes, and how many parts of users' and months' quivers are in each."""
    names = dynkin.reference_quivers(spark)
    counts = _found(generate.decoded(names, 2, 4), spark, sf_dir).groupBy("name").agg(F.sum("found").alias("found"))
    reps = generate.decoded(names.select("name", "n", F.col("class_code").alias("code")).distinct(), 2, 4)
    return reps.select("name", mx.mutation_class_id(M()).alias("mc_id")).join(counts, "name")


def dynkin_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynkin.class_types(spark, generation(spark, sf_dir))


def local_acyclicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored states of all classes."""
    return catalogue(spark, sf_dir).classes.select("mc_id", "is_banff", "is_louise", "is_p_prime")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON of all classes says, but for the witnesses."""
    return _said(catalogue(spark, sf_dir).classes)


def _said(rows: DataFrame) -> DataFrame:
    get = lambda path: F.try_variant_get("provenance", path, "string")
    return rows.select("mc_id", *[get(f"$.is_{c}.state").alias(c) for c in ac.CONDITIONS], get("$.is_infinite_confirmed.method").alias("method"))


def local_acyclicity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all classes, searched anew, and whether each witness, replayed, proves its state."""
    g = generation(spark, sf_dir)
    found = written(ac.class_conditions(g, **ac.COUNTED))
    rows = generate.decoded(g.classes, g.bound, g.max_vertices).select("mc_id", "matrix").join(found, "mc_id")
    told = rows.select(F.col("mc_id").alias("key"), "matrix", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(f"{c}_witness").alias("witness")) for c in ac.CONDITIONS])).alias("w"))
    valid = ac.certified(told.where("w.witness is not null").select("key", "w.kind", "matrix", "w.witness"))
    by_class = valid.groupBy("key").agg(*[F.max(F.when(F.col("kind") == c, F.col("valid"))).alias(f"{c}_proved") for c in ac.CONDITIONS])
    states = found.select("mc_id", *[f"is_{c}" for c in ac.CONDITIONS])
    return states.join(by_class.withColumnRenamed("key", "mc_id"), "mc_id", "left")


def provenance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stored documents, but for the vertices of witnesses: in their place stand the numbers of their mutations."""
    text = F.to_json("provenance")
    for c in ac.CONDITIONS:
        steps = F.size(F.from_json(F.get_json_object(F.to_json("provenance"), f"$.is_{c}.witness.mutations"), "array<int>"))
        plain = F.to_json(F.struct(F.try_variant_get("provenance", f"$.is_{c}.state", "string").alias("state"), F.when(steps >= 0, steps).alias("witness")), {"ignoreNullFields": "false"})
        own = F.concat(F.lit(f'"is_{c}":'), plain)
        text = own if c == ac.CONDITIONS[0] else F.concat(text, F.lit(","), own)
    why = F.get_json_object(F.to_json("provenance"), "$.is_infinite_confirmed.method")
    tail = F.when(why.isNotNull(), F.concat(F.lit(',"is_infinite_confirmed":'), F.to_json(F.struct(why.alias("method"))))).otherwise("")
    return catalogue(spark, sf_dir).classes.select("mc_id", F.concat(F.lit("{"), text, tail, F.lit("}")).alias("document"))


def la_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's quiver leads to an acyclic one in LA_DEPTH mutations with entries up to 8, by how many, and whether they do when replayed."""
    found = ac.mutation_paths(event_quivers(spark, sf_dir), "user_id", timeout=None, max_depth=LA_DEPTH, cap=8)
    # a column of its own, so that a matrix is replayed once and not for each of its entries
    ends = found.withColumn("end", F.when(F.col("path").isNotNull(), ac.replayed(M(), F.col("path"))))
    return ends.select("user_id", "state", F.when(F.size("path") >= 0, F.size("path")).alias("steps"), F.when(F.col("end").isNotNull(), mx.is_acyclic(F.col("end"))).alias("replayed"))


def _items(of):
    """A listing with its matrices as JSON."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = of(catalogue(spark, sf_dir))
        return rows.withColumn("exchange_matrix", json_of("exchange_matrix")) if "exchange_matrix" in rows.columns else rows

    return query


def _ids(**filters):
    """The ids and totals' parts of what a filter lets through."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalogue(spark, sf_dir).filtered(**filters).select("quiver_id", "labeling_count")

    return query


#: Filters by query: parameters of ``Catalogue.filtered``.
FILTERS = {
    "filter_rank": {"rank": 3}, "filter_max_edge": {"max_edge": 2}, "filter_acyclic": {"is_acyclic": True}, "filter_connected": {"is_connected": False}, "filter_simply_laced": {"is_simply_laced": True},
    "filter_open": {"is_open": False}, "filter_mutation_finite": {"is_mutation_finite": False}, "filter_dynkin": {"dynkin_type": "A1 + A2"}, "filter_reptype": {"representation_type": "tame"},
    "filter_orbit_range": {"orbit_min": 10, "orbit_max": 30}, "filter_conjunction": {"rank": 4, "is_acyclic": True, "is_connected": True, "is_mutation_finite": True, "orbit_min": 2},
}


def quiver_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).quiver("Q.n3.760c251bd59844de")
    return rows.select(*[c for c in rows.columns if c not in ("exchange_matrix", "symmetry_group", "tags")], json_of("exchange_matrix").alias("exchange_matrix"), F.col("symmetry_group.order").alias("symmetry_order"), F.col("symmetry_group.name").alias("symmetry_name"), F.size("tags").alias("tags"))


def class_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir).class_("MC.n3.b381eb01e067a126")
    return rows.select("mc_id", "num_vertices", json_of("canonical_rep").alias("canonical_rep"), "is_open", "class_size", "labeled_size", "distinct_quiver_count", "canonical_qid", "dynkin_type", "size_of_explored_mutation_class", F.size("labeled_quivers").alias("labelings"), json_of(F.transform("distinct_quivers", lambda x: x["quiver_id"])).alias("distinct_ids"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).totals(rank=4, is_connected=True)


def export(scope: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalogue(spark, sf_dir).export(scope=scope)

    return query


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the exported file."""
    return sinks.csv_lines(catalogue(spark, sf_dir).export())


def export_cell_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cells(catalogue(spark, sf_dir).export(is_open=True).select("quiver_id", "representation_type", "max_edge", "is_acyclic", "class_size", "is_planar"))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quivers, upserted by those of rank two with other counts, each twice: the later one stays."""
    own = catalogue(spark, sf_dir).quivers.select("quiver_id", "n_vertices", "labeling_count")
    new = own.where("n_vertices = 2").withColumn("at", F.explode(F.array(*map(F.lit, (2, 1))))).withColumn("labeling_count", -F.col("at"))
    return sinks.upsert(own, new, "quiver_id", latest=F.col("at"))


def backfill_labeling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts made anew where all are lost and the labelings of half the classes are gone."""
    c = catalogue(spark, sf_dir)
    lost = Catalogue(c.quivers.withColumn("labeling_count", F.lit(None).cast("int")), c.classes, c.labeled.where("mc_id < 'MC.n4.8'"))
    return lost.backfilled_labeling_counts().select("quiver_id", "labeling_count")


def backfill_mutation_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would change if the stored states were those from before the resolution."""
    base = ac.base_state(generation(spark, sf_dir))
    c = catalogue(spark, sf_dir)
    old = Catalogue(c.quivers, c.classes.drop("is_mutation_acyclic").join(base.select("mc_id", F.col("base").alias("is_mutation_acyclic")), "mc_id"), c.labeled)
    return old.mutation_acyclic_changes(c.classes.select("mc_id", F.col("is_mutation_acyclic").alias("resolved")))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that stand for downloads."""
    return table(spark, sf_dir, "events")


def _forwarded():
    return F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 5).cast("string"), F.lit(", 10.1.1.1"))).otherwise("")


def _filters():
    return F.create_map(F.lit("rank"), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 3).cast("string")), F.lit("scope"), F.lit("distinct"))


def client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of events, every fifth without a header."""
    return _requests(spark, sf_dir).select("event_id", sinks.client_ip(_forwarded(), F.lit("127.0.0.1")).alias("ip"))


def logged_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters as the log holds them, every third user's without a rank."""
    return _requests(spark, sf_dir).select("event_id", sinks.logged_filters(_filters()).alias("filters"))


def download_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the log (but for the clock) of events."""
    events = _requests(spark, sf_dir).select(
        F.when(F.col("event_id") % 2 == 0, "csv").otherwise("xlsx").alias("fmt"), (F.col("event_id") % 100).alias("row_count"), _filters().alias("filters"),
        F.when(F.col("user_id") % 2 == 0, "").otherwise(F.concat(F.col("user_id").cast("string"), F.lit("@example.org"))).alias("email"), F.lit("").alias("name"), sinks.client_ip(_forwarded(), F.lit("127.0.0.1")).alias("ip"),
        F.lit(None).cast("string").alias("user_agent"), F.col("event_id").cast("string").alias("referer"),
    )
    return sinks.log_rows(events).drop("created_at")


QUERIES = {
    **SCALARS, "symmetry_generators": symmetry_generators, "canonical_nations": canonical_nations, "canonical_verify": canonical_verify, "exact_determinants": exact_determinants, "mutate": mutate, "delete_vertex": delete_vertex, "are_isomorphic": are_isomorphic, "trade_quiver_ids": trade_quiver_ids, "join_events_catalogue": join_events_catalogue,
    "seed_enumeration": seed_enumeration, "dynkin_seeds": dynkin_seeds, "bfs_orbit": bfs_orbit, "explore_a3": _explored("A3"), "explore_d4": _explored("D4"), "explore_open3": _explored("open3"),
    "canonical_class_rep": canonical_class_rep, "orbit_overlap": orbit_overlap, "merge_orbits": merge_orbits, "gluing_counters": gluing_counters, "generated_gluing": generated_gluing,
    "run_generation_n3": run_generation(3), "run_generation_n4": run_generation(4), "mutation_components": mutation_components, "nation_components": nation_components, "trade_components": trade_components, "membership": membership,
    "consistency_violations": consistency_violations, "generation_summary": generation_summary, "labeling_counts": labeling_counts, "class_sizes": class_sizes, "class_openness": class_openness, "class_size": class_size,
    "frontier_size": frontier_size, "distinct_quivers": distinct_quivers, "class_mutation_acyclic_base": class_mutation_acyclic_base, "resolve_mutation_acyclic": resolve_mutation_acyclic,
    "dynkin_reference": dynkin_reference, "dynkin_classify": dynkin_classify, "local_acyclicity": local_acyclicity, "provenance": provenance,
    "local_acyclicity_all": local_acyclicity_all, "provenance_all": provenance_all, "la_path": la_path,
    "join_quiver_class": _items(lambda c: c.items(c.joined())), "list_quivers": _items(lambda c: c.list_quivers(rank=3, is_acyclic=True)),
    "list_sorted": _items(lambda c: c.list_quivers(sort="class_size", direction="desc", limit=None)), "list_page": _items(lambda c: c.list_quivers(sort="max_edge", direction="desc", offset=20, limit=30)),
    "labelings_scope": _items(lambda c: c.list_quivers(scope="labelings", limit=None)), "labelings_page": _items(lambda c: c.list_quivers(scope="labelings", sort="quiver_id", offset=100, limit=50)),
    "search": _items(lambda c: c.search(is_simply_laced=True, is_connected=True)), **{name: _ids(**f) for name, f in FILTERS.items()},
    "quiver_detail": quiver_detail, "class_detail": class_detail, "totals": totals, "export_distinct": export("distinct"), "export_labelings": export("labelings"), "export_csv": export_csv, "export_cell_format": export_cell_format,
    "upsert_merge": upsert_merge, "backfill_labeling_count": backfill_labeling_count, "backfill_mutation_acyclic": backfill_mutation_acyclic, "download_log": download_log,
    "client_ip": client_ip, "logged_filters": logged_filters,
}
