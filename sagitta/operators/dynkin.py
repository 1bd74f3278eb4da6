"""Dynkin types of mutation classes, from reference classes of rank four and less."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as mx
from ..sources.storage import written
from .closure import canonical_codes, classes_of, coded
from .generate import Generation, decoded

#: Reference types: names and ranks.
REFERENCE = (("A1", "A", 1), ("A2", "A", 2), ("A3", "A", 3), ("A4", "A", 4), ("D4", "D", 4))


def family_seed(family: str, n: int) -> list[list[int]]:
    """A path of n vertices; for D, n >= 4, its last vertex hangs on the third from the end instead."""
    if family == "D" and n < 4:
        raise ValueError("D needs four vertices")
    arrows = [(i, i + 1) for i in range(n - 1)] if family == "A" else [*((i, i + 1) for i in range(n - 2)), (n - 3, n - 1)]
    return [[1 if (i, j) in arrows else -1 if (j, i) in arrows else 0 for j in range(n)] for i in range(n)]


def family_seeds(spark: SparkSession, most: int = 5) -> DataFrame:
    """``name, n, matrix`` of both families up to ``most`` vertices, as expressions on the number of vertices."""
    n = F.col("n")
    seq = F.sequence(F.lit(0), n - 1)
    path = lambda i, j: (F.abs(i - j) == 1) & ~((F.col("family") == "D") & (F.greatest(i, j) == n - 1))
    fork = lambda i, j: (F.col("family") == "D") & (F.greatest(i, j) == n - 1) & (F.least(i, j) == n - 3)
    entry = lambda i, j: F.when(path(i, j) | fork(i, j), F.when(i < j, 1).otherwise(-1)).otherwise(0)
    sizes = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit("A"), F.lit("D"))).alias("family")).where("family = 'A' or n >= 4")
    return sizes.select(F.concat("family", n.cast("string")).alias("name"), "n", F.transform(seq, lambda i: F.transform(seq, lambda j: entry(i, j))).alias("matrix"))


_kept: dict[str, DataFrame] = {}


def reference_quivers(spark: SparkSession) -> DataFrame:
    """``name, n, code, class_code``: the canonical codes of all quivers of the reference types' classes, 18 rows, made once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _kept:
        rows = spark.createDataFrame([(name, n, family_seed(f, n)) for name, f, n in REFERENCE], "name string, n int, matrix array<array<int>>")
        coded_rows = rows.select("name", "n", coded(F.col("matrix")).alias("code"))
        named = written(coded_rows.join(canonical_codes(coded_rows.select("n", "code")), ["n", "code"]).select("name", "n", "ccode"))
        quivers = classes_of(named.select("n", F.col("ccode").alias("code")))
        of = named.join(quivers.select("n", F.col("code").alias("ccode"), "class_code"), ["n", "ccode"]).select("name", "n", "class_code")
        _kept[key] = written(quivers.join(of, ["n", "class_code"]).select("name", "n", "code", "class_code"))
    return _kept[key]


def classify(spark: SparkSession, matrices: DataFrame, key: str) -> DataFrame:
    """``key, dynkin_type`` of ``matrices(key, matrix)``: the sorted names of the connected parts' types, null if one part is of none."""
    parts = matrices.select(key, F.explode(mx.connected_components(F.col("matrix"))).alias("part")).withColumn("qid", mx.quiver_id(F.col("part")))
    names = decoded(reference_quivers(spark), 2, 4).select("name", mx.quiver_id_of_canonical(F.col("matrix")).alias("qid"))
    named = parts.join(F.broadcast(names), "qid", "left")  # 18 rows
    joined = F.array_join(F.array_sort(F.collect_list("name")), " + ")
    return named.groupBy(key).agg(F.when(F.count("name") == F.count(F.lit(1)), joined).alias("dynkin_type"))


def class_types(spark: SparkSession, g: Generation) -> DataFrame:
    """``mc_id, dynkin_type`` of closed classes."""
    return classify(spark, decoded(g.classes.where("not is_open"), g.bound, g.max_vertices).select("mc_id", "matrix"), "mc_id")
