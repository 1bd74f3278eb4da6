"""Tables that are stored again: upserts by rank, committed at once.

A table lies in ``<path>/<table>/version=<v>/n_vertices=<n>``. ``<path>/_commits`` holds a row ``at, table, n_vertices, version`` for each part that a
commit replaced; of each part the latest counts. An upsert writes the ranks that it touches as a new version, merged with what
was there, and then appends its commit, which is one file and so there or not. Until then readers have the tables as they were,
and a store that died can be run again. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import upsert

COMMIT = "at long, table string, n_vertices int, version string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits; none if nothing is stored there."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def parts(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    """The current version of each part: as many rows as there are tables and ranks."""
    rows = commits(spark, path).groupBy("table", "n_vertices").agg(F.max_by("version", F.struct("at", "version")).alias("version")).collect()
    return {(r["table"], r["n_vertices"]): r["version"] for r in rows}


def read(spark: SparkSession, path: str, table: str, ranks: list[int] | None = None) -> DataFrame | None:
    """A stored table, or its parts of some ranks; None if there are none."""
    found = [f"{path}/{table}/version={v}/n_vertices={n}" for (t, n), v in parts(spark, path).items() if t == table and (ranks is None or n in ranks)]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*found).drop("version") if found else None


def store(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str, list[str]]], whole: tuple[str, ...] = (), latest: Column | None = None) -> str:
    """Upserts ``tables`` (name: rows with ``n_vertices``, key, order within files) in one commit; returns its version.

    Of repeated keys in the rows one stays, that with the greatest ``latest`` (else the greatest row); in tables named in ``whole`` a key stands
    for all rows that have it, and new ones replace all old ones."""
    version, done = uuid.uuid4().hex, []
    for name, (rows, key, order) in tables.items():
        ranks = sorted(r[0] for r in rows.select("n_vertices").distinct().collect())
        if not ranks:
            continue
        old = read(spark, path, name, ranks)
        merged = upsert(old, rows, key, latest, unique=name not in whole) if old is not None else upsert(rows.limit(0), rows, key, latest, unique=name not in whole)
        out = merged.repartitionByRange("n_vertices", *order).sortWithinPartitions("n_vertices", *order)
        out.write.partitionBy("n_vertices").parquet(f"{path}/{name}/version={version}")
        done += [(name, n) for n in ranks]
    commit(spark, path, version, done)
    return version


def commit(spark: SparkSession, path: str, version: str, done: list[tuple[str, int]]) -> None:
    """Makes the parts of a version the current ones."""
    at = (commits(spark, path).agg(F.max("at")).collect()[0][0] or 0) + 1
    spark.createDataFrame([(at, t, n, version) for t, n in done], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/_commits")
