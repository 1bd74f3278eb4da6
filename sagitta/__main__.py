"""Commands: generate a catalogue, or make its derived columns anew."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.acyclicity import resolved_state
from .operators.catalogue import Catalogue, generation
from .sources import stored
from .sources.storage import written


def populate(spark: SparkSession, path: str, max_vertices: int = 4, bound: int = 2) -> dict:
    """Stores the three tables in ``path``, upserting what is there; returns what was made."""
    c = Catalogue.generated(spark, max_vertices, bound, path)
    row = c.classes.agg(F.count_if(~F.col("is_open")).alias("closed"), F.count_if("is_open").alias("open"), F.coalesce(F.sum(F.col("merged_orbit_count") - 1), F.lit(0)).alias("gluings")).collect()[0]
    return {"quivers": c.quivers.count(), **row.asDict()}


def backfill_labeling_counts(spark: SparkSession, path: str, dry_run: bool = False) -> tuple[int, int]:
    """Counts labelings anew, in place: how many rows change, and how many are null after that."""
    c = Catalogue.stored(spark, path)
    new = written(c.backfilled_labeling_counts().join(c.quivers.select("quiver_id", F.col("labeling_count").alias("_was")), "quiver_id").where(~F.col("labeling_count").eqNullSafe(F.col("_was"))).drop("_was"))
    changed = new.count()
    if changed and not dry_run:
        stored.store(spark, path, {"quivers": (new, "quiver_id", ["quiver_id"])})
    return changed, Catalogue.stored(spark, path).quivers.where("labeling_count is null").count()


def backfill_mutation_acyclic(spark: SparkSession, path: str, dry_run: bool = False, max_vertices: int = 4, bound: int = 2) -> list[tuple]:
    """Resolves states anew, in place, where they are known; returns what changes."""
    c, resolved = Catalogue.stored(spark, path), resolved_state(generation(spark, max_vertices, bound))
    changes = written(c.mutation_acyclic_changes(resolved))
    if not dry_run and changes.limit(1).count():
        known = changes.where("now is not null").select("mc_id", F.col("now").alias("is_mutation_acyclic"))
        new = c.classes.drop("is_mutation_acyclic").join(known, "mc_id").select(*c.classes.columns)
        stored.store(spark, path, {"mutation_classes": (new, "mc_id", ["mc_id"])})
    return [tuple(r) for r in changes.orderBy("mc_id").collect()]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sagitta", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("populate", "labeling-counts", "mutation-acyclic"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--max-vertices", type=int, default=4)
        s.add_argument("--bound", type=int, default=2)
        s.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "populate":
        print(populate(spark, a.path, a.max_vertices, a.bound))
    elif a.command == "labeling-counts":
        print(backfill_labeling_counts(spark, a.path, a.dry_run))
    else:
        print(backfill_mutation_acyclic(spark, a.path, a.dry_run, a.max_vertices, a.bound))


if __name__ == "__main__":
    main()
