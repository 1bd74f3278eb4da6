import pytest
from pyspark.sql import functions as F

from sagitta.__main__ import backfill_labeling_counts, backfill_mutation_acyclic, populate
from sagitta.operators.catalogue import Catalogue
from sagitta.sources import sinks, stored

MADE = {"quivers": 29, "closed": 10, "open": 5, "gluings": 0}


def test_commands(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    assert populate(spark, path, max_vertices=3) == MADE
    before = stored.parts(spark, path)
    assert populate(spark, path, max_vertices=3) == MADE and Catalogue.stored(spark, path).labeled.count() == Catalogue.generated(spark, 3).labeled.count()
    assert {*stored.parts(spark, path)} == {*before} and stored.parts(spark, path) != before
    assert backfill_labeling_counts(spark, path) == (0, 0) and backfill_mutation_acyclic(spark, path, max_vertices=3) == []

    # counts and states are lost; a dry run changes nothing, a run mends them, in one rank only where only one is hit
    c = Catalogue.stored(spark, path)
    lost = c.quivers.where("n_vertices = 3").withColumn("labeling_count", F.lit(None).cast("int"))
    stored.store(spark, path, {"quivers": (lost, "quiver_id", ["quiver_id"])})
    states = c.classes.where("n_vertices = 2").withColumn("is_mutation_acyclic", F.lit(None).cast("boolean"))
    stored.store(spark, path, {"mutation_classes": (states, "mc_id", ["mc_id"])})
    at = stored.parts(spark, path)
    assert backfill_labeling_counts(spark, path, dry_run=True) == (25, 25) and len(backfill_mutation_acyclic(spark, path, dry_run=True, max_vertices=3)) == 3 and stored.parts(spark, path) == at
    assert backfill_labeling_counts(spark, path) == (25, 0)
    assert [w for _, w, _ in backfill_mutation_acyclic(spark, path, max_vertices=3)] == [None] * 3 and backfill_mutation_acyclic(spark, path, max_vertices=3) == []
    now = stored.parts(spark, path)
    assert {k for k in at if at[k] != now[k]} == {("quivers", 3), ("mutation_classes", 2)}

    # a store that dies between its tables and its commit
    whole = sorted(map(str, Catalogue.stored(spark, path).quivers.collect()))

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(stored, "commit", dies)
    with pytest.raises(OSError):
        populate(spark, path, max_vertices=3)
    assert sorted(map(str, Catalogue.stored(spark, path).quivers.collect())) == whole
    monkeypatch.undo()
    assert populate(spark, path, max_vertices=3) == MADE


def test_upsert_of_repeated_keys(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, at int")
    old, new = frame([(1, "a", 0), (3, "x", 0), (None, "n", 0)]), frame([(2, "b", 1), (2, "c", 2), (2, "a", 3), (1, "z", 1), (None, "m", 1), (None, "m", 1)])
    rows = lambda *a, **k: sorted(map(tuple, sinks.upsert(old, new, "k", *a, **k).select("k", "v").collect()), key=repr)
    assert rows(F.col("at")) == [(1, "z"), (2, "a"), (3, "x"), (None, "m"), (None, "m"), (None, "n")]
    assert rows() == [(1, "z"), (2, "c"), (3, "x"), (None, "m"), (None, "m"), (None, "n")]
    assert rows(unique=False) == [(1, "z"), (2, "a"), (2, "b"), (2, "c"), (3, "x"), (None, "m"), (None, "n")]
