"""Matrices derived from events and order lines against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sagitta.sources import derived

DATA = "/root/testdata/sf0.001"


def test_steps_of_events_go_on_from_day_to_day(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        day = datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 0, 1, 1, 5, 40]), hours=rng.randint(0, 23))
        rows.append((i, day, rng.choice([1, 1, 1, 2, 3]), rng.choice(["view", "click", "signup", "purchase", "error", "other", None])))
    rows.append((600, datetime(2024, 3, 3), 9, "view"))  # a user with one event
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").repartition(5)
    want, steps = {}, Counter()
    for u in {r[2] for r in rows}:
        types = [r[3] for r in sorted((r for r in rows if r[2] == u), key=lambda r: (r[1], r[0]))]
        counts = Counter(zip(types, types[1:]))
        steps.update({(u, *k): n for k, n in counts.items()})
        want[u] = [[max(-2, min(2, counts[a, b] - counts[b, a])) if a != b else 0 for b in derived.EVENT_TYPES] for a in derived.EVENT_TYPES]
    found = Counter({(r["user_id"], r["a"], r["b"]): r["n"] for r in derived.event_steps(events).groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()})
    assert found == steps
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert {r["user_id"]: [list(x) for x in r["matrix"]] for r in derived.event_quivers(spark, str(tmp_path)).collect()} == want
    # no task sorts a user's events of all days: the only window by user alone is over days
    plan = derived.event_steps(events)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or "Window [" in line]
    assert len(windows) == 2 and sum("day" in w.split("], [", 1)[1].split("], [")[0] for w in windows) == 1


def test_nations_sum_up_to_regions(spark):
    nation = {r["n_nationkey"]: r["n_regionkey"] for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    keys = sorted(nation)
    regions = {r["month"]: r["matrix"] for r in derived.trade_quivers(spark, DATA, bound=10**9).collect()}
    found = derived.nation_quivers(spark, DATA).collect()
    assert {r["month"] for r in found} == {*regions}
    for r in found:
        total = [[0] * 5 for _ in range(5)]
        for i, row in zip(keys, r["matrix"]):
            for j, x in zip(keys, row):
                assert x == -r["matrix"][keys.index(j)][keys.index(i)]
                total[nation[i]][nation[j]] += x
        assert [[x if a != b else 0 for b, x in enumerate(row)] for a, row in enumerate(total)] == [list(x) for x in regions[r["month"]]]


def test_parts_are_induced(spark):
    one = spark.createDataFrame([("a", [[0, 1, 2], [-1, 0, 3], [-2, -3, 0]])], "owner string, matrix array<array<int>>")
    parts = {tuple(r["part"]): r["matrix"] for r in derived.subquivers(one, 2, size=3).collect()}
    assert parts == {(0,): [[0]], (1,): [[0]], (2,): [[0]], (0, 1): [[0, 1], [-1, 0]], (0, 2): [[0, 2], [-2, 0]], (1, 2): [[0, 3], [-3, 0]]}
