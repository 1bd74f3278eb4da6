"""Exchange matrices derived from event and order tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import matrix as mx
from .storage import table

#: Vertices: all event types and all regions of the tables.
EVENT_TYPES = ("view", "click", "signup", "purchase", "error")
REGIONS = (0, 1, 2, 3, 4)


def _matrices(counts: DataFrame, key: str, size: int, bound: int) -> DataFrame:
    """From ``key, i, j, n`` with numbers of steps from i to j: one clamped skew-symmetric matrix for each key."""
    net = lambda i, j: F.lit(0) if i == j else F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col(f"c{i}{j}") - F.col(f"c{j}{i}"))).cast("int")
    sums = [F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("n")).otherwise(0)).alias(f"c{i}{j}") for i in range(size) for j in range(size) if i != j]
    return counts.groupBy(key).agg(*sums).select(key, F.array(*[F.array(*[net(i, j) for j in range(size)]) for i in range(size)]).alias("matrix"))


def event_steps(events: DataFrame) -> DataFrame:
    """``user_id, a, b``: the types of each two events of a user that follow each other in order of time and id.

    Events are put in order within a user's days; from day to day the last type meets the first of the user's next day. So no task
    sorts all events of a user."""
    e = events.select("user_id", F.date_trunc("day", "ts").alias("day"), F.struct("ts", "event_id").alias("at"), F.struct("event_type").alias("type"))
    inside = e.withColumn("next", F.lead("type").over(Window.partitionBy("user_id", "day").orderBy("at")))
    days = e.groupBy("user_id", "day").agg(F.min_by("type", "at").alias("first"), F.max_by("type", "at").alias("type"))
    across = days.withColumn("next", F.lead("first").over(Window.partitionBy("user_id").orderBy("day")))
    both = inside.select("user_id", "type", "next").unionByName(across.select("user_id", "type", "next"))
    return both.where("next is not null").select("user_id", F.col("type.event_type").alias("a"), F.col("next.event_type").alias("b"))


def event_quivers(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = EVENT_TYPES, bound: int = 2) -> DataFrame:
    """``user_id, matrix``: each user's net steps between event types. Users without a step have no arrows."""
    events = table(spark, sf_dir, "events")
    at = F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)])
    counts = event_steps(events).groupBy("user_id", at[F.col("a")].alias("i"), at[F.col("b")].alias("j")).agg(F.count(F.lit(1)).alias("n"))
    none = events.select("user_id").distinct().select("user_id", *[F.lit(None).cast("int").alias(c) for c in "ij"], F.lit(0).cast("long").alias("n"))
    return _matrices(counts.unionByName(none), "user_id", len(types), bound)


def trade_quivers(spark: SparkSession, sf_dir: str, bound: int = 2) -> DataFrame:
    """``month, matrix``: each month's net order lines from suppliers' to customers' regions."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("j"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("i"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _matrices(flows.groupBy("month", "i", "j").agg(F.count(F.lit(1)).alias("n")), "month", len(REGIONS), bound)


def nation_quivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``month, matrix``: each month's net order lines from suppliers' to customers' nations, as they are: all nations in order of their keys."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("j"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("i"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = flows.groupBy("month", "i", "j").agg(F.count(F.lit(1)).alias("n")).groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "n"))).alias("n"))
    # nations are a small table; of a month there is one entry for two of them at most
    keys = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    of = lambda i, j: F.coalesce(F.element_at("n", F.struct(i.alias("i"), j.alias("j"))), F.lit(0).cast("long"))
    net = F.transform("keys", lambda i: F.transform("keys", lambda j: (of(i, j) - of(j, i)).cast("int")))
    return counts.crossJoin(F.broadcast(keys)).select("month", net.alias("matrix"))  # one row


def data_quivers(spark: SparkSession, sf_dir: str, bound: int = 2) -> DataFrame:
    """``owner, matrix``: the quivers of all users and of all months."""
    users = event_quivers(spark, sf_dir, bound=bound).select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("owner"), "matrix")
    return users.unionByName(trade_quivers(spark, sf_dir, bound).select(F.concat(F.lit("month "), F.col("month")).alias("owner"), "matrix"))


def subquivers(quivers: DataFrame, most: int, size: int = len(EVENT_TYPES)) -> DataFrame:
    """``quivers(owner, matrix)`` as ``owner, part, matrix``: what is induced on each set of one to ``most`` of the vertices (the array ``part``)."""
    parts = [[*p] for n in range(1, most + 1) for p in combinations(range(size), n)]
    return quivers.select("owner", "matrix", F.explode(mx._literal(parts, "array<array<int>>")).alias("part")).select("owner", "part", mx.relabel(F.col("matrix"), F.col("part")).alias("matrix"))
