"""Connected components of edge tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import deleted, written

#: A node with more than one in HOT_SHARE of all edges is hot; there are at most twice as many hot nodes, whatever the graph.
HOT_SHARE = 400
#: Rows of a table that are counted to find the hot nodes.
COUNTED = 4_000_000
#: Edges that a task puts in order at once.
EDGES_OF_TASK = 2_000_000


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join to ``right``, which has a key once and in ``weight`` how many of the ``total`` rows of ``left`` have it. Rows of hot keys stay
    where they are and get their few partners by broadcast."""
    limit = max(1000, total // HOT_SHARE)
    hot, cold = right.where(F.col(weight) > limit), right.where(F.col(weight) <= limit)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def _least(edges: DataFrame) -> DataFrame:
    """``u, least, degree`` of ``edges(u, v)``: the smaller of u and its smallest neighbour. Minima are taken in each task
    first, so a hot node's edges don't meet."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count(F.lit(1)).alias("degree"))


def _hot(edges: DataFrame, end: str, total: int) -> list:
    """Nodes that are the ``end`` of more than a share of the ``total`` rows of ``edges``. Large tables are counted by a share of their
    rows, which only decides where a node's edges meet."""
    share, limit = max(1, total // COUNTED), max(1000, total // HOT_SHARE)
    counted = edges if share == 1 else edges.where(F.pmod(F.xxhash64("u", "v"), F.lit(share)) == 0)
    return [r[0] for r in counted.groupBy(end).count().where(F.col("count") > limit / share).select(end).collect()]


def _spread(edges: DataFrame, key: str, total: int) -> DataFrame:
    """More partitions than the session's where its own would be large."""
    tasks = total // EDGES_OF_TASK
    return edges.repartition(tasks, key) if tasks > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else edges


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours hang on the smallest node near it, from ``edges(u, v)`` with v < u: a row for each edge. The smallest
    is one of the smaller neighbours, or the node itself."""
    least = _least(edges).select(F.col("u").alias("v"), "least")
    hot = _hot(edges, "v", total)
    cold = edges.where(~F.col("v").isin(hot)) if hot else edges
    met = _spread(cold, "v", total).join(_spread(least, "v", total), "v", "left")
    if hot:
        is_hot = F.col("v").isin(hot)
        met = met.unionByName(edges.where(is_hot).join(F.broadcast(least.where(is_hot)), "v", "left"))
    return met.select("u", F.coalesce("least", "v").alias("v"))


def _small_star(edges: DataFrame, hot: list, total: int) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them, from ``edges(u, v)`` with v < u: a row for each edge, without
    repeats. Edges of ``hot`` nodes u stay where they are."""
    if hot:
        edges = written(edges)  # read three times
    cold = edges.where(~F.col("u").isin(hot)) if hot else edges
    met = _spread(cold, "u", total).withColumn("least", F.min("v").over(Window.partitionBy("u")))
    if hot:
        of_hot = edges.where(F.col("u").isin(hot))
        met = met.unionByName(of_hot.join(F.broadcast(_least(of_hot).select("u", "least")), "u"))
    return met.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def connected_components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``node, root`` for every row of ``nodes(node)``: the smallest node reachable over ``edges(src, dst)``, read both ways.

    Stars of larger and of smaller neighbours take turns until the edges stay the same; then each node hangs on its root. Both
    keep the components and the number of rounds grows with the logarithm of a component's size. No step gathers a hot node's
    edges: they meet its minimum by broadcast. Edges with a null end count for nothing; nodes without edges are their own roots,
    and ends of edges that aren't nodes connect all the same. Without ``nodes`` all ends of edges are nodes, also those of edges
    that count for nothing; a null end is a node with a null root. A round's table is deleted once the next one is there.
    """
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    ends = edges.select(F.greatest("src", "dst").alias("u"), F.when(both, F.least("src", "dst")).alias("v"))
    linked = F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    every = written((ends if nodes is None else ends.where(linked)).distinct())
    now = every.where(linked)
    told = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % (1 << 31))).collect()[0])
    before, owned = told(now), False
    while before[0]:
        new = written(_small_star(_large_star(now, before[0]), _hot(now, "u", before[0]), before[0]))
        after = told(new)
        if owned:
            deleted(now)
        now, owned = new, True
        if after == before:
            break
        before = after
    if nodes is not None:
        return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    alone = every.where(~linked | F.col("v").isNull())
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    found = found.unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("root"))).unionByName(alone.where("v is null").select(F.col("v").alias("node"), F.col("v").alias("root")))
    return found.groupBy("node").agg(F.min("root").alias("root"))
