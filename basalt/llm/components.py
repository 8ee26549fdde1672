"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour ``m`` of their ``a``.

    A hub's edges are one key.  The join is on another number than the one that
    the neighbours were grouped by, so that both sides are shuffled for it
    alone, and adaptive execution can split the hub.
    """
    key = F.col("a").bitwiseXOR(F.lit(1).cast("long"))
    return edges.withColumn("key", key).join(least.select(key.alias("key"), "m").hint("merge"), "key").drop("key")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the least node of its component.

    Each round is one written table, so lineage stays short and a lost executor
    costs one round's tasks.  Rounds go on until one changes nothing, some
    log squared of the nodes at most.  Nothing but a count and a checksum comes
    to the driver.  No edges give no rows; loops and repeated edges change nothing.
    """
    now = scratch.table("edges-0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, k = None, 0
    while True:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(check) == seen or not check[0]:
            break
        seen, k = tuple(check), k + 1
        now = scratch.table(f"edges-{k}", _small_star(_large_star(now)))
        if k > 1:
            scratch.drop(f"edges-{k - 2}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()
