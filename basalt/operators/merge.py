"""Latest record per key, and the merge of a snapshot with deltas."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.columns import safe_date
from basalt.operators.joins import broadcast_if_small
from basalt.sources import writers
from basalt.workspace import Scratch


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Written as a rank with a filter, which Spark turns into a limit per group
    on both sides of the one shuffle; so a hot key sends one row per task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def merge_snapshot(base: DataFrame, delta: DataFrame, key: str, *, base_date: str, date_column: str = "load_date", tie: list[str] | None = None) -> DataFrame:
    """Last writer wins: the newest record per key of the base (dated ``base_date``) and the delta.

    On equal days the delta beats the base, and the columns in ``tie`` decide
    among the delta's own rows, so that the result does not depend on the plan.
    Rows of the delta whose day cannot be read are not merged: see ``unreadable_dates``.
    """
    old = base.withColumn(date_column, F.lit(base_date).cast("date")).withColumn("__delta", F.lit(0))
    new = delta.withColumn(date_column, safe_date(F.col(date_column).cast("string"))).where(F.col(date_column).isNotNull()).withColumn("__delta", F.lit(1))
    order = [F.col(date_column).desc(), F.col("__delta").desc(), *(F.col(c).desc_nulls_last() for c in tie or [])]
    return latest_per_key(old.unionByName(new), [key], order).drop("__delta")


def unreadable_dates(delta: DataFrame, date_column: str = "load_date") -> DataFrame:
    """Rows of a delta that have no readable day, to be set aside."""
    return delta.where(safe_date(F.col(date_column).cast("string")).isNull())


def merge_partitions(spark: SparkSession, table: str, delta: DataFrame, key: str, *, date_column: str = "load_date", tie: list[str] | None = None) -> list[dict]:
    """Merges a delta into a partitioned table, last writer wins, and rewrites the touched partitions alone; returns those.

    Touched are the partitions that the delta's rows belong to, and those where
    the table holds rows of the delta's keys, which a scan of the key and the
    partition columns finds.  A row that moves leaves its old partition, and a
    partition that is left without rows is dropped.  Of a key's rows the one with
    the latest date stays; on equal days the delta beats the table and the columns
    in ``tie`` decide among the delta's own rows.  Rows of the delta whose day
    cannot be read are not merged: see ``unreadable_dates``.

    The merged partitions are stored in the shared folder before the table
    changes; a merge that was cut short is completed by running it again with the
    same delta.
    """
    target = spark.table(table)
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if not parts:
        raise ValueError(f"{table} has no partitions")
    readable = safe_date(F.col(date_column).cast("string"))
    new = delta.withColumn(date_column, readable.cast(target.schema[date_column].dataType)).where(F.col(date_column).isNotNull())
    new = new.select(*(F.col(c).cast(target.schema[c].dataType) for c in target.columns))
    holding = target.select(key, *parts).join(broadcast_if_small(new.select(key).distinct()), key, "left_semi").select(parts)
    touched = [r.asDict() for r in holding.unionByName(new.select(parts)).distinct().orderBy(*parts).collect()]  # as many as partitions at most
    if not touched:
        return []
    where = lambda p: functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.lit(v).cast(target.schema[c].dataType)) for c, v in p.items()))
    old = target.where(functools.reduce(operator.or_, map(where, touched)))
    order = [F.col(date_column).desc_nulls_last(), F.col("__delta").desc(), *(F.col(c).desc_nulls_last() for c in tie or [])]
    both = old.withColumn("__delta", F.lit(0)).unionByName(new.withColumn("__delta", F.lit(1)))
    scratch = Scratch(spark, "merge-partitions")
    merged = scratch.table("merged", latest_per_key(both, [key], order).drop("__delta"))  # a table cannot be read and replaced at once
    writers.replace_partitions(merged, table)
    left = [r.asDict() for r in merged.select(parts).distinct().collect()]
    for p in touched:
        if p not in left:
            writers.drop_partition(spark, table, p)
    scratch.drop()
    return touched
