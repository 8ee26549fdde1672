"""Rates, profiles and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.columns import count_where, rate
from basalt.operators.joins import broadcast_if_small


def segment_rate(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]], condition: Column, *, top: int = 10, rows: str = "total_customers", hits: str = "churned_customers", share: str = "churn_rate") -> DataFrame:
    """Segments with the highest rate: (dimension, natural column, key) name the segment.

    The fact is summed up by its keys before names are joined, so dimensions
    meet one row per segment.  Ties go by the segment's names.
    """
    keys = [key for _, _, key in dimensions]
    names = [name for _, name, _ in dimensions]
    totals = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), count_where(condition).alias(hits))
    for dimension, name, key in dimensions:
        totals = totals.join(broadcast_if_small(dimension.select(key, name)), key)
    totals = totals.groupBy(*names).agg(F.sum(rows).alias(rows), F.sum(hits).alias(hits))
    return totals.select(*names, rows, hits, F.round(F.col(hits) / F.col(rows), 4).alias(share)).orderBy(F.col(share).desc(), *names).limit(top)


def profile(df: DataFrame, by: str, averages: list[tuple[str, int, str]], rows: str = "customers") -> DataFrame:
    """Count and rounded averages (column, digits, name) per group; missing values do not count."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(rows), *(F.round(F.avg(c), n).alias(name) for c, n, name in averages))


def rate_by(df: DataFrame, label: Column, condition: Column, *, name: str = "bucket", rows: str = "customers", hits: str = "churned", share: str = "churn_rate") -> DataFrame:
    """Count, hits and rate per value of an expression, highest rate first."""
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias(rows), count_where(condition).alias(hits), rate(condition).alias(share)).orderBy(F.col(share).desc(), name)


def average_where(df: DataFrame, column: str, condition: Column, digits: int = 2, name: str = "avg_value") -> DataFrame:
    """One rounded average over the rows that hold; filter and columns reach the scan."""
    return df.where(condition).agg(F.round(F.avg(column), digits).alias(name))


def inflate(df: DataFrame, doublings: int) -> DataFrame:
    """Every row ``2 ** doublings`` times, without a shuffle or a join."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(1 << doublings)))).drop("__copy")
