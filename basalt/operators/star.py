"""Star schema: dimensions with surrogate keys, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators.joins import SMALL_BYTES, SMALL_ROWS, broadcast_if_small, measured
from basalt.workspace import Scratch


def surrogate_keys(df: DataFrame, column: str, key: str, *, most: int = SMALL_ROWS) -> DataFrame:
    """Distinct values with int keys 1, 2, ... in the values' order; missing values have none.

    For a dimension that is made anew; ``extend_dimension`` keeps keys.  The
    values are found once and stored, for they are few and the source is not:
    joins and counts then read the stored table.
    """
    scratch = Scratch(df.sparkSession, "surrogate-keys")
    values = scratch.table("values", df.select(column).where(F.col(column).isNotNull()).distinct())
    return _numbered(values, column, key, 0, scratch, most)


def extend_dimension(spark: SparkSession, table: str, df: DataFrame, column: str, key: str, *, most: int = SMALL_ROWS) -> DataFrame:
    """The stored dimension, with keys for the values of ``df`` that it has not: (key, column).

    Keys are allocated and never recomputed: new values get the numbers after the
    highest key, in their order, and a value keeps its key whatever comes later,
    so that facts written before stay valid.  Only new values are written, in one
    commit; a run that was lost before it leaves nothing, and one that is run
    again finds no new value.  One writer at a time.  A table that does not exist
    yet is made; missing values have no key.
    """
    scratch = Scratch(spark, "extend-dimension")
    values = scratch.table("values", df.select(column).where(F.col(column).isNotNull()).distinct())
    last = 0
    if spark.catalog.tableExists(table):
        stored = spark.table(table)
        last = stored.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        values = scratch.table("fresh", values.join(broadcast_if_small(stored.select(column)), column, "left_anti"))
    fresh = _numbered(values, column, key, last, scratch, most)
    if not values.isEmpty() or not last:
        fresh.write.format("orc").mode("append").saveAsTable(table)
    return spark.table(table)


def _numbered(values: DataFrame, column: str, key: str, last: int, scratch: Scratch, most: int) -> DataFrame:
    """Stored values with int keys from ``last`` + 1 on, in their order.

    Up to ``most`` values are numbered by one window.  Beyond that, they are dealt
    out by range and numbered within, and the driver adds up the sizes of the
    ranges; the keys are the same.  More values than an int has numbers are an error.
    """
    spark = values.sparkSession
    rows, size = measured(values, most)
    if rows <= most:
        out = values.select((F.row_number().over(Window.orderBy(column)) + F.lit(last)).cast("int").alias(key), column)
        return F.broadcast(out) if rows <= SMALL_ROWS and size + 20 * rows <= SMALL_BYTES else out  # joins need not count it again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.table("placed", values.repartitionByRange(parts, column).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = last, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "__part int, __before long"))  # one row per shuffle partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return placed.withColumn("__in", inside).join(starts, "__part").select((F.col("__before") + F.col("__in")).cast("int").alias(key), column)


def build_fact(df: DataFrame, dimensions: list[tuple[DataFrame, str, str]], columns: list[str]) -> DataFrame:
    """Rows with the keys of their dimensions: (dimension, natural column, key).

    Inner joins: a row whose value no dimension has is left out, which
    ``missing_from_dimensions`` counts.
    """
    out = df
    for dimension, natural, key in dimensions:
        out = out.join(broadcast_if_small(dimension.select(key, natural)), natural)
    return out.select(*columns, *(key for _, _, key in dimensions))


def pruned_fact(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts of a filtered dimension, with its columns: a fact that is partitioned by ``key`` reads those partitions alone.

    Which they are is known only when the dimension has been read; Spark then
    prunes the fact's scan by the keys that it broadcasts for the join anyway.  A
    dimension that is too large to broadcast joins by shuffling, unpruned.
    """
    return fact.join(broadcast_if_small(dimension), key)


def missing_from_dimensions(df: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows that the fact leaves out."""
    found = None
    for dimension, natural, _ in dimensions:
        lost = df.join(broadcast_if_small(dimension.select(natural)), natural, "left_anti").select(df.columns)
        found = lost if found is None else found.unionByName(lost)
    return found.distinct()
