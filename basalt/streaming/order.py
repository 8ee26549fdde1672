"""The order of a key's messages: numbers that a producer gives and a consumer checks.

Numbers and neighbours within a key are found over ranges of (key, order), so a
key that has a third of all rows is dealt to many tasks: each range is numbered
by itself, and what lies before it is a sum over the few rows (key, range).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.workspace import Scratch

_PART = "__part"


def _placed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with a key, stored with the number of their range by (key, order)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(key).isNotNull()).repartitionByRange(parts, key, *order)
    return Scratch(spark, "ordered").table("placed", ranged.withColumn(_PART, F.spark_partition_id()))


def numbered(df: DataFrame, key: str, order: list[str], *, name: str = "seq", last: DataFrame | None = None) -> DataFrame:
    """Rows with their number within their key, by ``order``: 1, 2, ... or what follows ``last`` (key, last).

    ``order`` should tell a key's rows apart; equal ones are numbered in any
    order.  Rows without a key have no order and are left out.
    """
    placed = _placed(df, key, order)
    counts = placed.groupBy(key, _PART).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(key).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    if last is not None:
        held = last.select(F.col(key), F.col("last").alias("__last"))
        counts = counts.join(held, key, "left").withColumn("__before", F.col("__before") + F.coalesce("__last", F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(_PART, key).orderBy(*order))
    ranked = placed.withColumn("__inside", inside).join(counts.select(key, _PART, "__before"), [_PART, key])
    return ranked.select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name))


def order_faults(df: DataFrame, key: str, position: list[str], *, seq: str = "seq", first: int | None = 1) -> DataFrame:
    """Where a key's numbers do not follow each other in the order of arrival: (key, position..., expected, seq, fault).

    ``gap``: numbers are missing before this one; ``again``: one at or before the
    last.  ``first`` is the number that a key must start with, None for any.
    """
    placed = _placed(df.select(key, *position, seq), key, position)
    ends = placed.groupBy(key, _PART).agg(F.max_by(seq, F.struct(*position)).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(key).orderBy(_PART)))
    before = F.lag(seq).over(Window.partitionBy(_PART, key).orderBy(*position))
    known = placed.withColumn("__before", before).join(ends, [_PART, key])
    expected = F.coalesce(F.col("__before"), F.col("__end")) + 1
    if first is not None:
        expected = F.coalesce(expected, F.lit(first).cast("long"))
    found = known.select(key, *position, expected.alias("expected"), F.col(seq).alias("seq"))
    return found.where("seq <> expected").withColumn("fault", F.when(F.col("seq") > F.col("expected"), "gap").otherwise("again"))


def missing_numbers(df: DataFrame, key: str, *, seq: str = "seq") -> DataFrame:
    """Keys whose numbers from 1 to their highest did not all arrive: (key, last, missing); whatever the order of arrival."""
    held = df.groupBy(key, seq).agg(F.lit(1).alias("one")).groupBy(key).agg(F.max(seq).alias("last"), F.count("one").alias("__held"))
    return held.where("last > __held").select(key, "last", (F.col("last") - F.col("__held")).alias("missing"))


class OrderedPublisher:
    """Publishes runs of rows as keyed messages whose numbers go on from run to run; one publisher at a time.

    Messages are dealt out by key and leave each task by ``order``, so that a
    sink that keeps the order of its writers (a topic's partition, a file) holds
    each key's messages in order.  The last number of each key of a run is stored
    before the run is sent: a run that is sent again has the same numbers.  After
    ``compact`` runs the numbers of all are united.
    """

    def __init__(self, spark: SparkSession, path: str, *, key: str, order: list[str], partitions: int = 10, compact: int = 16):
        self.spark, self.path, self.key, self.order, self.partitions, self.compact = spark, path, key, order, partitions, compact
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[int]:
        """Runs whose numbers were stored to the end."""
        found = self._files.globStatus(self._hadoop(f"{self.path}/run=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def last(self, before: int) -> DataFrame | None:
        """The highest number of each key in the runs before one."""
        runs = [r for r in self._runs() if r < before]
        if not runs:
            return None
        held = self.spark.read.parquet(*(f"{self.path}/run={r}" for r in runs))
        return held.groupBy(self.key).agg(F.max("last").alias("last"))

    def messages(self, rows: DataFrame, run: int) -> DataFrame:
        """Key, value and number of the messages of a run (1, 2, ...), in order within each task."""
        last = self.last(run)
        placed = Scratch(self.spark, "published").table("numbered", numbered(rows, self.key, self.order, last=last))
        reached = placed.groupBy(self.key).agg(F.max("seq").alias("last"))
        united = last is not None and run % self.compact == 0
        if united:
            reached = reached.unionByName(last).groupBy(self.key).agg(F.max("last").alias("last"))
        reached.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        if united:
            for old in self._runs():
                if old < run - self.compact:  # earlier runs are still needed to send one of the latest again
                    self._files.delete(self._hadoop(f"{self.path}/run={old}"), True)
        dealt = placed.repartition(self.partitions, self.key).sortWithinPartitions(*self.order, "seq")
        return dealt.select(F.col(self.key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), "seq")

    def publish(self, rows: DataFrame, run: int, write: Callable[[DataFrame], None]) -> None:
        write(self.messages(rows, run))


def column_of(field: str, kind: str) -> Column:
    """A field of a message's value."""
    return F.get_json_object("value", f"$.{field}").cast(kind)
