"""An increment by keyset: what lies beyond a pair (time, key), and what was committed late behind it.

A plain maximum of the time loses rows that are committed after the pull with a
time at or before the cursor.  Here a pull

1. takes an upper fence, the highest pair that is there;
2. reads once what lies between a look-back before the cursor and the fence,
   leaves out by (time, key) what was delivered before, and stores the rest;
3. hands the stored rows on, with the number of the run;
4. moves the cursor, together with the pairs of the look-back that have been delivered.

A crash before step 4 leaves the stored rows, and the next pull hands on just
those again under the same number; so a sink that replaces a run by its number
gets every row once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators.joins import broadcast_if_small
from basalt.streaming.cursor import CursorStore
from basalt.streaming.messages import keyed_json


def at_or_before(time: str, key: str, fence: tuple[Column, Column]) -> Column:
    """(time, key) <= fence, the comparison of the time alone apart, so that sources can skip by it."""
    return (F.col(time) <= fence[0]) & ((F.col(time) < fence[0]) | (F.col(key) <= fence[1]))


class KeysetCursor:
    """Cursor over a source with a time that rises when a row changes, and a key; one puller at a time.

    ``look_back`` tells how late a row may be committed: an interval ("2 hours")
    for dates, timestamps and text that reads as one, a number for numbers.
    Without it only the cursor's own time is read again.  Rows later than that
    are lost, as they are to any cursor; a row without a time or key is never
    beyond it; rows of one time and key are one change.
    """

    def __init__(self, spark: SparkSession, path: str, *, time: str, key: str, look_back: str | float | None = None):
        self.spark, self.path, self.time, self.key, self.look_back = spark, path, time, key, look_back
        self.store = CursorStore(spark, f"{path}/cursor")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def held(self) -> dict | None:
        """Number of the last run and the pair that it reached, as text."""
        text = self.store.read()
        return json.loads(text) if text else None

    def _pair(self, schema: T.StructType, held: dict) -> tuple[Column, Column]:
        return F.lit(held["time"]).cast(schema[self.time].dataType), F.lit(held["key"]).cast(schema[self.key].dataType)

    def _floor(self, schema: T.StructType, time: Column) -> Column:
        """The earliest time that is read again."""
        kind = schema[self.time].dataType
        if self.look_back is None:
            return time
        if isinstance(kind, T.NumericType):
            return (time - F.lit(self.look_back)).cast(kind)
        if isinstance(kind, T.StringType):
            return F.date_format(F.to_timestamp(time) - F.expr(f"INTERVAL {self.look_back}"), "yyyy-MM-dd HH:mm:ss")
        return (time - F.expr(f"INTERVAL {self.look_back}")).cast(kind)

    def _reached(self, df: DataFrame) -> dict | None:
        """The highest pair of a table."""
        pair = F.max(F.struct(F.col(self.time).alias("t"), F.col(self.key).alias("k")))
        row = df.where(F.col(self.time).isNotNull() & F.col(self.key).isNotNull()).agg(pair.alias("m")).select(F.col("m.t").cast("string"), F.col("m.k").cast("string")).first()
        return None if row[0] is None else {"time": row[0], "key": row[1]}

    def window(self, source: DataFrame, held: dict | None, fence: dict) -> DataFrame:
        """Rows up to the fence that have not been delivered; both bounds reach the source."""
        rows = source.where(at_or_before(self.time, self.key, self._pair(source.schema, fence)))
        if held is None:
            return rows
        rows = rows.where(F.col(self.time) >= self._floor(source.schema, self._pair(source.schema, held)[0]))
        done = self.spark.read.parquet(f"{self.path}/delivered/run={held['run']}")
        return rows.join(broadcast_if_small(done), [self.time, self.key], "left_anti").select(source.columns)

    def pull(self, source: DataFrame, write: Callable[[DataFrame, int], None]) -> int:
        """Hands new rows to ``write`` with the number of the run; returns that number, or 0 if there is no new row."""
        held = self.held()
        number = held["run"] + 1 if held else 1
        stored = f"{self.path}/stored/run={number}"
        if not self._files.exists(self._hadoop(f"{stored}/_SUCCESS")):  # else a run that was cut short goes on
            known = source if held is None else source.where(F.col(self.time) >= self._floor(source.schema, self._pair(source.schema, held)[0]))
            fence = self._reached(known)
            if fence is None:
                return 0
            self.window(source, held, fence).write.mode("overwrite").parquet(stored)
        fresh = self.spark.read.schema(source.schema).parquet(stored)
        reached = self._reached(fresh)
        if reached is None:
            self._drop(stored)
            return 0
        write(fresh, number)
        self._commit(fresh, held, reached, number)
        self._drop(stored)
        return number

    def _commit(self, fresh: DataFrame, held: dict | None, reached: dict, number: int) -> None:
        done = fresh.select(self.time, self.key)
        if held is not None:
            done = done.unionByName(self.spark.read.parquet(f"{self.path}/delivered/run={held['run']}"))
            cursor = self._pair(fresh.schema, held)
            if fresh.where(~at_or_before(self.time, self.key, cursor)).isEmpty():  # late rows alone: the cursor stays
                reached = {"time": held["time"], "key": held["key"]}
        floor = self._floor(fresh.schema, self._pair(fresh.schema, reached)[0])
        done.where(F.col(self.time) >= floor).distinct().write.mode("overwrite").parquet(f"{self.path}/delivered/run={number}")
        self.store.commit(json.dumps({"run": number, **reached}))
        if held is not None:
            self._drop(f"{self.path}/delivered/run={held['run']}")

    def _drop(self, folder: str) -> None:
        self._files.delete(self._hadoop(folder), True)

    def publish(self, source: DataFrame, key: str, write: Callable[[DataFrame, int], None]) -> int:
        """``pull`` with each row as a keyed message."""
        return self.pull(source, lambda rows, number: write(keyed_json(rows, key), number))
