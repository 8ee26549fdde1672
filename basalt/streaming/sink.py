"""A sink that holds one row per key, whatever is sent again.

Rows lie in buckets of the key's hash.  A batch rewrites the buckets that it
touches into the folder of a new version, from their latest state before it; the
state is each bucket's latest folder among the versions that were written to
their end.  So no file is read and replaced at once, a write that failed leaves
nothing that counts, and a batch that is run again, in whatever order and after
whatever lost checkpoint, changes nothing: per key the highest row wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.merge import latest_per_key
from basalt.streaming.messages import POSITION, dead_letters, parse, transform


class KeyedSink:
    """Rows of a schema by ``key``, the one with the highest ``order`` value winning; one writer at a time.

    With many buckets a batch of few keys rewrites little, and a bucket should
    fit a task: ``fitted`` deals a sink that has grown to more of them, and
    ``latest`` opens it with the number it has come to.  Folders
    that newer ones have replaced are removed after ``keep`` further versions,
    which is how long a reader of an earlier state may take.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *, key: str = "ID", order: str = "last_updated", buckets: int = 16, keep: int = 3):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.keep = spark, path, schema, key, order, buckets, keep

    def _found(self, pattern: str) -> list:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._root()}/{pattern}")
        return [s.getPath() for s in where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []]

    def _root(self) -> str:
        return f"{self.path}/buckets={self.buckets}"

    def _versions(self) -> list[int]:
        """Versions that were written to their end."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._found("version=*/_SUCCESS"))

    def _folders(self) -> dict[int, list[tuple[int, object]]]:
        """(version, folder) of each bucket, the latest last; at most ``buckets * keep`` and what the last version left."""
        done, out = set(self._versions()), {}
        for p in self._found("version=*/bucket=*"):
            version = int(p.getParent().getName().split("=")[1])
            if version in done:
                out.setdefault(int(p.getName().split("=")[1]), []).append((version, p))
        return {bucket: sorted(found, key=lambda f: f[0]) for bucket, found in out.items()}

    def _state(self, buckets: set[int] | None = None) -> DataFrame:
        latest = [str(found[-1][1]) for bucket, found in sorted(self._folders().items()) if buckets is None or bucket in buckets]
        return self.spark.read.schema(self.schema).parquet(*latest) if latest else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """What the sink holds."""
        return self._state()

    def upsert(self, batch: DataFrame) -> None:
        """Merges a batch; a batch may come again."""
        fields = [f.split() for f in self.schema.split(", ")]
        names = [n for n, _ in fields]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = batch.select(*(F.col(n).cast(kind).alias(n) for n, kind in fields))
        touched = {r[0] for r in fresh.select(bucket).distinct().collect()}  # at most one per bucket
        if not touched:
            return
        every = self._state(touched).select(*names).unionByName(fresh).withColumn("bucket", bucket)
        merged = latest_per_key(every, ["bucket", self.key], [F.col(self.order).desc_nulls_last(), F.xxhash64(*names)])
        number = (self._versions() or [-1])[-1] + 1
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._root()}/version={number}")
        self._forget(number)

    def _forget(self, now: int) -> None:
        """Removes folders that were replaced ``keep`` versions ago, and versions that hold no other folder."""
        drop = lambda folder: folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        used = {now}
        for found in self._folders().values():
            for (version, folder), (replaced, _) in zip(found, found[1:]):
                if replaced <= now - self.keep:
                    drop(folder)
                else:
                    used.add(version)
            used.add(found[-1][0])
        for marker in self._found("version=*/_SUCCESS"):
            if int(marker.getParent().getName().split("=")[1]) not in used:
                drop(marker.getParent())

    @classmethod
    def latest(cls, spark: SparkSession, path: str, schema: str, *, buckets: int = 16, **more) -> "KeyedSink":
        """The sink at a path with the most buckets that it has been dealt to; ``buckets`` if there is none yet."""
        found = cls(spark, path, schema, buckets=buckets, **more)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets=*/version=*/_SUCCESS")
        done = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        numbers = [int(s.getPath().getParent().getParent().getName().split("=")[1]) for s in done]
        found.buckets = max(numbers, default=buckets)
        return found

    def fitted(self, rows_per_bucket: int = 2_000_000) -> "KeyedSink":
        """This sink, or one of the same rows in the next power of two of buckets that hold ``rows_per_bucket`` at most on average."""
        wanted = 1 << max(-(-self.rows().count() // rows_per_bucket) - 1, 0).bit_length()
        return self.resize(wanted) if wanted > self.buckets else self

    def resize(self, buckets: int) -> "KeyedSink":
        """The sink with another number of buckets, holding the same rows; this one's folders stay until dropped."""
        other = KeyedSink(self.spark, self.path, self.schema, key=self.key, order=self.order, buckets=buckets, keep=self.keep)
        other.upsert(self.rows())
        return other


def consume_keyed(messages: DataFrame, sink: KeyedSink, dead_path: str, checkpoint: str, *, discount_category: str, discount: float, fmt: str = "json"):
    """Starts a stream of messages into the sink: valid ones are transformed, others set aside.

    What is set aside lies in a folder of the batch's number, as ``consume`` has
    it, and is written before the checkpoint moves on.
    """

    def one(batch: DataFrame, number: int) -> None:
        parsed = parse(batch).persist()
        try:
            if parsed.isEmpty():
                return
            good = parsed.where("valid").drop("value", "valid", "reason", *POSITION)
            sink.upsert(transform(good, discount_category=discount_category, discount=discount))
            dead_letters(parsed, number).write.mode("overwrite").format(fmt).save(f"{dead_path}/batch={number}")
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
