"""Files and tasks of written tables, counted without adaptive merging."""

import os
import re

import pytest
from pyspark.sql import functions as F

from basalt.operators import joins, star
from basalt.sources import writers


@pytest.fixture
def plain(spark):
    """64 shuffle partitions and no adaptive merging."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def files(spark, table):
    return [os.path.basename(f) for f in spark.table(table).inputFiles()]


def test_each_bucket_of_a_partition_is_one_file(plain):
    rows = plain.range(20_000).select("id", F.concat(F.lit("p"), F.col("id") % 3).alias("part"))
    writers.write_table(rows, "bucketed_parts", partition_by=["part"], buckets=4, bucket_by="id")
    assert len(files(plain, "bucketed_parts")) == 12 and plain.table("bucketed_parts").count() == 20_000
    writers.write_table(rows, "bucketed_alone", buckets=8, bucket_by="id")
    numbers = sorted(re.search(r"_(\d{5})\.", f).group(1) for f in files(plain, "bucketed_alone"))
    assert numbers == [f"{i:05}" for i in range(8)]
    for name in ("bucketed_parts", "bucketed_alone"):
        writers.drop_table(plain, name)


def test_equal_rows_and_maps_are_spread(plain):
    rows = plain.range(0, 20_000, 1, 8).select(F.lit(1).alias("x"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.lit("one").alias("part"))
    writers.write_table(rows, "salted_equal", partition_by=["part"], writers=4)
    assert len(files(plain, "salted_equal")) > 1 and plain.table("salted_equal").count() == 20_000
    writers.drop_table(plain, "salted_equal")


def test_a_partition_is_written_by_several_tasks_if_it_is_large(plain):
    rows = plain.range(20_000).select("id", F.lit("one").alias("part"))
    for tasks in (1, 6):
        writers.write_table(rows, "salted", partition_by=["part"], writers=tasks)
        assert 1 <= len(files(plain, "salted")) <= tasks and (tasks == 1 or len(files(plain, "salted")) > 1)
        assert plain.table("salted").agg(F.countDistinct("id")).first()[0] == 20_000
    assert writers.writers_for(rows) == 1 and 1 < writers.writers_for(rows, 10_000) <= 64
    writers.drop_table(plain, "salted")


@pytest.mark.parametrize("key", ["id % 500", "7", "if(id % 10 = 0, id, 7)", "NULL"])  # even, hot, half hot, none
@pytest.mark.parametrize("other", ["id", "1"])  # rows that differ, rows that are equal
def test_clustered_files_are_of_bounded_size(spark, tmp_path, monkeypatch, key, other):
    """Two million narrow rows are few bytes and much to sort; nor may one key's rows be a task."""
    monkeypatch.setattr(writers, "TASK_ROWS", 3000, raising=False)
    rows = spark.range(0, 20_000, 1, 16).selectExpr(f"CAST({key} AS bigint) AS k", f"CAST({other} AS bigint) AS v")
    writers.write_clustered(rows, str(tmp_path / "lies"), cluster_by=["k"], lookup=["v"])
    lies = spark.read.parquet(str(tmp_path / "lies"))
    assert lies.exceptAll(rows).isEmpty() and lies.count() == 20_000
    found = lies.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()
    assert len(found) >= 6 and max(r["n"] for r in found) < 6000
    ranges = sorted((r["low"], r["high"]) for r in found if r["low"] is not None)
    assert all(high <= low for (_, high), (low, _) in zip(ranges, ranges[1:]))


def test_tasks_and_buckets_go_by_counted_rows(plain, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "TASK_ROWS", 3000, raising=False)
    plain.range(0, 20_000, 1, 8).selectExpr("CAST(1 AS bigint) AS id", "'one' AS part").coalesce(1).write.parquet(str(tmp_path / "packed"))
    packed = plain.read.parquet(str(tmp_path / "packed"))  # some hundred bytes
    assert writers.writers_for(packed) == 7 and writers.buckets_for(packed) == 8
    spread = plain.range(0, 20_000, 1, 1).selectExpr("id", "'one' AS part")  # one task reads all
    writers.write_table(spread, "counted_parts", partition_by=["part"])
    sizes = [r["count"] for r in plain.table("counted_parts").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 12_000
    plain.conf.set("spark.sql.adaptive.enabled", "true")
    writers.write_table(spread, "counted_parts", partition_by=["part"])  # not merged again
    assert len(files(plain, "counted_parts")) == len(sizes)
    writers.drop_table(plain, "counted_parts")


def test_table_size_is_of_values(spark):
    rows = spark.createDataFrame([("ab", bytearray(b"xyz"), 1, [1, 2]), (None, None, None, None), ("ü" * 1000, bytearray(b""), 2, [])], "s string, `b.b` binary, i int, a array<int>")
    assert writers.table_size(rows.select("s", "`b.b`", "i")) == (3, 3 * 24 + 2 + 2000 + 3)
    assert writers.table_size(rows.select("a"))[1] > 24
    assert writers.table_size(rows.limit(0)) == (0, 0) and writers.table_size(spark.range(5)) == (5, 40)


def test_each_bucket_has_a_task_of_its_own(plain):
    writers.write_table(plain.range(20_000), "bucket_tasks", buckets=16, bucket_by="id")
    numbers = [re.match(r"part-(\d{5}).*_(\d{5})\.", f).groups() for f in files(plain, "bucket_tasks")]
    assert len(numbers) == 16 and all(task == bucket for task, bucket in numbers)
    writers.drop_table(plain, "bucket_tasks")


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    few = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("v"))
    assert hinted(joins.broadcast_if_small(few)) and hinted(joins.broadcast_if_small(few.limit(0)))
    sized = F.broadcast(few).select("v")  # its size was known when it was made: no job
    assert joins.is_hinted(sized) and hinted(joins.broadcast_if_small(sized, most=1)) and not joins.is_hinted(few.where("v = 'x'"))
    assert joins.is_hinted(star.surrogate_keys(few, "v", "k").withColumnRenamed("v", "w").select("w", "k"))
    assert not hinted(joins.broadcast_if_small(few, most=9)) and not hinted(joins.broadcast_if_small(few, most_bytes=5000))


def test_surrogate_keys_have_one_type_at_any_size(spark):
    values = spark.range(300).select(F.format_string("v%04d", "id").alias("v"))
    few, many = (star.surrogate_keys(values, "v", "k", most=n) for n in (1000, 50))
    assert few.dtypes == many.dtypes and few.dtypes[0] == ("k", "int")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
