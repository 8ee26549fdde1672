"""Keys that stay, partitions that stay, joins without sorting, scans that skip partitions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from basalt.operators import merge, star
from basalt.sources import readers, writers


def files(spark, table):
    """Each file of a table with its time."""
    return {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in spark.table(table).inputFiles()}


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


@pytest.mark.parametrize("most", [1000, 2])  # one window, or ranges
def test_keys_are_allocated_and_stay(spark, most):
    name = f"dim_kept_{most}"
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "v string")
    extend = lambda *values: {r["v"]: r["k"] for r in star.extend_dimension(spark, name, frame(*values), "v", "k", most=most).collect()}
    assert extend() == {}
    assert extend("m", "d", None, "m", "x") == {"d": 1, "m": 2, "x": 3}
    before = files(spark, name)
    assert extend("x", "d") == {"d": 1, "m": 2, "x": 3} and files(spark, name) == before  # nothing new, nothing written
    assert extend("a", "zz", "d", "b") == {"d": 1, "m": 2, "x": 3, "a": 4, "b": 5, "zz": 6}  # values that sort first change no key
    assert set(before) < set(files(spark, name))
    assert spark.table(name).dtypes == [("k", "int"), ("v", "string")]
    writers.drop_table(spark, name)


def test_a_partitioned_fact_stays_valid_when_its_dimension_grows(spark):
    rows = lambda ids, values: spark.createDataFrame([(i, values[i % len(values)]) for i in ids], "id int, contract string")
    first, later = rows(range(30), ["month", "year"]), rows(range(30, 60), ["biennial", "month", "adhoc"])
    dim = star.extend_dimension(spark, "dim_grown", first, "contract", "contract_key")
    fact = lambda source, dim: star.build_fact(source, [(dim, "contract", "contract_key")], ["id"])
    writers.write_table(fact(first, dim), "fact_grown", partition_by=["contract_key"], buckets=2, bucket_by="id")
    before = files(spark, "fact_grown")
    dim = star.extend_dimension(spark, "dim_grown", later, "contract", "contract_key")
    fact(later, dim).select(spark.table("fact_grown").columns).write.insertInto("fact_grown")
    got = {r["id"]: r["contract"] for r in spark.table("fact_grown").join(dim, "contract_key").collect()}
    assert got == {r["id"]: r["contract"] for r in first.union(later).collect()}
    after = files(spark, "fact_grown")
    assert all(after[f] == t for f, t in before.items())
    for name in ("dim_grown", "fact_grown"):
        writers.drop_table(spark, name)


def partitioned(spark, name, **layout):
    rows = spark.range(1000).select("id", (F.col("id") * 1.0).alias("x"), F.lit("2026-01-01").cast("date").alias("load_date"), (F.col("id") % 5).cast("string").alias("p"))
    writers.write_table(rows, name, partition_by=["p"], **layout)
    return {r["id"]: (r["x"], r["p"]) for r in rows.collect()}


@pytest.mark.parametrize("layout", [{}, {"buckets": 3, "bucket_by": "id"}])
def test_a_merge_rewrites_touched_partitions_alone(spark, layout):
    expected = partitioned(spark, "merged_parts", **layout)
    before = files(spark, "merged_parts")
    delta = [(5 * i, -1.0, "2026-01-02", "9") for i in range(200)] + [(1, 7.0, "2026-01-02", "2"), (2000, 8.0, "2026-01-02", "2"), (1, 6.0, "2026-01-02", "1"), (3, 9.0, "soon", "3"), (6, 0.0, "2025-01-01", "1")]
    delta = spark.createDataFrame(delta, "id long, x double, load_date string, p string")
    for _ in range(2):  # run again after a crash
        touched = merge.merge_partitions(spark, "merged_parts", delta, "id", tie=["x"])
        expected |= {5 * i: (-1.0, "9") for i in range(200)} | {1: (7.0, "2"), 2000: (8.0, "2")}
        got = spark.table("merged_parts").collect()
        assert len(got) == len(expected) and {r["id"]: (r["x"], r["p"]) for r in got} == expected
    assert {p["p"] for p in touched} == {"1", "2", "9"}
    after = files(spark, "merged_parts")
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("p=")[1][0] for f in kept} == {"3", "4"} and kept == {f for f in before if f.split("p=")[1][0] in "34"}
    assert not any("/p=0/" in f for f in after)  # emptied
    if layout:
        assert all(sum(f"/p={p}/" in f for f in after) == 3 for p in "12349")
    assert merge.merge_partitions(spark, "merged_parts", delta.limit(0), "id") == []
    writers.drop_table(spark, "merged_parts")


def test_partitions_of_nulls_and_of_types(spark):
    rows = spark.createDataFrame([(1, "2026-01-01", None, 1), (2, "2026-01-01", "a b='c", 1), (3, "2026-01-01", "d", 2)], "id int, load_date string, p string, q int")
    writers.write_table(rows.withColumn("load_date", F.col("load_date").cast("date")), "odd_parts", partition_by=["p", "q"])
    delta = spark.createDataFrame([(1, "2026-01-02", "d", 2), (2, "2026-01-02", None, 7)], "id int, load_date string, p string, q int")
    assert len(merge.merge_partitions(spark, "odd_parts", delta, "id")) == 4
    assert sorted(tuple(r) for r in spark.table("odd_parts").select("id", F.coalesce("p", F.lit("~")), "q").collect()) == [(1, "d", 2), (2, "~", 7), (3, "d", 2)]
    writers.drop_table(spark, "odd_parts")
    spark.range(3).write.format("orc").saveAsTable("no_parts")
    with pytest.raises(ValueError):
        merge.merge_partitions(spark, "no_parts", delta, "id")
    writers.drop_table(spark, "no_parts")


def test_a_static_table_is_not_overwritten_in_part(spark):
    spark.createDataFrame([(1, "a")], "id int, p string").write.format("orc").partitionBy("p").option("partitionOverwriteMode", "static").saveAsTable("static_parts")
    with pytest.raises(ValueError):
        writers.replace_partitions(spark.createDataFrame([(2, "b")], "id int, p string"), "static_parts")
    writers.drop_table(spark, "static_parts")


@pytest.mark.parametrize("right", [8, 4, 16])
def test_bucketed_tables_join_without_sorting(spark, right):
    left_rows, right_rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), spark.range(0, 20_000, 3).select(F.col("id").alias("k"), (F.col("id") * 5).alias("w"))
    writers.write_table(left_rows, "join_left", buckets=8, bucket_by="k")
    writers.write_table(right_rows, "join_right", buckets=right, bucket_by="k")
    session = readers.bucketed_session(spark)
    joined = session.table("join_left").join(session.table("join_right"), "k")
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Sort [") == (0 if right == 8 else 1)  # a merged bucket is more than one file: that side alone is sorted
    assert ("Coalesced to" in text) == (right != 8)
    assert sorted(map(tuple, joined.collect())) == [(k, 2 * k, 5 * k) for k in range(0, 20_000, 3)]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"  # the caller's session is as it was
    spark.range(50_000, 50_010).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")).write.insertInto("join_left")  # buckets of two files are sorted again, and right
    joined = readers.bucketed_session(spark).table("join_left").join(session.table("join_right"), "k")
    assert joined.count() == 6667
    for name in ("join_left", "join_right"):
        writers.drop_table(spark, name)


def test_buckets_follow_the_size(spark):
    rows = spark.range(1 << 16)  # 8 bytes each
    assert [writers.buckets_for(rows, n) for n in (1 << 19, 1 << 18, (1 << 18) - 1, 1 << 40)] == [1, 2, 4, 1]


def read_files(df):
    """How many files the scans of a plan that has run have read."""
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan orc") and "fact_pruned" in node.toString():
            found += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_filtered_dimension_prunes_the_facts_partitions(spark):
    rows = spark.range(400).select("id", F.concat(F.lit("v"), F.col("id") % 10).alias("v"))
    dim = star.extend_dimension(spark, "dim_pruned", rows, "v", "k")
    writers.write_table(star.build_fact(rows, [(dim, "v", "k")], ["id"]), "fact_pruned", partition_by=["k"], buckets=2, bucket_by="id")
    assert len(glob.glob(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/fact_pruned/k=*")) == 10
    some = star.pruned_fact(spark.table("fact_pruned"), dim.where("v IN ('v3', 'v7')"), "k")
    assert "dynamicpruning" in plan(some) and read_files(some) == 4  # metrics are those of the first run
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(400) if i % 10 in (3, 7)]
    every = star.pruned_fact(spark.table("fact_pruned"), dim, "k")
    assert every.count() == 400 and "dynamicpruning" not in plan(every) and read_files(every) == 20
    for name in ("dim_pruned", "fact_pruned"):
        writers.drop_table(spark, name)
