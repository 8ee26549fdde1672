"""Counts taken while writing, scans that skip, inserts by name, streams without copies."""

import pytest
from pyspark.sql import functions as F

from basalt.operators import quality
from basalt.plans import telecom
from basalt.sources import writers
from basalt.streaming import messages
from tests.test_telecom import customer, table


def test_promotion_counts_both_sides_in_one_scan(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def source(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    raw = spark.range(1000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN ' ' ELSE CAST(id AS string) END AS amount").mapInArrow(source, "id long, amount string")
    stage = lambda df: df.where("id % 10 <> 3").withColumn("amount", F.expr("try_cast(trim(amount) AS float)"))
    got = quality.promote(raw, stage, lambda df: df.write.parquet(str(tmp_path / "staged")), raw_checks={"blanks": F.trim("amount") == ""}, staged_checks={"nulls": F.col("amount").isNull()})
    assert got == {"raw_rows": 1000, "staged_rows": 900, "lost_rows": 100, "blanks": 143, "nulls": sum(i % 7 == 0 and i % 10 != 3 for i in range(1000))}
    assert read.value == 1000 and spark.read.parquet(str(tmp_path / "staged")).count() == 900
    none = quality.promote(raw.where("id < 0"), stage, lambda df: df.write.parquet(str(tmp_path / "none")))
    assert none == {"raw_rows": 0, "staged_rows": 0, "lost_rows": 0}


def test_churn_records_are_promoted(spark, tmp_path):
    raw = table(spark, [customer(i) for i in range(1, 21)] + [customer(30, TotalCharges=" "), customer(31, customerID="customerID", TotalCharges="TotalCharges")])
    assert telecom.promote(raw, str(tmp_path / "staged")) == {"raw_rows": 22, "staged_rows": 22, "lost_rows": 0, "header_rows": 1, "null_totalcharges": 2}


def test_churn_keys_and_contracts_are_kept(spark, tmp_path):
    first, later = table(spark, [customer(i) for i in range(1, 9)]), table(spark, [customer(40, Contract="A month", InternetService="Cable")])
    telecom.extend_dimensions(spark, first, "kept_")
    dims = telecom.extend_dimensions(spark, later, "kept_")
    got = {r["contract_name"]: r["contract_key"] for r in dims["dim_contract"].collect()}
    assert got["A month"] == max(got.values()) == len(got) and got["Month-to-month"] == 1
    telecom.publish_curated(telecom.stage(first).withColumn("load_date", F.lit("2026-03-01").cast("date")), "kept_curated")
    delta = table(spark, [customer(2, Contract="Two year", MonthlyCharges=1.0)]).withColumn("load_date", F.lit("2026-03-02"))
    touched = telecom.merge_curated(spark, "kept_curated", delta)
    assert {p["Contract"] for p in touched} == {"Month-to-month", "Two year"}
    assert [tuple(r) for r in spark.table("kept_curated").where("customerID = 'c002'").select("Contract", "MonthlyCharges").collect()] == [("Two year", 1.0)] and spark.table("kept_curated").count() == 8
    for name in ("kept_curated", *(f"kept_{d[0]}" for d in telecom.DIMENSIONS)):
        writers.drop_table(spark, name)


def scanned(df):
    """Rows that the scan of a plan has given."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan "):
            return node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_clustered_files_are_skipped_in_part(spark, tmp_path, fmt):
    n = 200_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("cluster"), F.concat(F.lit("k"), F.sha2(F.col("id").cast("string"), 256)).alias("name"), "id")
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    writers.write_files(rows.repartition(2), plain, fmt, **{"parquet.block.size": "1000000", "orc.stripe.size": "1000000"})
    writers.write_clustered(rows, clustered, fmt, cluster_by=["cluster"], lookup=["name"], parts=2, group_bytes=1_000_000)
    read = lambda path: spark.read.format(fmt).load(path)
    spark.conf.set("spark.sql.orc.filterPushdown", "true")
    assert read(clustered).exceptAll(rows).isEmpty() and read(clustered).count() == n
    by_cluster, name = "cluster = 77", rows.where("id = 4321").first()["name"]
    assert scanned(read(plain).where(by_cluster)) > 0.9 * n and scanned(read(clustered).where(by_cluster)) < 0.3 * n
    by_name = read(clustered).where(F.col("name") == name)
    assert scanned(by_name) < 0.4 * n and [r["id"] for r in by_name.collect()] == [4321]
    assert scanned(read(plain).where(F.col("name") == name)) > 0.9 * n
    assert read(clustered).where("name = 'none'").count() == 0


def test_inserts_go_by_name(spark):
    name = "by_name"
    spark.createDataFrame([(1, "a", 1.0)], "id bigint, label string, price double").write.format("parquet").saveAsTable(name)
    frame = lambda row, schema: spark.createDataFrame([row], schema)
    writers.insert_by_name(frame(("b", 2.5, 2), "label string, price float, ID int"), name)  # another order, types that fit
    for row, schema in [
        (("x", 3, 1.0), "id string, label int, price double"),  # swapped
        ((3, "c", "dear"), "id bigint, label string, price string"),
        ((3, "c", 1.0, 1), "id bigint, label string, price double, more int"),
        ((3, 4), "id bigint, ID bigint"),
        ((3.0, "c"), "id double, label string"),
    ]:
        with pytest.raises(ValueError):
            writers.insert_by_name(frame(row, schema), name)
    writers.add_columns(spark, name, "note string, amount int")
    writers.insert_by_name(frame((7, "new", 3), "amount int, note string, id bigint"), name)
    with pytest.raises(ValueError):
        writers.insert_by_name(frame((8, 5_000_000_000), "id bigint, amount bigint"), name)
    got = sorted(tuple(r) for r in spark.table(name).select(F.col("id"), F.coalesce("label", F.lit("~")), F.coalesce("price", F.lit(-1.0)), F.coalesce("note", F.lit("~")), F.coalesce("amount", F.lit(-1))).collect())
    assert got == [(1, "a", 1.0, "~", -1), (2, "b", 2.5, "~", -1), (3, "~", -1.0, "new", 7)]  # files of both schemas in one read
    writers.drop_table(spark, name)


def test_insert_by_name_keeps_the_layout(spark):
    writers.write_table(spark.range(30).selectExpr("id", "CAST(id % 3 AS string) AS p"), "by_name_parts", partition_by=["p"], buckets=2, bucket_by="id")
    writers.insert_by_name(spark.createDataFrame([("9", i) for i in range(100, 120)], "p string, id int"), "by_name_parts")
    assert spark.table("by_name_parts").where("p = '9'").count() == 20 and len(spark.table("by_name_parts").where("p = '9'").inputFiles()) == 2
    writers.drop_table(spark, "by_name_parts")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_copies_within_the_bound_come_once_and_state_shrinks(spark, tmp_path, kind):
    schema = f"id int, ts {kind}"

    def run(rows):
        """One file of new messages, in a new query over the old checkpoint."""
        spark.createDataFrame(rows, "id int, ts string").select("id", F.col("ts").cast(kind).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "topic"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "topic"))
        query = messages.deduplicate(source, ["id"], "ts", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return sorted(r["id"] for r in spark.read.schema(schema).parquet(str(tmp_path / "sink")).collect()), states[-1]

    at = lambda i, hour=10: (i, f"2026-01-01 {hour}:{i:02}:00")
    assert run([at(i) for i in range(20)] * 2 + [(99, None)])[0] == list(range(20))
    got, held = run([at(i) for i in range(15, 25)])  # replays within the bound, after a restart
    assert got == list(range(25))
    got, fewer = run([at(30, 12)])
    assert got == [*range(25), 30] and fewer < held
    assert run([at(3)])[0] == got  # older than the watermark: left out
