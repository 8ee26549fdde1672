"""The churn lakehouse on invented customers: every dataflow, and the traps around it."""

import pytest
from pyspark.sql import functions as F

from basalt import schemas
from basalt.operators import merge, quality, star
from basalt.plans import telecom
from basalt.sources import readers, writers

CONTRACTS = ["Month-to-month", "One year", "Two year"]
SERVICES = ["DSL", "Fiber optic", "No"]
PAYMENTS = ["Bank transfer", "Credit card", "Electronic check", "Mailed check"]
NAMES = [f.split()[0] for f in schemas.TELECOM.replace("\n", " ").split(", ")]


def customer(number, **changes):
    row = dict.fromkeys(NAMES, "No")
    row |= {
        "customerID": f"c{number:03}", "gender": "F", "SeniorCitizen": 0, "tenure": number, "InternetService": SERVICES[number % 3], "Contract": CONTRACTS[number // 3 % 3],
        "PaymentMethod": PAYMENTS[number % 4], "MonthlyCharges": 20.0 + number, "TotalCharges": f"{20.5 * number}", "Churn": "Yes" if number % 2 else "No",
    }
    return row | changes


def table(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], schemas.TELECOM)


@pytest.fixture
def raw(spark):
    odd = [customer(90, TotalCharges=""), customer(91, TotalCharges=" "), customer(92, TotalCharges="abc"), customer(93, TotalCharges=None, tenure=0)]
    return table(spark, [customer(i) for i in range(1, 37)] + odd)


def test_landing_reads_by_position_and_forgives_types(spark, tmp_path):
    good = ["c1"] + ["x"] + ["1"] + ["Yes"] * 2 + ["7"] + ["No"] * 12 + ["70.5", "", "Yes"]
    bad = ["c2"] + ["x"] + ["many"] + ["Yes"] * 2 + ["?"] + ["No"] * 12 + ["dear", "12", "No"]
    (tmp_path / "a.csv").write_text("\n".join([",".join(NAMES), ",".join(good), ",".join(bad)]))
    got = {r["customerID"]: r for r in telecom.land(spark, str(tmp_path)).collect()}
    assert got["c1"]["tenure"] == 7 and got["c1"]["TotalCharges"] is None
    assert got["c2"]["SeniorCitizen"] is None and got["c2"]["tenure"] is None and got["c2"]["MonthlyCharges"] is None
    with_header = telecom.land(spark, str(tmp_path), header=False)
    assert quality.header_rows(with_header).count() == 1 and with_header.count() == 3


def test_raw_checks(spark, raw):
    doubled = raw.unionByName(table(spark, [customer(1)]))
    checks = telecom.check_raw(doubled)
    assert [tuple(r) for r in checks["duplicate_ids"].collect()] == [("c001", 2)]
    assert checks["blank_totals"].first()[0] == 3
    assert checks["header_rows"].count() == 0
    assert checks["rows"].first()["row_count"] == 41


def test_staging_casts_safely_and_loses_no_row(raw):
    staged = telecom.stage(raw)
    assert staged.schema["TotalCharges"].dataType.simpleString() == "float"
    assert staged.count() == raw.count()
    assert {r["customerID"] for r in staged.where("TotalCharges IS NULL").collect()} == {"c090", "c091", "c092", "c093"}


def test_curated_is_replaced_in_full(spark, raw):
    staged = telecom.stage(raw)
    for _ in range(2):
        telecom.publish_curated(staged, "curated")
    assert spark.table("curated").count() == staged.count()
    moved = staged.withColumn("Contract", F.when(F.col("Contract") == "Two year", "One year").otherwise(F.col("Contract")))
    telecom.publish_curated(moved, "curated")
    assert spark.table("curated").count() == staged.count()
    assert {r[0] for r in telecom.contract_values(spark.table("curated")).collect()} == set(CONTRACTS[:2])
    said = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED curated").collect()}
    assert said["Num Buckets"] == "4"
    plan = spark.table("curated").where("Contract = 'One year'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Contract" in plan


def test_deltas_replace_add_and_win_ties(spark, raw):
    staged = telecom.stage(raw)
    rows = [
        customer(1, Contract="Two year") | {"load_date": "2026-03-02"}, customer(200) | {"load_date": "2026-03-02"}, customer(2, Churn="tie") | {"load_date": "2026-03-01"},
        customer(3, TotalCharges="oops") | {"load_date": "2026-03-05"}, customer(3, TotalCharges="1") | {"load_date": "2026-03-04"}, customer(4, Churn="lost") | {"load_date": "soon"},
        customer(5, Churn="old") | {"load_date": "2026-02-01"}, customer(6, tenure=50) | {"load_date": "2026-03-02"}, customer(6, tenure=60) | {"load_date": "2026-03-02"},
    ]
    delta = spark.createDataFrame([tuple(r[n] for n in [*NAMES, "load_date"]) for r in rows], schemas.TELECOM_DELTA)
    got = {r["customerID"]: r for r in telecom.merge_deltas(staged, delta).collect()}
    assert len(got) == staged.count() + 1
    assert got["c001"]["Contract"] == "Two year" and got["c200"]["tenure"] == 200 and got["c002"]["Churn"] == "tie"
    assert got["c003"]["TotalCharges"] is None and str(got["c003"]["load_date"]) == "2026-03-05"
    assert got["c004"]["Churn"] == "No" and got["c005"]["Churn"] == "Yes" and got["c006"]["tenure"] == 60
    assert merge.unreadable_dates(delta).count() == 1
    again = {r["customerID"]: r for r in telecom.merge_deltas(staged, delta).collect()}
    assert again == got


def test_star_and_answers(spark, raw):
    staged = telecom.stage(raw)
    dims = telecom.build_dimensions(staged)
    assert [tuple(r) for r in dims["dim_contract"].orderBy("contract_key").collect()] == [(i + 1, c) for i, c in enumerate(CONTRACTS)]
    assert {n: d.count() for n, d in dims.items()} == {"dim_contract": 3, "dim_payment": 4, "dim_service_type": 3}
    lost = staged.unionByName(telecom.stage(table(spark, [customer(300, Contract=None)])))
    fact = telecom.build_fact(lost, dims)
    assert fact.columns == ["customerID", "contract_key", "payment_key", "service_key", "tenure", "MonthlyCharges", "TotalCharges", "Churn"]
    assert fact.count() == staged.count() == lost.count() - 1
    linked = [(dims[t].withColumnRenamed(name, natural), natural, key) for t, natural, key, name in telecom.DIMENSIONS]
    assert star.missing_from_dimensions(lost, linked).count() == 1
    top = telecom.churn_by_segment(fact, dims).collect()
    assert len(top) == 10 and [(-r["churn_rate"], r["contract_name"]) for r in top] == sorted((-r["churn_rate"], r["contract_name"]) for r in top)
    assert sum(r["total_customers"] for r in telecom.churn_by_segment(fact, dims, top=100).collect()) == fact.count()
    by_churn = {r["Churn"]: r for r in telecom.churn_profile(fact).collect()}
    stayed = [r for r in staged.collect() if r["Churn"] == "No"]
    assert by_churn["No"]["avg_tenure"] == round(sum(r["tenure"] for r in stayed) / len(stayed), 1)
    telecom.publish_fact(fact, "fact_by_contract")
    assert spark.table("fact_by_contract").where("contract_key = 1").count() == fact.where("contract_key = 1").count()


def test_tenure_edges(spark):
    months = [0, 12, 13, 24, 25, 60, 61, None, -1]
    rows = spark.createDataFrame([(m, "Yes") for m in months], "tenure int, Churn string")
    got = {r["tenure_bucket"]: r["customers"] for r in telecom.churn_by_tenure(rows).collect()}
    assert got == {"0–12 months": 2, "13–24 months": 2, "25–36 months": 1, "49–60 months": 1, "60+ months": 3}


def test_formats_agree_and_inflate(spark, raw, tmp_path):
    answers = {r["avg_monthly"] for r in telecom.compare_formats(spark, telecom.stage(raw), str(tmp_path), doublings=3).collect()}
    assert len(answers) == 1
    assert spark.read.orc(str(tmp_path / "orc")).count() == raw.count() * 8


def test_many_surrogate_keys_follow_the_values_order(spark):
    values = spark.range(500).select(F.format_string("v%04d", "id").alias("v"))
    got = star.surrogate_keys(values, "v", "k", most=50).orderBy("v").collect()
    assert [r["k"] for r in got] == list(range(1, 501))


def test_quality_log(spark, raw):
    staged = telecom.stage(raw).unionByName(telecom.stage(table(spark, [customer(1), customer(400, customerID=None)])))
    row = telecom.log_quality(staged, "telecom_staging", "2026-03-03")
    assert tuple(row.first()) == ("2026-03-03", "telecom_staging", 42, 4, 2)
    assert quality.metrics(staged, "t", "d", null_column="TotalCharges", key="customerID").first()["null_keys"] == 1
    quality.append_log(row, "dq_log")
    quality.append_log(row.withColumn("row_count", F.lit(7).cast("bigint")), "dq_log")
    assert quality.latest_run(spark.table("dq_log")).first()["row_count"] == 7
    writers.add_columns(spark, "dq_log", "note string")
    assert spark.table("dq_log").where("note IS NULL").count() == 2
    writers.drop_table(spark, "dq_log")
    writers.drop_table(spark, "dq_log")


def test_alerts(spark):
    day = lambda t, d, n: (t, d, n)
    log = spark.createDataFrame([
        day("zero", "2026-03-02", 0), day("zero", "2026-03-03", 5), day("just", "2026-03-02", 1000), day("just", "2026-03-03", 900), day("over", "2026-03-02", 1000), day("over", "2026-03-03", 899),
        day("gone", "2026-03-02", 3), day("gap", "2026-02-01", 100), day("gap", "2026-03-03", 50),
    ], "table_name string, run_date string, row_count bigint")
    assert [r["table_name"] for r in quality.anomalies(log, "2026-03-03", "2026-03-02").collect()] == ["over"]
    log.createOrReplaceTempView("quality_log")
    assert [r["table_name"] for r in quality.anomalies_sql(spark, "quality_log", "2026-03-03", "2026-03-02").collect()] == ["over"]
    assert sorted(r["table_name"] for r in quality.anomalies_since_last(log).collect()) == ["gap", "over"]
    assert [r["table_name"] for r in quality.missing_tables(log, "2026-03-03", "2026-03-02").collect()] == ["gone"]
    assert [r["run_date"] for r in quality.audit_history(log, "gap").collect()] == ["2026-03-03", "2026-02-01"]


def test_table_statistics(spark):
    writers.use_database(spark, "basalt_stats")
    writers.write_table(spark.range(100), "numbers")
    stats = writers.table_statistics(spark, "numbers")
    assert stats["rows"] == 100 and stats["bytes"] > 0 and stats["files"] >= 1
    spark.catalog.setCurrentDatabase("default")


def test_reference_tables(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("Date\r\n1/1/2015\r\n12/31/2016\r\n")
    (tmp_path / "cat.csv").write_text("ProductCategoryKey,CategoryName\r\n1,Bikes\r\n")
    (tmp_path / "sub.csv").write_text("ProductSubcategoryKey,SubcategoryName,ProductCategoryKey\r\n5,Road,1\r\n6,Odd,9\r\n")
    (tmp_path / "ter.csv").write_text("SalesTerritoryKey,Region,Country,Continent\r\n1,North,X,Y\r\n")
    assert [str(r[0]) for r in readers.read_calendar(spark, str(tmp_path / "cal.csv")).collect()] == ["2015-01-01", "2016-12-31"]
    found = {r["SubcategoryName"]: r["CategoryName"] for r in readers.read_product_hierarchy(spark, str(tmp_path / "sub.csv"), str(tmp_path / "cat.csv")).collect()}
    assert found == {"Road": "Bikes", "Odd": None}
    assert readers.read_territories(spark, str(tmp_path / "ter.csv")).first()["Continent"] == "Y"
