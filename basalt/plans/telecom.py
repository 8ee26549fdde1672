"""The customer-churn lakehouse: raw, staging, curated, star, answers, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt import schemas
from basalt.functions.columns import safe_float, tenure_bucket
from basalt.operators import analytics, merge, quality, star
from basalt.sources.readers import read_text
from basalt.sources.writers import write_files, write_table

#: (dimension table, natural column, key, name of the column in the dimension)
DIMENSIONS = [("dim_contract", "Contract", "contract_key", "contract_name"), ("dim_payment", "PaymentMethod", "payment_key", "payment_method"), ("dim_service_type", "InternetService", "service_key", "internet_service")]
MEASURES = ["customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn"]


def churned() -> Column:
    return F.col("Churn") == "Yes"


def land(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """Raw records as they were delivered."""
    return read_text(spark, path, schemas.TELECOM, header=header)


def land_delta(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """Raw changes, each with its load date."""
    return read_text(spark, path, schemas.TELECOM_DELTA, header=header)


def check_raw(raw: DataFrame) -> dict[str, DataFrame]:
    """Checks before promotion: repeated ids, missing totals, header lines, rows."""
    return {
        "duplicate_ids": quality.duplicate_keys(raw, ["customerID"]),
        "blank_totals": quality.blank_count(raw, "TotalCharges"),
        "header_rows": quality.header_rows(raw),
        "rows": quality.reconcile(raw=raw),
    }


def stage(raw: DataFrame) -> DataFrame:
    """Typed records: the total as FLOAT, missing where it is blank or no number."""
    return raw.withColumn("TotalCharges", safe_float(F.col("TotalCharges")))


def promote(raw: DataFrame, path: str) -> dict[str, int]:
    """Stages the raw records as ORC; rows on both sides, header lines and missing totals, counted while they are written."""
    header = F.col("customerID") == "customerID"
    return quality.promote(raw, stage, lambda df: write_files(df, path), raw_checks={"header_rows": header}, staged_checks={"null_totalcharges": F.col("TotalCharges").isNull()})


def publish_curated(staged: DataFrame, table: str, *, buckets: int = 4) -> None:
    """The curated table, by contract and bucketed by customer, replaced in full."""
    columns = [c for c in staged.columns if c != "Contract"]
    write_table(staged.select(*columns, "Contract"), table, partition_by=["Contract"], buckets=buckets, bucket_by="customerID")


def merge_deltas(base: DataFrame, delta_raw: DataFrame, *, base_date: str = "2026-03-01") -> DataFrame:
    """The latest record of every customer, of the staged base and all deltas."""
    delta = stage(delta_raw)
    return merge.merge_snapshot(base, delta, "customerID", base_date=base_date, tie=["tenure", "MonthlyCharges", "TotalCharges"])


def contract_values(df: DataFrame) -> DataFrame:
    """Contract kinds that occur, to notice new ones."""
    return df.select("Contract").distinct()


def build_dimensions(source: DataFrame) -> dict[str, DataFrame]:
    """The three dimensions; made anew from the source each time, so that keys never occur twice."""
    return {table: star.surrogate_keys(source.select(F.col(natural).alias(name)), name, key) for table, natural, key, name in DIMENSIONS}


def extend_dimensions(spark: SparkSession, source: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """The three stored dimensions, with keys for what is new in the source; keys that facts hold already stay."""
    return {table: star.extend_dimension(spark, f"{prefix}{table}", source.select(F.col(natural).alias(name)), name, key) for table, natural, key, name in DIMENSIONS}


def merge_curated(spark: SparkSession, table: str, delta_raw: DataFrame) -> list[dict]:
    """Merges deltas into the curated table, rewriting the contracts that they touch; the table needs a load date."""
    return merge.merge_partitions(spark, table, stage(delta_raw), "customerID", tie=["tenure", "MonthlyCharges", "TotalCharges"])


def build_fact(source: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Customer activity with the keys of its dimensions."""
    linked = [(dimensions[table].withColumnRenamed(name, natural), natural, key) for table, natural, key, name in DIMENSIONS]
    fact = star.build_fact(source, linked, MEASURES)
    return fact.select("customerID", *(key for _, _, key, _ in DIMENSIONS), *MEASURES[1:])


def publish_fact(fact: DataFrame, table: str, *, buckets: int = 4) -> None:
    """The fact by contract key, bucketed by customer."""
    columns = [c for c in fact.columns if c != "contract_key"]
    write_table(fact.select(*columns, "contract_key"), table, partition_by=["contract_key"], buckets=buckets, bucket_by="customerID")


def churn_by_segment(fact: DataFrame, dimensions: dict[str, DataFrame], *, top: int = 10) -> DataFrame:
    linked = [(dimensions[table], name, key) for table, _, key, name in DIMENSIONS]
    return analytics.segment_rate(fact, linked, churned(), top=top)


def churn_profile(fact: DataFrame) -> DataFrame:
    """Customers who left against those who stayed."""
    return analytics.profile(fact, "Churn", [("MonthlyCharges", 2, "avg_monthly"), ("TotalCharges", 2, "avg_total"), ("tenure", 1, "avg_tenure")])


def churn_by_tenure(fact: DataFrame) -> DataFrame:
    return analytics.rate_by(fact, tenure_bucket(F.col("tenure")), churned(), name="tenure_bucket")


def compare_formats(spark: SparkSession, staged: DataFrame, folder: str, *, doublings: int = 7) -> DataFrame:
    """The same rows as text, ORC and Parquet: the answer to one query from each."""
    big = analytics.inflate(staged, doublings)
    for fmt in ("csv", "orc", "parquet"):
        write_files(big, f"{folder}/{fmt}", fmt, **({"header": "true"} if fmt == "csv" else {}))
    found = None
    for fmt in ("csv", "orc", "parquet"):
        back = spark.read.format(fmt).schema(staged.schema).options(**({"header": "true"} if fmt == "csv" else {})).load(f"{folder}/{fmt}")
        one = analytics.average_where(back, "MonthlyCharges", churned(), name="avg_monthly").select(F.lit(fmt).alias("format"), "avg_monthly")
        found = one if found is None else found.unionByName(one)
    return found


def log_quality(df: DataFrame, name: str, run_date: str) -> DataFrame:
    """The log's row for a table and a day."""
    row = quality.metrics(df, name, run_date, null_column="TotalCharges", key="customerID", duplicate_name="duplicate_customerids")
    return row.drop("null_keys")
