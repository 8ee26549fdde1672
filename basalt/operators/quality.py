"""Data quality: keys, blanks, reconciliation, a metrics log and its alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.columns import count_where, is_blank


def duplicate_keys(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def blank_count(df: DataFrame, column: str, name: str = "blanks") -> DataFrame:
    """Rows whose text is missing, empty or all blank."""
    return df.agg(count_where(is_blank(F.col(column))).alias(name))


def header_rows(df: DataFrame) -> DataFrame:
    """Rows that are a header line read as data: a string column that holds its own name."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    test = F.lit(False)
    for c in text:
        test = test | (F.col(c) == c)
    return df.where(test)


def reconcile(**tables: DataFrame) -> DataFrame:
    """Row counts by table name, in one result."""
    found = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        found = one if found is None else found.unionByName(one)
    return found


def promote(raw: DataFrame, stage: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], *, raw_checks: dict[str, Column] | None = None, staged_checks: dict[str, Column] | None = None) -> dict[str, int]:
    """Stages raw rows and writes them, and counts both sides in that one pass: raw_rows, staged_rows, lost_rows and the checks.

    Checks are conditions whose rows are counted on their side.  The counts are
    metrics of the write itself, so the source is read once and they are of the
    very rows that were written; ``stage`` should not shuffle, as tasks of a
    shuffle that are run again would be counted again.
    """
    rows = F.count(F.lit(1)).alias("rows")
    before, after = Observation(), Observation()
    counted = lambda checks: [count_where(condition).alias(name) for name, condition in (checks or {}).items()]
    write(stage(raw.observe(before, rows, *counted(raw_checks))).observe(after, rows, *counted(staged_checks)))
    seen, kept = before.get, after.get
    found = {"raw_rows": seen.pop("rows"), "staged_rows": kept.pop("rows")}
    return found | {"lost_rows": found["raw_rows"] - found["staged_rows"]} | seen | kept


def metrics(df: DataFrame, table: str, run_date: str, *, null_column: str, key: str, null_name: str | None = None, duplicate_name: str | None = None) -> DataFrame:
    """One row of the log in one pass: rows, missing values, rows less distinct keys, missing keys.

    A missing key is no distinct key, so it counts as a duplicate as well;
    ``null_keys`` tells how many of those there are.
    """
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("row_count"),
        count_where(F.col(null_column).isNull()).alias(null_name or f"null_{null_column}".lower()),
        (n - F.countDistinct(key)).alias(duplicate_name or f"duplicate_{key}".lower()),
        count_where(F.col(key).isNull()).alias("null_keys"),
    ).select(F.lit(run_date).alias("run_date"), F.lit(table).alias("table_name"), "*")


def append_log(row: DataFrame, table: str) -> None:
    """Adds a run to the log, with the time; earlier runs stay."""
    row.withColumn("created_ts", F.current_timestamp()).write.format("orc").mode("append").saveAsTable(table)


def latest_run(log: DataFrame) -> DataFrame:
    """The last entry of each table and day, if the log was written twice on a day."""
    order = Window.partitionBy("table_name", "run_date").orderBy(F.col("created_ts").desc(), F.col("row_count").desc_nulls_last())
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _once(log: DataFrame) -> DataFrame:
    """One entry per table and day: a log without times holds no other."""
    return latest_run(log) if "created_ts" in log.columns else log


def _change(now: str, before: str):
    return (F.col(now) - F.col(before)) * 100.0 / F.nullif(F.col(before), F.lit(0))


def anomalies(log: DataFrame, run_date: str, prev_date: str, *, threshold: float = -10.0) -> DataFrame:
    """Tables whose row count fell by more than the threshold between two days; no change from 0 rows.

    Of a table that was logged several times on a day, the last entry counts.
    """
    days = _once(log.where(F.col("run_date").isin(run_date, prev_date)))
    now = days.where(F.col("run_date") == run_date).select("table_name", F.col("run_date").alias("current_run_date"), F.col("row_count").alias("current_count"))
    old = days.where(F.col("run_date") == prev_date).select("table_name", F.col("run_date").alias("prev_run_date"), F.col("row_count").alias("prev_count"))
    return now.join(old, "table_name").withColumn("pct_change", _change("current_count", "prev_count")).where(F.col("pct_change") < threshold)


def anomalies_since_last(log: DataFrame, *, threshold: float = -10.0) -> DataFrame:
    """The same against each table's run before, whatever its day."""
    runs = Window.partitionBy("table_name").orderBy("run_date")
    out = _once(log).withColumn("prev_run_date", F.lag("run_date").over(runs)).withColumn("prev_count", F.lag("row_count").over(runs))
    out = out.withColumnsRenamed({"run_date": "current_run_date", "row_count": "current_count"})
    return out.withColumn("pct_change", _change("current_count", "prev_count")).where(F.col("pct_change") < threshold).select("table_name", "current_run_date", "current_count", "prev_run_date", "prev_count", "pct_change")


def missing_tables(log: DataFrame, run_date: str, prev_date: str) -> DataFrame:
    """Tables logged on the day before but not on the day."""
    day = lambda d: log.where(F.col("run_date") == d).select("table_name").distinct()
    return day(prev_date).join(day(run_date), "table_name", "left_anti")


def audit_history(log: DataFrame, table: str) -> DataFrame:
    """A table's runs, the last one first."""
    return log.where(F.col("table_name") == table).orderBy(F.col("run_date").desc())


def anomalies_sql(spark: SparkSession, log_view: str, run_date: str, prev_date: str, *, threshold: float = -10.0) -> DataFrame:
    """``anomalies`` in SQL with named parameters, over a view that has one entry per table and day."""
    return spark.sql(
        f"""SELECT c.table_name, c.run_date AS current_run_date, c.row_count AS current_count,
                   p.run_date AS prev_run_date, p.row_count AS prev_count,
                   (c.row_count - p.row_count) * 100.0 / nullif(p.row_count, 0) AS pct_change
            FROM {log_view} c JOIN {log_view} p ON c.table_name = p.table_name
            WHERE c.run_date = :run_date AND p.run_date = :prev_date
              AND (c.row_count - p.row_count) * 100.0 / nullif(p.row_count, 0) < :threshold""",
        args={"run_date": run_date, "prev_date": prev_date, "threshold": threshold},
    )
