"""The engine's queries on the benchmark tables, each with the same query in plain SQL.

"Left" is ``l_returnflag = 'R'``; tenure is ``l_quantity``; charges are
``l_extendedprice``; the dimensions are order priority, market segment and, where
there is a third, part type.
"""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.columns import bucket, safe_float
from basalt.operators import analytics, merge, quality, star
from basalt.plans import changes
from basalt.sources import readers, writers
from basalt.streaming import messages
from basalt.streaming.sink import KeyedSink, consume_keyed
from basalt.workspace import Scratch

EVENT_MESSAGE = "ID int, name string, category string, price float, last_updated string"


def _left() -> Column:
    return F.col("l_returnflag") == "R"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dimensions(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str]]:
    """The two dimensions of the fact; values and keys are few, so they are cut off from their scans once."""
    return [
        (star.surrogate_keys(_t(spark, sf_dir, "orders"), "o_orderpriority", "priority_key"), "o_orderpriority", "priority_key"),
        (star.surrogate_keys(_t(spark, sf_dir, "customer"), "c_mktsegment", "segment_key"), "c_mktsegment", "segment_key"),
    ]


def segment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate by order priority, market segment and part type, top ten."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    named = orders.join(customer, "o_custkey").select("o_orderkey", "o_orderpriority", "c_mktsegment")
    joined = lines.join(named, "o_orderkey").join(part, "l_partkey")
    totals = joined.groupBy("o_orderpriority", "c_mktsegment", "p_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(_left()).alias("returned"))
    rate = F.round(F.col("returned") / F.col("total"), 4)
    return totals.withColumn("return_rate", rate).orderBy(F.col("return_rate").desc(), "o_orderpriority", "c_mktsegment", "p_type").limit(10)


def star_segment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate by priority and segment over the fact with surrogate keys."""
    dims = _dimensions(spark, sf_dir)
    return analytics.segment_rate(_fact(spark, sf_dir, dims), dims, _left(), rows="total", hits="returned", share="return_rate")


def avg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile(_t(spark, sf_dir, "lineitem"), "l_returnflag", [("l_extendedprice", 2, "avg_price"), ("l_discount", 4, "avg_discount"), ("l_quantity", 1, "avg_quantity")], rows="lines")


QUANTITY = [(0, 12, "0–12"), (13, 24, "13–24"), (25, 36, "25–36"), (37, 48, "37–48")]


def rate_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rate_by(_t(spark, sf_dir, "lineitem"), bucket(F.col("l_quantity"), QUANTITY, "48+"), _left(), rows="lines", hits="returned", share="return_rate")


def filtered_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.average_where(_t(spark, sf_dir, "lineitem"), "l_extendedprice", _left(), name="avg_price")


def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.surrogate_keys(_t(spark, sf_dir, "orders"), "o_orderpriority", "priority_key")


def _fact(spark: SparkSession, sf_dir: str, dims: list) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    linked = star.build_fact(orders.join(customer, "o_custkey"), dims, ["o_orderkey"])  # keys join the smaller side first
    return lines.join(linked, "o_orderkey")


def star_fact_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact(spark, sf_dir, _dimensions(spark, sf_dir)).drop("l_partkey")


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderpriority").distinct()


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_per_key(_t(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def snapshot_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, with a delta in which a tenth has changed and a hundredth is new."""
    base = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = base.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    new = base.where("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000_000)
    delta = changed.unionByName(new).withColumn("load_date", F.lit("2026-03-02"))
    return merge.merge_snapshot(base, delta, "o_orderkey", base_date="2026-03-01", tie=["o_orderstatus"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_or_empty_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", " ").when(F.col("event_type") != "click", F.col("event_type"))
    return quality.blank_count(_t(spark, sf_dir, "events").select(text.alias("text")), "text")


def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, " ").when(F.col("event_id") % 5 == 2, "abc").otherwise(F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".25")))
    return _t(spark, sf_dir, "events").select("event_id", safe_float(raw).alias("amount"))


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile(**{n: _t(spark, sf_dir, n) for n in ("customer", "supplier", "part", "orders", "lineitem", "events")})


def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return quality.metrics(keyed, "orders", "2026-03-03", null_column="price", key="key", null_name="null_price", duplicate_name="duplicate_keys")


def _daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table_name"), F.date_format("ts", "yyyy-MM-dd").alias("run_date")).agg(F.count(F.lit(1)).alias("row_count"))


def dq_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomalies(_daily_log(spark, sf_dir), "2024-01-03", "2024-01-02")


def dq_repeated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from a log in which every day was logged twice, first with half the rows: the last entry counts, and once."""
    log = _daily_log(spark, sf_dir)
    first = log.withColumn("row_count", F.floor(F.col("row_count") / 2)).withColumn("created_ts", F.to_timestamp(F.concat("run_date", F.lit(" 08:00:00"))))
    return quality.anomalies(first.unionByName(log.withColumn("created_ts", F.to_timestamp(F.concat("run_date", F.lit(" 09:00:00"))))), "2024-01-03", "2024-01-02")


def dq_prev_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomalies_since_last(_daily_log(spark, sf_dir))


def dq_missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _daily_log(spark, sf_dir).where("NOT (table_name = 'view' AND run_date = '2024-01-03')")
    return quality.missing_tables(log, "2024-01-03", "2024-01-02")


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit_history(_daily_log(spark, sf_dir), "purchase")


def inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.inflate(_t(spark, sf_dir, "customer").select("c_custkey"), 7).agg(F.count(F.lit(1)).alias("row_count"), F.sum("c_custkey").alias("key_sum"))


def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beyond a cursor, which a database would be asked for in the same words."""
    return readers.beyond_cursor(_t(spark, sf_dir, "events"), "ts", "2024-01-28 00:00:00").select("event_id", "user_id", "event_type", "value")


def incremental_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.beyond_cursor(_t(spark, sf_dir, "events"), "ts", "2024-01-28 00:00:00").agg(F.max("ts").alias("next_cursor"), F.count(F.lit(1)).alias("fresh_rows"))


def _round_trip(spark: SparkSession, sf_dir: str, fmt: str, read) -> DataFrame:
    scratch = Scratch(spark, f"round-trip-{fmt}")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    writers.write_files(lines, scratch.path("lines"), fmt, **({"header": "true"} if fmt == "csv" else {}))
    back = read(scratch.path("lines"), ", ".join(f"{n} {k}" for n, k in lines.dtypes))
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.sum("l_orderkey").alias("key_sum"))


def scan_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv", lambda path, schema: readers.read_text(spark, path, schema))


def scan_orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orc", lambda path, _: readers.read_orc(spark, path))


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "parquet", lambda path, _: readers.read_parquet(spark, path))


@atexit.register
def _drop_tables() -> None:
    for spark, name in changes.TABLES:
        try:
            writers.drop_table(spark, name)
        except Exception:  # the session has ended before the process
            pass


def partitioned_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status in four buckets a status, or as many as their size calls for, written and read again with one status pruned to."""
    name = changes.table_name(spark, "curated")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    writers.write_table(orders, name, partition_by=["o_orderstatus"], buckets=max(4, writers.buckets_for(orders)), bucket_by="o_custkey")
    return spark.table(name).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


def overwrite_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice, the second time with one status moved to another: no row is there twice."""
    name = changes.table_name(spark, "twice")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    writers.write_table(orders, name, partition_by=["o_orderstatus"])
    writers.write_table(orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))), name, partition_by=["o_orderstatus"])
    return spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers bucketed alike, joined without a shuffle or a sort."""
    left, right = changes.table_name(spark, "orders"), changes.table_name(spark, "customer")
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    buckets = max(8, writers.buckets_for(orders))  # each is one task's and one file's
    writers.write_table(orders, left, buckets=buckets, bucket_by="c_custkey")
    writers.write_table(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), right, buckets=buckets, bucket_by="c_custkey")
    session = readers.bucketed_session(spark)
    joined = session.table(left).join(session.table(right), "c_custkey")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("ID"), F.col("props").alias("name"), F.initcap("event_type").alias("category"), (F.col("event_id") % 997).cast("float").alias("price"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


def keyed_json_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of an increment as a consumer reads their fields again."""
    sent = messages.keyed_json(readers.beyond_cursor(_products(spark, sf_dir).drop("name"), "last_updated", "2024-01-20 00:00:00"), "ID")
    field = lambda n: F.get_json_object("value", f"$.{n}")
    return sent.select("key", field("ID").cast("int").alias("id"), field("category").alias("category"), field("last_updated").alias("last_updated"), field("price").cast("double").alias("price"))


def _consumed(spark: SparkSession, sent: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Sends the message tables one after another through the streaming consumer, with a restart after each."""
    scratch = Scratch(spark, "stream")
    for number, df in enumerate(sent):
        df.select("value").write.mode("append").text(scratch.path("topic"))
        source = spark.readStream.schema("value string").option("maxFilesPerTrigger", 64).text(scratch.path("topic"))
        query = messages.consume(source, scratch.path("good"), scratch.path("dead"), scratch.path("checkpoint"), discount_category="click", discount=0.5)
        query.awaitTermination()
    good = messages.read_batches(spark, f"{scratch.path('good')}/*", EVENT_MESSAGE)
    return good, messages.read_batches(spark, f"{scratch.path('dead')}/*", "value string")


def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = _consumed(spark, [messages.keyed_json(_products(spark, sf_dir).drop("name"), "ID")])
    return good.select("ID", "category", F.col("price").cast("double").alias("price"))


def _spoiled(df: DataFrame) -> DataFrame:
    value = F.col("value")
    n = F.col("key").cast("int") % 10
    bad = F.when(n == 0, F.substring(value, 1, 12)).when(n == 1, F.regexp_replace(value, '"ID":\\d+,', "")).when(n == 2, F.regexp_replace(value, '"price":[0-9.]+', '"price":"dear"')).otherwise(value)
    return df.select("key", bad.alias("value"))


def stream_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which three in ten are broken, by outcome."""
    good, dead = _consumed(spark, [_spoiled(messages.keyed_json(_products(spark, sf_dir).drop("name"), "ID"))])
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("outcome"), "n").unionByName(dead.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("outcome"), "n"))


def stream_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message sent twice, and a third with a later price: the sink keyed on the id holds each once."""
    first = _products(spark, sf_dir).drop("name")
    later = first.where("ID % 3 = 0").withColumn("price", F.col("price") + 1).withColumn("last_updated", F.lit("2025-01-01 00:00:00"))
    scratch = Scratch(spark, "keyed-sink")
    sink = KeyedSink(spark, scratch.path("sink"), EVENT_MESSAGE.replace("name string, ", ""))
    for df in (messages.keyed_json(first, "ID"), messages.keyed_json(first.unionByName(later), "ID")):
        df.select("value").write.mode("append").text(scratch.path("topic"))
        source = spark.readStream.schema("value string").text(scratch.path("topic"))
        consume_keyed(source.select("value"), sink, scratch.path("dead"), scratch.path("checkpoint"), discount_category="click", discount=0.5).awaitTermination()
    return sink.rows().select("ID", "category", F.col("price").cast("double").alias("price"), "last_updated")


QUERIES = {
    f.__name__: f
    for f in (
        segment_rate, star_segment_rate, avg_profile, rate_by_bucket, filtered_avg, surrogate_keys, star_fact_build, distinct_values, latest_per_key, snapshot_merge_latest,
        duplicate_keys, null_or_empty_count, safe_cast, row_count, dq_metrics, dq_anomaly, dq_repeated_run, dq_prev_run, dq_missing_tables, audit_history, inflate, incremental_pull, incremental_cursor,
        scan_text_roundtrip, scan_orc_roundtrip, scan_parquet, partitioned_curated, overwrite_idempotent, bucketed_join, keyed_json_publish, stream_transform, stream_dlq, stream_idempotent,
    )
} | changes.QUERIES

_ROUND_TRIP = "SELECT l_returnflag, count(*) AS lines, round(avg(l_extendedprice), 2) AS avg_price, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY l_returnflag"
_LOG = "SELECT event_type AS table_name, strftime(ts, '%Y-%m-%d') AS run_date, count(*) AS row_count FROM events GROUP BY 1, 2"
_PRODUCTS = "SELECT CAST(event_id AS INTEGER) AS \"ID\", event_type AS category, CAST(event_id % 997 AS DOUBLE) AS price, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_updated FROM events"
_CHANGE = "(row_count - prev_count) * 100.0 / nullif(prev_count, 0)"

_ANOMALY = f"""
        WITH log AS ({_LOG}), pairs AS (
            SELECT c.table_name, c.run_date AS current_run_date, c.row_count, p.run_date AS prev_run_date, p.row_count AS prev_count
            FROM log c JOIN log p ON c.table_name = p.table_name WHERE c.run_date = '2024-01-03' AND p.run_date = '2024-01-02')
        SELECT table_name, current_run_date, row_count AS current_count, prev_run_date, prev_count, CAST({_CHANGE} AS DOUBLE) AS pct_change FROM pairs WHERE {_CHANGE} < -10"""

ORACLE_SQL = {
    "segment_rate": """
        SELECT o_orderpriority, c_mktsegment, p_type, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
               round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS return_rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
        GROUP BY o_orderpriority, c_mktsegment, p_type ORDER BY return_rate DESC, o_orderpriority, c_mktsegment, p_type LIMIT 10""",
    "star_segment_rate": """
        SELECT o_orderpriority, c_mktsegment, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
               round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS return_rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY o_orderpriority, c_mktsegment ORDER BY return_rate DESC, o_orderpriority, c_mktsegment LIMIT 10""",
    "avg_profile": "SELECT l_returnflag, count(*) AS lines, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 4) AS avg_discount, round(avg(l_quantity), 1) AS avg_quantity FROM lineitem GROUP BY l_returnflag",
    "rate_by_bucket": """
        SELECT CASE WHEN l_quantity BETWEEN 0 AND 12 THEN '0–12' WHEN l_quantity BETWEEN 13 AND 24 THEN '13–24' WHEN l_quantity BETWEEN 25 AND 36 THEN '25–36'
                    WHEN l_quantity BETWEEN 37 AND 48 THEN '37–48' ELSE '48+' END AS bucket,
               count(*) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
               round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS return_rate
        FROM lineitem GROUP BY 1""",
    "filtered_avg": "SELECT round(avg(l_extendedprice), 2) AS avg_price FROM lineitem WHERE l_returnflag = 'R'",
    "surrogate_keys": "SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS priority_key, o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)",
    "star_fact_build": """
        WITH p AS (SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS priority_key, v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)),
             s AS (SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS segment_key, v FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))
        SELECT o_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, priority_key, segment_key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN p ON p.v = o_orderpriority JOIN s ON s.v = c_mktsegment""",
    "distinct_values": "SELECT DISTINCT o_orderpriority FROM orders",
    "latest_per_key": "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "snapshot_merge_latest": """
        WITH merged AS (
            SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, DATE '2026-03-01' AS load_date FROM orders
            UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice, DATE '2026-03-02' FROM orders WHERE o_orderkey % 10 = 0
            UNION ALL SELECT o_orderkey + 100000000000, o_custkey, o_orderstatus, o_totalprice, DATE '2026-03-02' FROM orders WHERE o_orderkey % 100 = 1)
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, load_date
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY load_date DESC) AS rn FROM merged) WHERE rn = 1""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "null_or_empty_count": "SELECT count(*) AS blanks FROM (SELECT CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN ' ' WHEN event_type <> 'click' THEN event_type END AS text FROM events) WHERE text IS NULL OR trim(text) = ''",
    "safe_cast": "SELECT event_id, TRY_CAST(nullif(trim(CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'abc' ELSE CAST(event_id % 1000 AS VARCHAR) || '.25' END), '') AS FLOAT) AS amount FROM events",
    "row_count": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("customer", "supplier", "part", "orders", "lineitem", "events")),
    "dq_metrics": """
        SELECT '2026-03-03' AS run_date, 'orders' AS table_name, count(*) AS row_count, count(*) FILTER (WHERE price IS NULL) AS null_price,
               count(*) - count(DISTINCT key) AS duplicate_keys, count(*) FILTER (WHERE key IS NULL) AS null_keys
        FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS key, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)""",
    "dq_anomaly": _ANOMALY,
    "dq_repeated_run": _ANOMALY,
    "dq_prev_run": f"""
        WITH log AS ({_LOG}), pairs AS (
            SELECT table_name, run_date, row_count, lag(run_date) OVER w AS prev_run_date, lag(row_count) OVER w AS prev_count
            FROM log WINDOW w AS (PARTITION BY table_name ORDER BY run_date))
        SELECT table_name, run_date AS current_run_date, row_count AS current_count, prev_run_date, prev_count, CAST({_CHANGE} AS DOUBLE) AS pct_change FROM pairs WHERE {_CHANGE} < -10""",
    "dq_missing_tables": f"""
        WITH log AS (SELECT * FROM ({_LOG}) WHERE NOT (table_name = 'view' AND run_date = '2024-01-03'))
        SELECT DISTINCT table_name FROM log WHERE run_date = '2024-01-02' AND table_name NOT IN (SELECT table_name FROM log WHERE run_date = '2024-01-03')""",
    "audit_history": f"SELECT * FROM ({_LOG}) WHERE table_name = 'purchase' ORDER BY run_date DESC",
    "inflate": "SELECT count(*) AS row_count, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer CROSS JOIN range(128)",
    "incremental_pull": "SELECT event_id, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-28 00:00:00'",
    "incremental_cursor": "SELECT max(ts) AS next_cursor, count(*) AS fresh_rows FROM events WHERE ts > TIMESTAMP '2024-01-28 00:00:00'",
    "scan_text_roundtrip": _ROUND_TRIP,
    "scan_orc_roundtrip": _ROUND_TRIP,
    "scan_parquet": _ROUND_TRIP,
    "partitioned_curated": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "overwrite_idempotent": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, count(*) AS orders FROM orders GROUP BY 1",
    "bucketed_join": "SELECT c_mktsegment, count(*) AS orders, round(avg(o_totalprice), 2) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "keyed_json_publish": f"SELECT CAST(\"ID\" AS VARCHAR) AS key, \"ID\" AS id, upper(category[1]) || category[2:] AS category, last_updated, price FROM ({_PRODUCTS}) WHERE last_updated > '2024-01-20 00:00:00'",
    "stream_transform": f"SELECT \"ID\", category, CASE WHEN category = 'click' THEN price * 0.5 ELSE price END AS price FROM ({_PRODUCTS})",
    "stream_dlq": "SELECT CASE WHEN event_id % 10 > 2 THEN 'good' ELSE 'dead' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "stream_idempotent": f"""
        SELECT "ID", category, CASE WHEN category = 'click' THEN 0.5 ELSE 1 END * (price + CASE WHEN "ID" % 3 = 0 THEN 1 ELSE 0 END) AS price,
               CASE WHEN "ID" % 3 = 0 THEN '2025-01-01 00:00:00' ELSE last_updated END AS last_updated FROM ({_PRODUCTS})""",
} | changes.ORACLE_SQL
