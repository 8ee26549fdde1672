"""Queries on what changes: increments, keys that stay, partitions, buckets, order, each with the same in plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.columns import safe_float
from basalt.operators import merge, quality, star
from basalt.plans import products
from basalt.sources import keyset_stream, readers, writers
from basalt.streaming import messages, order
from basalt.streaming.keyset import KeysetCursor
from basalt.streaming.sink import KeyedSink
from basalt.workspace import Scratch

#: Tables that queries have made; the catalog drops them when the process ends.
TABLES: list[tuple[SparkSession, str]] = []


def table_name(spark: SparkSession, what: str) -> str:
    name = f"basalt_{what}_{uuid.uuid4().hex[:12]}"
    TABLES.append((spark, name))
    return name


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What had been committed when the first, second and third pull looked: a tenth of the day before the first came late.
_SEEN = ["ts <= TIMESTAMP '2024-01-10 00:00:00'", "ts <= TIMESTAMP '2024-01-20 00:00:00'", "ts IS NOT NULL"]
_LATE = "(event_id % 10 = 3 AND ts > TIMESTAMP '2024-01-09 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00')"


def keyset_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the pull that delivered them; late ones at or before the cursor's time come with the second, and none comes twice."""
    scratch = Scratch(spark, "keyset")
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    cursor = KeysetCursor(spark, scratch.path("cursor"), time="ts", key="event_id", look_back="2 days")
    for seen in (events.where(f"{_SEEN[0]} AND NOT {_LATE}"), events.where(_SEEN[1]), events.where(_SEEN[1]), events.where(_SEEN[2])):
        cursor.pull(seen, lambda rows, run: rows.write.mode("overwrite").parquet(scratch.path(f"sent/run={run}")))
    return spark.read.parquet(scratch.path("sent")).select("event_id", "user_id", "value", F.col("run").cast("int").alias("run"))


def stream_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream from a database, here one that serves the table's files, with a restart in between: each once, by its batch."""
    scratch = Scratch(spark, "keyset-stream")
    files = f"read_parquet('{sf_dir}/events.parquet')"
    for seen in _SEEN[1:]:
        source = keyset_stream.read_increments(spark, "event_id long, user_id long, event_type string", connect="duckdb:connect", table=f"(SELECT * FROM {files} WHERE {seen})", time="ts", key="event_id")
        write = lambda batch, number: batch.write.mode("overwrite").parquet(scratch.path(f"sent/batch={number}"))
        source.writeStream.foreachBatch(write).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(scratch.path("sent")).select("event_id", "user_id", "event_type", F.col("batch").cast("int").alias("batch"))


def _priorities(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The stored dimension of priorities: first without the one that sorts first, then with it."""
    orders = _t(spark, sf_dir, "orders")
    for source in (orders.where("o_orderpriority <> '1-URGENT'"), orders):
        dimension = star.extend_dimension(spark, table, source, "o_orderpriority", "priority_key")
    return dimension


def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a key that was allocated when its priority first came: the one that sorts first came last."""
    dimension = _priorities(spark, sf_dir, table_name(spark, "kept_keys"))
    return star.build_fact(_t(spark, sf_dir, "orders"), [(dimension, "o_orderpriority", "priority_key")], ["o_orderkey"])


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").alias("order_year")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit("2026-03-01").cast("date").alias("load_date"), year)


def partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year after a delta that moves some of 1995 to 1996, changes some of 1996 and empties 1999; the other years are not rewritten."""
    name, base = table_name(spark, "merged"), _by_year(spark, sf_dir)
    writers.write_table(base, name, partition_by=["order_year"], buckets=2, bucket_by="o_orderkey")
    moved = base.where("order_year = 1995 AND o_orderkey % 3 = 0 OR order_year = 1999").withColumn("order_year", F.lit(1996))
    raised = base.where("order_year = 1996 AND o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    stale = base.where("order_year = 1995 AND o_orderkey % 3 = 1").withColumns({"o_totalprice": F.lit(0.0), "load_date": F.lit("2026-02-01").cast("date")})
    delta = moved.unionByName(raised).withColumn("load_date", F.lit("2026-03-02").cast("date")).unionByName(stale)
    merge.merge_partitions(spark, name, delta, "o_orderkey")
    return spark.table(name).select("o_orderkey", "o_totalprice", F.col("order_year").cast("int").alias("order_year"))


def pruned_fact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of the urgent priorities, from a fact by priority key of which only their partitions are read."""
    dimension = _priorities(spark, sf_dir, table_name(spark, "pruning_keys"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    name = table_name(spark, "pruned")
    writers.write_table(star.build_fact(lines.join(orders, "l_orderkey"), [(dimension, "o_orderpriority", "priority_key")], ["l_orderkey", "l_returnflag"]), name, partition_by=["priority_key"], buckets=4, bucket_by="l_orderkey")
    urgent = star.pruned_fact(spark.table(name), dimension.where("o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%'"), "priority_key")
    totals = urgent.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return totals.withColumn("return_rate", F.round(F.col("returned") / F.col("total"), 4))


def bucket_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in eight buckets, or what their size calls for, and customers in half as many: buckets are merged, nothing is dealt out, and only the merged side is sorted."""
    left, right = table_name(spark, "orders"), table_name(spark, "customer")
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    buckets = max(8, writers.buckets_for(orders))
    writers.write_table(orders, left, buckets=buckets, bucket_by="c_custkey")
    writers.write_table(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), right, buckets=buckets // 2, bucket_by="c_custkey")
    session = readers.bucketed_session(spark)
    joined = session.table(left).join(session.table(right), "c_custkey")
    return joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top_price"))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of events in two runs, as a consumer reads them back from the files of the ten writers."""
    scratch = Scratch(spark, "ordered")
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id").where("user_id IS NOT NULL")
    publisher = order.OrderedPublisher(spark, scratch.path("numbers"), key="user_id", order=["ts", "event_id"])
    for run, seen in ((1, _SEEN[0]), (2, f"NOT ({_SEEN[0]})")):
        publisher.publish(events.where(seen).repartition(7, "event_id"), run, lambda m, run=run: m.select("value").write.text(scratch.path(f"topic/run={run}")))
    field: Column = order.column_of
    return spark.read.text(scratch.path("topic")).select(field("user_id", "long").alias("user_id"), field("seq", "long").alias("seq"), field("event_id", "long").alias("event_id"))


def ordered_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each event's message has among those of its user; numbers go on from the first run to the second."""
    return _published(spark, sf_dir)


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of messages of which some were lost: where a user's numbers jump, and what was expected there."""
    sent = order.numbered(_t(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "user_id", ["ts", "event_id"])
    faults = order.order_faults(sent.where("event_id % 97 <> 0"), "user_id", ["ts", "event_id"])
    return faults.select("user_id", "event_id", "expected", "seq", "fault")


def change_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as products: pulled as they are, then with late and changed ones, sent in order and held by key, the newest of each."""
    scratch = Scratch(spark, "change-pipeline")
    price = (F.col("event_id") % 997).cast("float")
    now = _t(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("ID"), F.lit("x").alias("name"), F.initcap("event_type").alias("category"), price.alias("price"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))
    early = now.where("last_updated <= '2024-01-10 00:00:00' AND ID % 10 <> 3")
    changed = now.where("ID % 4 = 0").withColumns({"price": F.col("price") + 1, "last_updated": F.lit("2024-02-01 00:00:00")})
    later = now.where("ID % 4 <> 0 AND (last_updated > '2024-01-09 00:00:00' OR ID % 10 <> 3)").unionByName(changed)
    schema = "ID int, name string, category string, price float, last_updated string"
    for source in (early, early, later):
        products.publish_changes(spark, source, scratch.path("producer"), lambda m, run: m.select("value").write.mode("overwrite").text(scratch.path(f"topic/run={run}")), look_back="1 day")
        messages_ = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(scratch.path("topic"))
        sink = KeyedSink.latest(spark, scratch.path("sink"), schema)
        products.hold_latest(messages_, sink, scratch.path("consumer"), discount_category="click", discount=0.5)
    return sink.rows().select("ID", "category", F.col("price").cast("double").alias("price"), "last_updated")


def promotion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events staged as typed rows; what was read, written, lost and missing, counted by the write itself."""
    raw = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 5 == 1, "abc").otherwise(F.col("value").cast("string")).alias("amount"))
    path = Scratch(spark, "promoted").path("staged")
    stage = lambda df: df.where("event_id % 11 <> 0").withColumn("amount", safe_float(F.col("amount")))
    counts = quality.promote(raw, stage, lambda df: writers.write_files(df, path), raw_checks={"blank_amounts": F.trim("amount") == ""}, staged_checks={"null_amounts": F.col("amount").isNull()})
    stored = spark.read.orc(path).agg(F.count(F.lit(1)).alias("stored_rows"))
    return stored.select(*(F.lit(n).cast("long").alias(name) for name, n in counts.items()), "stored_rows")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which all come twice, and those of the first run again after a restart: each once."""
    scratch = Scratch(spark, "stream-dedup")
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    for seen in (events.where(_SEEN[1]), events):
        seen.unionByName(seen).write.mode("append").parquet(scratch.path("topic"))
        source = spark.readStream.schema(events.schema).parquet(scratch.path("topic"))
        unique = messages.deduplicate(source, ["event_id"], "ts", "40 days")
        unique.writeStream.format("parquet").option("path", scratch.path("sink")).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(scratch.path("sink")).select("event_id", "event_type")


def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of some customers' orders, from files that lie by customer with a filter on the order's key."""
    path = Scratch(spark, "clustered").path("orders")
    writers.write_clustered(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, cluster_by=["o_custkey"], lookup=["o_orderkey"])
    stored = readers.read_parquet(spark, path)
    return stored.where("o_custkey BETWEEN 20 AND 40").unionByName(stored.where("o_orderkey = 7 AND o_custkey NOT BETWEEN 20 AND 40"))


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers before and after a column was added, inserted by name in another order of columns; the old ones have none."""
    name, customer = table_name(spark, "evolved"), _t(spark, sf_dir, "customer")
    writers.write_table(customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment"), name, fmt="parquet")
    writers.add_columns(spark, name, "c_nation bigint")
    writers.insert_by_name(customer.where("c_custkey % 2 = 1").select(F.col("c_nationkey").alias("C_NATION"), "c_mktsegment", "c_custkey"), name)
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (
        keyset_increment, stream_increment, stable_keys, partition_merge, pruned_fact_rate, bucket_merge_join, ordered_publish, order_gaps, change_pipeline, promotion_counts, stream_dedup, clustered_lookup, schema_evolution,
    )
}

_NUMBERED = "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE user_id IS NOT NULL"

ORACLE_SQL = {
    "keyset_increment": f"SELECT event_id, user_id, value, CASE WHEN {_SEEN[0]} AND NOT {_LATE} THEN 1 WHEN {_SEEN[1]} THEN 2 ELSE 3 END AS run FROM events WHERE ts IS NOT NULL",
    "stream_increment": f"SELECT event_id, user_id, event_type, CASE WHEN {_SEEN[1]} THEN 0 ELSE 1 END AS batch FROM events WHERE ts IS NOT NULL",
    "stable_keys": """
        WITH first AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority <> '1-URGENT'))
        SELECT o_orderkey, CAST(coalesce(k, (SELECT count(*) FROM first) + 1) AS INTEGER) AS priority_key FROM orders LEFT JOIN first ON v = o_orderpriority WHERE o_orderpriority IS NOT NULL""",
    "partition_merge": """
        SELECT o_orderkey, o_totalprice + CASE WHEN y = 1996 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice,
               CAST(CASE WHEN y = 1999 OR y = 1995 AND o_orderkey % 3 = 0 THEN 1996 ELSE y END AS INTEGER) AS order_year
        FROM (SELECT *, year(o_orderdate) AS y FROM orders)""",
    "pruned_fact_rate": """
        SELECT o_orderpriority, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
               round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS return_rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' GROUP BY o_orderpriority""",
    "bucket_merge_join": "SELECT c_nationkey, count(*) AS orders, max(o_totalprice) AS top_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "ordered_publish": f"SELECT user_id, seq, event_id FROM ({_NUMBERED})",
    "order_gaps": f"""
        SELECT user_id, event_id, before + 1 AS expected, seq, 'gap' AS fault
        FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM ({_NUMBERED}) WHERE event_id % 97 <> 0) WHERE seq <> before + 1""",
    "change_pipeline": """
        WITH now AS (SELECT CAST(event_id AS INTEGER) AS id, event_type, CAST(event_id % 997 AS DOUBLE) AS price, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events)
        SELECT id AS "ID", event_type AS category, (price + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) * CASE WHEN event_type = 'click' THEN 0.5 ELSE 1 END AS price,
               CASE WHEN id % 4 = 0 THEN '2024-02-01 00:00:00' ELSE moment END AS last_updated
        FROM now WHERE id % 4 = 0 OR id % 10 <> 3 OR moment > '2024-01-09 00:00:00'""",
    "promotion_counts": """
        SELECT count(*) AS raw_rows, count(*) FILTER (WHERE event_id % 11 <> 0) AS staged_rows, count(*) FILTER (WHERE event_id % 11 = 0) AS lost_rows, count(*) FILTER (WHERE event_id % 5 = 0) AS blank_amounts,
               count(*) FILTER (WHERE event_id % 11 <> 0 AND (event_id % 5 < 2 OR value IS NULL)) AS null_amounts, count(*) FILTER (WHERE event_id % 11 <> 0) AS stored_rows
        FROM events""",
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "clustered_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 20 AND 40 OR o_orderkey = 7",
    "schema_evolution": "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_nationkey AS BIGINT) END AS c_nation FROM customer",
}
