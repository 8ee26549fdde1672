"""Keyed JSON messages: publishing increments, consuming with validation, an idempotent sink."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt import schemas
from basalt.operators.merge import latest_per_key
from basalt.sources.readers import beyond_cursor, next_cursor


def keyed_json(df: DataFrame, key: str) -> DataFrame:
    """One message per row: the key as text, and the row as JSON; ``order.OrderedPublisher`` numbers and sends a key's messages in order."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish_increment(df: DataFrame, key: str, cursor_column: str, cursor, write: Callable[[DataFrame], None]):
    """Writes the messages of all rows beyond the cursor; returns the cursor to start from next time.

    The cursor moves only after the write has succeeded, and stays if there is
    no new row; a crash between the two repeats messages and loses none.
    """
    fresh = beyond_cursor(df, cursor_column, cursor) if cursor is not None else df
    reached = next_cursor(fresh, cursor_column)
    if reached is None:
        return cursor
    write(keyed_json(fresh.where(F.col(cursor_column) <= F.lit(reached)), key))
    return reached


#: Producer settings unless the caller names others: every replica confirms, and a message that is sent again is not there twice.
DELIVERY = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.retries": "10", "kafka.delivery.timeout.ms": "120000"}
#: Where a message came from, as far as its source says.
POSITION = ["key", "topic", "partition", "offset", "timestamp"]


def write_kafka(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Sends messages to a topic; needs Spark's Kafka package on the class path.

    The producer tries again by itself, and the write fails if a message was not
    delivered, so a cursor that is moved after it has lost none.
    """
    kafka_writer(messages, servers, topic, **options).save()


def kafka_writer(messages: DataFrame, servers: str, topic: str, **options: str):
    """The configured writer of ``write_kafka``."""
    return messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**(DELIVERY | options))


def parse(messages: DataFrame, schema: str = schemas.PRODUCT, *, required: str = "ID", number: str = "price") -> DataFrame:
    """Message fields, the raw message, where it came from, and whether it is valid: JSON, with its id, and a number as price.

    ``reason`` tells what is wrong with one that is not.
    """
    # the price is read as text first, so that a word in its place is told from a missing one
    loose = ", ".join(f"{n} string" if n == number else f"{n} {k}" for n, k in (f.split() for f in schema.split(", "))) + ", _broken string"
    got = messages.withColumn("m", F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    names = [f.split()[0] for f in schema.split(", ")]
    kind = dict(f.split() for f in schema.split(", "))[number]
    reason = (
        F.when(F.col("value").isNull(), "no value")
        .when(F.col("m").isNull() | F.col("m._broken").isNotNull(), "not such JSON")
        .when(F.col(f"m.{required}").isNull(), f"no {required}")
        .when(F.col(f"m.{number}").isNull(), f"no {number}")
        .when(F.col(f"m.{number}").try_cast(kind).isNull(), f"{number} is no number")
    )
    fields = [F.col(f"m.{n}").try_cast(kind).alias(n) if n == number else F.col(f"m.{n}").alias(n) for n in names]
    return got.select(*fields, "value", *(c for c in POSITION if c in messages.columns), reason.alias("reason"), reason.isNull().alias("valid"))


def avro_schema(name: str = "product", schema: str = schemas.PRODUCT) -> str:
    """A flat schema as an Avro record, for topics that carry Avro instead of JSON."""
    fields = [{"name": n, "type": k} for n, k in (f.split() for f in schema.split(", "))]
    return json.dumps({"type": "record", "name": name, "fields": fields})


def transform(df: DataFrame, *, discount_category: str, discount: Column | float) -> DataFrame:
    """Category in lower case; the discount off the price of one category, whatever its case."""
    discount = F.lit(discount) if isinstance(discount, (int, float)) else discount
    hit = F.lower("category") == discount_category.lower()
    return df.withColumn("price", F.when(hit, F.col("price") * (1 - discount)).otherwise(F.col("price"))).withColumn("category", F.lower("category"))


def dead_letters(parsed: DataFrame, number: int) -> DataFrame:
    """Messages to set aside: as they were sent, what is wrong, their batch and where they came from."""
    return parsed.where("not valid").select("value", "reason", F.lit(number).alias("batch_id"), *(c for c in POSITION if c in parsed.columns))


def dead_letter_messages(dead: DataFrame) -> DataFrame:
    """Dead letters as messages of a topic of their own: the key they had, and all else as JSON."""
    key = F.col("key").cast("string") if "key" in dead.columns else F.lit(None).cast("string")
    return dead.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))


def consume(messages: DataFrame, good_path: str, dead_path: str, checkpoint: str, *, discount_category: str, discount: float, fmt: str = "json", parser: Callable[[DataFrame], DataFrame] = parse, dead_topic: Callable[[DataFrame], None] | None = None):
    """Starts the consumer over a stream with a column ``value``: valid messages are transformed, others set aside.

    A batch writes folders of its own number and replaces them if it is run
    again, so a restart leaves no copies; an empty batch writes nothing.  With
    ``dead_topic`` (a write of messages) the dead letters are sent there as well,
    again if the batch is run again.
    """

    def one(batch: DataFrame, number: int) -> None:
        parsed = parser(batch).persist()
        try:
            if parsed.isEmpty():
                return
            good = transform(parsed.where("valid"), discount_category=discount_category, discount=discount)
            good.drop("value", "valid", "reason", *POSITION).write.mode("overwrite").format(fmt).save(f"{good_path}/batch={number}")
            dead = dead_letters(parsed, number)
            dead.write.mode("overwrite").format(fmt).save(f"{dead_path}/batch={number}")
            if dead_topic and not dead.isEmpty():
                dead_topic(dead_letter_messages(dead))
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate(stream: DataFrame, keys: list[str], time: str, bound: str) -> DataFrame:
    """A stream in which each key comes once, as long as its copies come within ``bound`` of each other by their own time.

    State holds the keys of the last ``bound`` and lets go of older ones, so it
    does not grow with the stream.  A row that is older than the watermark (the
    latest time seen, less the bound) is left out, whether a copy or not; rows
    without a time are left out as well.  The time may lack a zone: it is read
    as a timestamp of the session's, which watermarks need.
    """
    timed = stream.withColumn("__at", F.col(time).cast("timestamp")).where(F.col("__at").isNotNull())
    return timed.withWatermark("__at", bound).dropDuplicatesWithinWatermark(keys).drop("__at")


def read_batches(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """All batches that a consumer has written."""
    return spark.read.schema(schema).format(fmt).load(path)


def latest_messages(df: DataFrame, key: str = "ID", order: str = "last_updated") -> DataFrame:
    """One row per key, its newest: what a sink that is keyed on the id holds after replays and updates."""
    return latest_per_key(df, [key], [F.col(order).desc_nulls_last(), F.xxhash64(*df.columns)])

