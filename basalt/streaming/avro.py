"""Avro values of messages by Spark's own functions, which come in a package, and a registry's framing.

A framed value is a zero byte, the schema's number in four bytes, and the
record.  Framing is plain columns; ``keyed_avro`` and ``parse_avro`` need the
package ``spark-avro`` on the class path and say so where it is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt import schemas
from basalt.streaming.messages import POSITION, avro_schema


def framed(value: Column, schema_id: int) -> Column:
    """A record behind the number of its schema; a null record stays null."""
    if not 0 <= schema_id < 1 << 31:
        raise ValueError("a schema's number has four bytes")
    return F.concat(F.lit(bytearray(b"\0" + schema_id.to_bytes(4, "big"))), value)


def unframed(value: Column) -> tuple[Column, Column]:
    """The number of a framed value's schema and its record; both null for a value without framing."""
    good = (F.octet_length(value) >= 5) & (F.substring(value, 1, 1) == F.lit(bytearray(b"\0")))
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    return F.when(good, number), F.when(good, F.substring(value, F.lit(6), F.octet_length(value)))


def keyed_avro(df: DataFrame, key: str, *, schema: str | None = None, schema_id: int | None = None) -> DataFrame:
    """One message per row: the key as text, and the row as an Avro record, framed if it has a schema's number."""
    record = F.call_function("to_avro", F.struct("*"), F.lit(schema or avro_schema()))
    return df.select(F.col(key).cast("string").alias("key"), (record if schema_id is None else framed(record, schema_id)).alias("value"))


def parse_avro(messages: DataFrame, *, schema: str | None = None, schema_id: int | None = None, fields: str = schemas.PRODUCT, required: str = "ID") -> DataFrame:
    """Fields, raw value, place, validity and reason, as ``messages.parse`` gives them; a record that cannot be read is invalid."""
    value, reason = F.col("value"), F.when(F.col("value").isNull(), "no value")
    if schema_id is not None:
        number, value = unframed(value)
        reason = reason.when(number.isNull(), "no framing").when(number != schema_id, F.concat(F.lit("unknown schema "), number))
        value = F.when(number == schema_id, value)
    got = messages.withColumn("m", F.call_function("from_avro", value, F.lit(schema or avro_schema()), F.create_map(F.lit("mode"), F.lit("PERMISSIVE"))))
    reason = reason.when(F.col("m").isNull() | F.col(f"m.{required}").isNull(), "no such record")
    names = [f.split()[0] for f in fields.split(", ")]
    return got.select(*(F.col(f"m.{n}").alias(n) for n in names), "value", *(c for c in POSITION if c in messages.columns), reason.alias("reason"), reason.isNull().alias("valid"))
