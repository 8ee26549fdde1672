"""Shared pieces: text columns, Arrow batches, ids."""

from __future__ import annotations

import ctypes
import gc
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.workspace import Scratch, shared_root

__all__ = ["Scratch", "byte_batches", "carried", "carried_schema", "crc_of", "id_crc", "kept_model", "only", "read_table", "release", "shared_root", "shuffle_partitions", "small_batches"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Rows of text are long: where the session has Spark's default of 10,000 rows to an Arrow batch, takes fewer.

    It bounds what a task holds in the JVM and in Python.  Spark has no such
    setting for one query alone, so the session keeps it; a number that the
    session's owner has chosen stays as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(rows))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: whatever else the table carries cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def carried(carry: str | None) -> list[Column]:
    """The column that travels with its row through an operator, if any; no operator has one of this name."""
    return [F.col(f"`{carry}`").alias("carried")] if carry else []


def carried_schema(df: DataFrame, carry: str | None, text: bool = True) -> str:
    """Schema of what travels: the text, if it does, and the column."""
    return ", text string" * text + f", carried {df.schema[carry].dataType.simpleString()}" if carry else ""


def _return_freed_arrays() -> None:
    """Has the C library of a worker give large freed arrays back to the system, so that it holds what it uses.

    Otherwise its bound for that rises with the arrays it has seen, to 32 MB;
    a bound much lower costs a tenth of the time in page faults.  Only tasks
    call this, once a worker; the driver's process is left as it is.
    """
    global _returns
    if _returns:
        return
    _returns = True
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


_returns = False
_KEPT: dict[str, object] = {}


def kept_model(name: str, make):
    """A worker's model of this name, kept from task to task; a worker holds one model at a time."""
    _return_freed_arrays()
    if name not in _KEPT:
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Gives back what earlier tasks of other operators have left in this worker."""
    _return_freed_arrays()
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def id_crc(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes()) & 0xFFFFFFFF


def byte_batches(batches, most: int, column: str = "text"):
    """Cuts Arrow batches into slices of about ``most`` bytes of ``column``; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for row, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(first, row - first)
                total, first = 0, row
            total += int(size)
        yield batch.slice(first)


def shuffle_partitions(df: DataFrame, part_bytes: int = 64 << 20) -> int:
    """How many parts a table is dealt to: the session's number, or more if parts of ``part_bytes`` are more.

    The size is that of the files, as the optimizer knows it; tables that are
    not in files have no known size.
    """
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-known // part_bytes) if known < 1 << 58 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), wanted)
