"""Rows dealt out once as compressed blobs, for jobs that read one shuffle more than once.

A DataFrame that two jobs read is computed and shuffled twice.  An RDD's shuffle
files serve every job on it, and a union of RDDs with one partitioner is read
partition by partition, in the order of the union, without a shuffle.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession


def stream(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unstream(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def squeeze(*values) -> bytes:
    """Arrays, numbers and strings as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unsqueeze(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def least_type(values: np.ndarray) -> np.ndarray:
    """The same unsigned values in the narrowest type that holds them."""
    top = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def planes(values: np.ndarray) -> tuple[int, bytes]:
    """Unsigned values byte by byte, all lowest bytes first, without the bytes that no value has."""
    values = values.astype("<u8")
    used = max(-(-int(values.max(initial=0)).bit_length() // 8), 1)
    return used, np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8)[:, :used].T).tobytes()


def unplanes(packed: tuple[int, bytes]) -> np.ndarray:
    used, raw = packed
    bytes_of = np.frombuffer(raw, np.uint8).reshape(used, -1)
    out = np.zeros((bytes_of.shape[1], 8), np.uint8)
    out[:, :used] = bytes_of.T
    return out.view("<u8").ravel()


def _part(key: int) -> int:
    return key


def dealt(df: DataFrame, parts: int):
    """An RDD of (part, blob) from a DataFrame of them, dealt out by part."""
    return deal(df.rdd.map(lambda r: (r[0], bytes(r[1]))), parts)


def deal(rdd, parts: int):
    return rdd.partitionBy(parts, _part)


def as_frame(spark: SparkSession, rdd, schema: str) -> DataFrame:
    """A DataFrame of an RDD of Arrow streams with the schema's columns."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield from unstream(blob.as_py()).to_batches()

    return spark.createDataFrame(rdd.map(lambda b: (b,)), "blob binary").mapInArrow(run, schema)
