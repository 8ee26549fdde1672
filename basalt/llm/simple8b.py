"""Token-ID files in Simple-8b, word-aligned (operator 1).

A 64-bit word has a selector in its top four bits and, by the selector, a
number of ids of equal width in the other sixty.  Ids are coded in blocks of
``BLOCK``; a block starts a new word, and each shard lists where its blocks
start, so that blocks decode apart from each other and all at once.  An id of
2**60 or more is an escape: a word with selector 15 alone, then the id itself.

A shard is: magic, its part and number there, counts, document ids with a validity byte each, ids per
document, first word of each block, words.  Integers are little-endian.  A
file holds one shard and ends with a line end, which belongs to the format.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, crc_of, only, shuffle_partitions, small_batches
from .tokens import encoder_for

#: Simple-8b's bits per id and ids per word, by selector.
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
ESCAPE = 15
BLOCK = 128
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIIQQQ")


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block, of unsigned 64-bit ids.

    All blocks advance together, one word each a step; the packing itself is
    one pass per selector.
    """
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint64)
    padded[:n] = ids
    held = np.full(blocks, block, np.int64)
    held[-1] = n - (blocks - 1) * block
    best = np.full((blocks, block), ESCAPE, np.uint8)
    top = int(ids.max())
    small = padded.astype(np.uint32) if top < 1 << 32 else padded
    for s in range(len(BITS) - 1, -1, -1):
        if s and top < 1 << int(BITS[s - 1]):
            continue  # the selector before holds more ids and fits them all
        fits = np.ones((blocks, block + int(COUNT[s])), bool)  # what lies beyond a block fits
        fits[:, :block] = (small < 1 << int(BITS[s])).reshape(blocks, block)
        span = 1
        while span * 2 <= COUNT[s]:
            fits, span = fits[:, :-span] & fits[:, span:], span * 2
        rest = int(COUNT[s]) - span
        if rest:
            fits = fits[:, :-rest] & fits[:, rest:]
        np.putmask(best, fits[:, :block], np.uint8(s))
    step = np.append(COUNT, [0, 1])[best]  # by position: how far its word goes
    base = np.arange(blocks, dtype=np.int64) * block
    pos, live, starts, owners = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(live):
        here = base[live] + pos[live]
        starts.append(here)
        owners.append(live)
        pos[live] += step.ravel()[here]
        live = live[pos[live] < held[live]]
    starts = np.sort(np.concatenate(starts))
    selector = best.ravel()[starts]
    size = 1 + (selector == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    tail = np.concatenate([padded, np.zeros(64, np.uint64)])
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[own] + 1] = padded[starts[own]]
            continue
        word = np.full(len(own), np.uint64(int(s)) << np.uint64(60))
        end = (starts[own] // block + 1) * block
        for j in range(int(COUNT[s])):
            spot = starts[own] + j
            word |= np.where(spot < end, tail[spot], np.uint64(0)) << np.uint64(j * int(BITS[s]))
        words[place[own]] = word
    first = place[np.searchsorted(starts, base)]
    return words, first.astype(np.uint32)


def decode_ids(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids, by one pass per selector over all words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # the word after an escape is an id, whatever its top bits
        literal = np.zeros(len(words), bool)
        for i in np.flatnonzero(selector == ESCAPE):
            if not literal[i]:
                literal[i + 1] = True
    else:
        literal = np.zeros(len(words), bool)
    holds = np.append(COUNT, [0, 0])[selector]
    holds[literal] = 1
    blocks = len(first)
    owner = np.zeros(len(words), np.int64)
    owner[first[1:].astype(np.int64)] = 1
    owner = np.cumsum(owner)
    before = np.cumsum(holds) - holds
    start = owner * block + before - before[first.astype(np.int64)][owner]
    end = np.minimum((np.arange(blocks) + 1) * block, n)[owner]
    out[start[literal]] = words[literal]
    for s in np.unique(selector[~literal]):
        if s == ESCAPE:
            continue
        own = np.flatnonzero((selector == s) & ~literal)
        mask = (np.uint64(1) << BITS[s]) - np.uint64(1)
        for j in range(int(COUNT[s])):
            spot = start[own] + j
            fits = spot < end[own]
            out[spot[fits]] = (words[own[fits]] >> np.uint64(j * int(BITS[s]))) & mask
    return out


def pack_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, part: int, number: int) -> bytes:
    """One shard's bytes; ``part`` is the range of documents it belongs to, ``number`` its place there."""
    words, first = encode_ids(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        _HEAD.pack(MAGIC, part, number, len(doc_ids), len(ids), len(words)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), lengths.astype("<u8").tobytes(),
        first.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def unpack_shard(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """Part, number, document ids, ids per document, all ids."""
    magic, part, number, docs, n, n_words = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b shard")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, known, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    first, words = take("<u4", -(-n // BLOCK)), take("<u8", n_words)
    return part, number, [int(d) if k else None for d, k in zip(doc_ids, known)], lengths.astype(np.int64), decode_ids(words, first, n)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20, batch_bytes: int = 2 << 20) -> None:
    """Writes the ids of all documents, in ascending id order, as shard files under ``path``.

    Documents are dealt out by ranges of the id (equal ids by the text's hash,
    so that one id cannot fill a task) and sorted within; texts are shuffled
    once, and Spark's committer writes the files, so that lost executors cost
    their own tasks only.  A shard holds about ``shard_ids`` ids, and at least
    one document.  The files hold ids as 64-bit integers: one that is none counts
    as null; null ids come first; a null text is empty and has the end id alone.
    """
    small_batches(docs)
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").try_cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange(shuffle_partitions(source), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches):
        encoder, part = encoder_for(tokenizer), TaskContext.get().partitionId()
        held_docs, held_n, held_ids, total, number = [], [], [], 0, 0

        def shard():
            data = pack_shard(held_docs, np.concatenate(held_n), np.concatenate(held_ids), part, number)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

        for batch in byte_batches(batches, batch_bytes):
            ids, n = encoder.encode(batch.column(1).fill_null("").to_pylist())
            with_end = np.insert(ids, np.cumsum(n), end_id)
            held_docs += batch.column(0).to_pylist()
            held_n.append(n + 1)
            held_ids.append(with_end)
            total += len(with_end)
            if total >= shard_ids:
                yield shard()
                held_docs, held_n, held_ids, total, number = [], [], [], 0, number + 1
        if held_docs:
            yield shard()

    shards = ordered.select("doc_id", "text").mapInArrow(run, "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """Reads shard files: part, number (of the shard), place, doc_id, n_tokens, ids_crc32 and, if asked, ids."""
    kind = "part long, number long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                part, number, docs, lengths, ids = unpack_shard(data.as_buffer().to_pybytes())
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                columns = [pa.array([part] * len(docs), pa.int64()), pa.array([number] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64()), pa.array(lengths, pa.int64())]
                columns.append(pa.array([crc_of(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64()))
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kind.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, kind)


def token_file_digest(docs: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32.

    One row per input row, repeated rows and ties included; ``start`` counts
    the ids of all rows before it in the files.  An empty table gives none.
    Only the totals of the parts, one number per shuffle partition, come to the
    driver; starts within a part are sums over that part's rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    write_token_files(docs, scratch.path("files"), tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    back = scratch.table("read", read_token_files(spark, scratch.path("files")))
    before, rows = 0, []
    for part, n in sorted(back.groupBy("part").agg(F.sum("n_tokens")).collect()):
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part long, before long")
    inside = Window.partitionBy("part").orderBy("number", "place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        back.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "part")  # one row per shuffle partition
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
