"""Best-two-fit packing of token sequences (operator 3).

Pieces of one length are alike, so the plan is made over the histogram of
lengths, which has at most ``capacity`` entries at any size of the corpus.  A
bin is filled greedily, longest first; then its smallest piece gives way to two
unpacked pieces that fill the gap it leaves more tightly, for as long as that
helps.  The same bin is repeated while its lengths last, so the plan is a short
list of bins with repeat counts.  Pieces find their place by their rank among
pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import Scratch, byte_batches, crc_of, only, small_batches
from .tokens import encoder_for

#: Groups that lengths are cut into at most, and pieces that are ranked together at least.
GROUPS, CELL = 200_000, 1000


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, pieces of it)], times), for ``counts[length]`` pieces.

    Every piece is placed; each round uses up some length, so there are few rounds.
    """
    left = counts.astype(np.int64).copy()
    size = np.arange(capacity + 1)
    out = []
    while left.any():
        used: dict[int, int] = {}
        gap = capacity
        free = left.copy()
        while True:  # greedily, the longest that fits
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            take = int(fits[-1]) + 1
            n = min(gap // take, int(free[take]))
            used[take] = used.get(take, 0) + n
            free[take] -= n
            gap -= take * n
        while gap and len(used) + sum(used.values()) > 2:  # the smallest for two
            least = min(used)
            pair = best_pair(free, size, gap + least)
            if pair is None or sum(pair) <= least:
                break
            used[least] -= 1
            free[least] += 1
            if not used[least]:
                del used[least]
            for x in pair:
                used[x] = used.get(x, 0) + 1
                free[x] -= 1
            gap += least - sum(pair)
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((sorted(used.items(), reverse=True), times))
    return out


def best_pair(free: np.ndarray, size: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum that fits, if there are two."""
    room = min(room, len(free) - 1)
    below = np.maximum.accumulate(np.where(free > 0, size, 0))  # the longest free one up to x
    first = np.flatnonzero(free[: room + 1] > 0)
    first = first[first > 0]
    if not len(first):
        return None
    second = np.minimum(below[room - first], first)  # the shorter of the two
    alone = (second == first) & (free[first] < 2)
    second = np.where(alone, below[np.maximum(np.minimum(room - first, first - 1), 0)], second)
    total = np.where(second > 0, first + second, 0)
    at = int(np.argmax(total))
    return (int(first[at]), int(second[at])) if total[at] else None


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int, id_col: str, text_col: str, keep_ids: bool = False, batch_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, grp (a number that spreads them) and, if asked, ids."""
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, grp int" + ", ids array<long>" * keep_ids

    def run(batches):
        encoder, seen = encoder_for(tokenizer, 400_000), TaskContext.get().partitionId() << 40
        for batch in byte_batches(batches, batch_bytes):
            ids, n = encoder.encode(batch.column(1).fill_null("").to_pylist())
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            begin = (np.cumsum(n) - n)[row] + start
            crc = [crc_of(ids[a : a + k]) for a, k in zip(begin, length)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array((rolling.mix((np.arange(len(row)) + seen).astype(np.uint64)) >> np.uint64(33)).astype(np.int32))]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
            seen += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "grp", "ids"][: len(columns)])

    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int, cell: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (length, grp and others).

    The driver sees the count of each length, and of each group of about
    ``cell`` pieces that a length is cut into, so that no length fills a task:
    by default 1000, or as many as make 200,000 groups.  Ranks within a group
    are one window.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    cell = cell or max(CELL, -(-int(counts.sum()) // GROUPS))
    groups = np.maximum(-(-counts // cell), 1)
    first = np.cumsum(groups) - groups  # groups of all lengths in a row
    pieces = pieces.withColumn("grp", F.col("grp") % F.get(F.lit(groups.tolist()), F.col("length").cast("int")))
    before = np.zeros(int(groups.sum()), np.int64)
    for length, grp, n in pieces.groupBy("length", "grp").agg(F.count(F.lit(1))).collect():
        before[first[length] + grp] = n
    before = np.cumsum(before) - before
    before -= np.repeat(before[first], groups)  # within its length
    runs, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for items, times in plan_bins(counts, capacity):
        offset = 0
        for length, n in items:
            runs.append((length, int(used[length]), n, base, offset))
            used[length] += n * times
            offset += length * n
        base += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast((first, before, table))
    columns = [c for c in pieces.columns if c != "grp"]
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1)

    def run(batches):
        first, before, table = held.value
        span = 1 << 44  # ranks stay below it
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            length = get["length"].to_numpy()
            rank = get["rank"].to_numpy() + before[first[length] + get["grp"].to_numpy()]
            at = table[np.searchsorted(keys, length * span + rank, "right") - 1] if len(length) else table[:0]
            inside = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(get[c] for c in columns), pa.array(at[:, 3] + inside // np.maximum(at[:, 2], 1)), pa.array(at[:, 4] + inside % np.maximum(at[:, 2], 1) * length)], names=[*columns, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids.

    Documents longer than ``capacity`` ids are cut; others stay whole.  One
    document gives the same pieces however often its row is repeated, and each
    repeat is packed; a null text is empty and has the end id alone; a null id
    stays null; ties in length go by id, piece and crc; an empty table gives an
    empty table; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table("pieces", token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col, keep_ids=keep_ids))
    return place_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pieces that kept their ids: sequence_id, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
