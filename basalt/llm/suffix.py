"""Exact removal of repeated byte strings (operator 4).

A string of ``length`` bytes that occurs twice holds the same anchor at the
same place: the least-hashed of its k-byte substrings.  Every window of
``length`` bytes so belongs to one anchor, and an anchor's windows lie in one
short segment of text.  Counting anchors and whole segments decides most of
them, by 128 bits of hashes; segments that share an anchor but differ are laid
out along it, and the Burrows-Wheeler transform of the collection of them is
built column by column, from the right, one symbol of each segment a round.  A
round reads the transform and the common prefixes of neighbouring suffixes from
their files, finds from them the place of every segment's next suffix, and
writes both files anew with the new symbols and prefixes in their places.
Windows that are equal stand in the same column, so they meet in one round, as
neighbours with a common prefix of ``length``.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .blobs import as_frame, dealt, stream, unstream
from .common import Scratch, byte_batches, carried, carried_schema, only, release, shuffle_partitions, small_batches

#: The symbol before a whole segment; no byte of UTF-8.
END = 255
#: Bytes of an anchor: windows of 200 bytes have 137 places for one.
ANCHOR = 64


def row_id(doc, text: bytes) -> int:
    """A row's 64-bit number, from its id and text; rows alike in both have the same result."""
    return xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(str(doc).encode()))


def anchors(texts: list[bytes], length: int, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """Anchors of all windows: text, first and last window, anchor's place (in the text), its hash, the segment's hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    empty = {n: np.zeros(0, np.int64) for n in ("text", "first", "last", "place")} | {n: np.zeros(0, np.uint64) for n in ("akey", "segkey")}
    if len(data) < length:
        return empty
    sums = rolling.prefix(data)
    here = np.arange(len(data) - k + 1)
    hashes = rolling.mix(rolling.spans(sums, here, here + k))
    # the least hash of each run of length - k + 1 places, its offset in the low bits: on ties the leftmost
    bits = np.uint64((length - k).bit_length())
    low = (hashes >> bits) << bits
    reach, span = length - k + 1, 1
    while span * 2 <= reach:
        low, span = np.minimum(low[:-span], low[span:] + np.uint64(span)), span * 2
    if reach > span:
        low = np.minimum(low[: -(reach - span)], low[reach - span :] + np.uint64(reach - span))
    many = np.maximum(size - length + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(texts)), many)
    window = np.arange(len(text)) + np.repeat(begin - (np.cumsum(many) - many), many)
    place = window + (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return empty
    first, last, place, text = window[at], window[np.append(at[1:], len(window)) - 1], place[at], text[at]
    segkey = rolling.mix(rolling.spans(sums, first, last + length) + (place - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (last - first).astype(np.uint64) * np.uint64(0x9E6C63D0676A9A99))
    return {"text": text, "first": first - begin[text], "last": last - begin[text], "place": place - begin[text], "akey": hashes[place], "segkey": segkey}


class ColumnFiles:
    """The transform and the common prefixes, written from end to end each round and read again in the next.

    Up to ``held_bytes`` the two are buffers in memory; beyond that they are
    files in the shared folder, read and written there in sequence, so that a
    task's memory does not grow with its collection.  ``close`` removes them; a
    lost executor's files go with the scratch folder, and no other task reads them.
    """

    def __init__(self, folder: str, held_bytes: int):
        self.folder, self.held_bytes, self.name, self.round = folder, held_bytes, uuid.uuid4().hex, 0
        self.buffers = (b"", b"")
        self.files = None

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        if self.files is None:
            return tuple(np.frombuffer(x, np.uint8) for x in self.buffers)
        out = []
        for path in self._paths(self.round):
            with self.files.open_input_stream(path) as source:
                out.append(np.frombuffer(source.read(), np.uint8))
        return tuple(out)

    def write(self, transform: np.ndarray, common: np.ndarray) -> None:
        if self.files is None and len(transform) + len(common) <= self.held_bytes:
            self.buffers = (transform, common)
            return
        if self.files is None:
            where = self.folder if "://" in self.folder else self.folder.removeprefix("file:")
            self.files, self.root = pafs.FileSystem.from_uri(where)
            self.files.create_dir(f"{self.root}/{self.name}", recursive=True)
            self.buffers = ()
        for path, values in zip(self._paths(self.round + 1), (transform, common)):
            with self.files.open_output_stream(path) as sink:
                sink.write(values.tobytes())
        if self.round:
            for path in self._paths(self.round):
                self.files.delete_file(path)
        self.round += 1

    def _paths(self, number: int) -> list[str]:
        return [f"{self.root}/{self.name}/{what}-{number}" for what in ("transform", "common")]

    def close(self) -> None:
        if self.files is not None:
            self.files.delete_dir(f"{self.root}/{self.name}")


def repeated_windows(segments: list[bytes], lead: np.ndarray, length: int, files: ColumnFiles, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Windows of segments that stand elsewhere too: (segment, first byte of the window).

    ``lead`` is the number of a segment's bytes before its anchor, from which
    columns are counted; segments end in different columns, and each enters as
    an empty suffix in the round of the column after its last byte.  As the
    suffixes that start with a symbol stand in the order in which the symbol
    stands in the transform, a new suffix's place follows from the rank of its
    symbol there, and what it has in common with its neighbours is one more than
    the least common prefix between the symbol and its next equal on that side.
    A segment that can no longer share ``length`` symbols with any other ends
    early, unless ``whole`` is asked for.
    """
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    anchor = np.cumsum(size) - size + lead
    enters = {int(c): np.flatnonzero(size - lead == c) for c in np.unique(size - lead)}
    none = np.zeros(0, np.int64)
    segment, place = none, none  # of the suffixes that were inserted last, and have symbols before them
    empty = ended = 0  # suffixes without a symbol, which stand first; segments that are whole
    found_segment, found_first = [], []
    for column in range(max(enters), -int(lead.max()) - 1, -1):
        transform, common = files.read()
        n, new = len(transform), enters.get(column, none)
        turn = np.argsort(transform[place], kind="stable")
        segment, place = segment[turn], place[turn]
        rank, before, after = _by_symbol(transform, place)
        has_before, has_after = before >= 0, after >= 0
        least = _least_between(common, np.concatenate([before[has_before], place[has_after]]) + 1, np.concatenate([place[has_before], after[has_after]]) + 1)
        shared = np.minimum(least, length - 1) + 1
        left, right = np.zeros(len(segment), np.uint8), np.zeros(len(segment), np.uint8)
        left[has_before], right[has_after] = np.split(shared, [int(has_before.sum())])
        at = empty + len(new) + rank  # places of the new suffixes among all
        into = np.concatenate([empty + np.arange(len(new)), at])
        owner = np.concatenate([new, segment])
        ahead = lead[owner] + column
        more = ahead > 0
        if not whole:
            more[len(new) :] &= np.maximum(left, right) + ahead[len(new) :] >= length
        symbols = np.full(len(owner), END, np.uint8)
        symbols[more] = data[anchor[owner[more]] + column - 1]
        old = np.ones(n + len(into), bool)
        old[into] = False
        next_transform, next_common = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        next_transform[old], next_transform[into] = transform, symbols
        next_common[old] = common
        next_common[into[: len(new)]] = 0
        next_common[at] = left
        next_common[at[has_after] + 1] = right[has_after]
        files.write(next_transform, next_common)
        twin = np.maximum(left, right) >= length
        if twin.any():
            found_segment.append(segment[twin])
            found_first.append(lead[segment[twin]] + column)
        empty += len(new)
        ended += int((~more).sum())
        segment, place = owner[more], into[more]
    return (np.concatenate(found_segment), np.concatenate(found_first)) if found_segment else (none, none)


def _by_symbol(transform: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places in the transform, in the order of their symbols: their rank if it were sorted by symbol, and the places of the equal symbols before and after, or -1.

    Works on runs of equal symbols, of which a transform has few.
    """
    n = len(transform)
    if not len(place):
        return place, place, place
    edge = np.ones(n, bool)
    np.not_equal(transform[1:], transform[:-1], out=edge[1:])
    first = np.flatnonzero(edge)
    size = np.diff(first, append=n)
    symbol = transform[first]
    order = np.argsort(symbol, kind="stable")
    run = np.searchsorted(first, place, "right") - 1  # places come by symbol, so these runs stand in this order in ``order`` as well
    held = np.zeros(len(first), bool)
    held[run] = True
    at = np.flatnonzero(held[order])[np.cumsum(np.diff(run, prepend=run[0]) != 0)]
    upto = np.cumsum(size[order])
    begin, end = first[run], first[run] + size[run]
    earlier, later = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(first) - 1)]
    before = np.where(place > begin, place - 1, np.where((at > 0) & (symbol[earlier] == symbol[run]), first[earlier] + size[earlier] - 1, -1))
    after = np.where(place + 1 < end, place + 1, np.where((at + 1 < len(first)) & (symbol[later] == symbol[run]), first[later], -1))
    return upto[at] - size[run] + place - begin, before, after


def _least_between(common: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of common[first:end] for each pair; taken in descending order, so that nothing between pairs is read."""
    if not len(first):
        return np.zeros(0, np.uint8)
    order = np.argsort(-first, kind="stable")
    bounds = np.empty(2 * len(first), np.int64)
    bounds[::2], bounds[1::2] = first[order], end[order]
    out = np.empty(len(first), np.uint8)
    out[order] = np.minimum.reduceat(np.append(common, np.uint8(0)), bounds)[::2]
    return out


def _blobs(batch: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    """The batch's rows by part, each part's as one compressed Arrow stream: part, blob."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        out.append(stream(batch.take(pa.array(order[a:b]))))
    return pa.RecordBatch.from_arrays([pa.array(part[order[cuts]] if len(cuts) else [], pa.int32()), pa.array(out, pa.binary())], names=["part", "blob"])


def _by_row(batches, parts: int):
    for batch in batches:
        if batch.num_rows:
            yield _blobs(batch, (batch.column(0).to_numpy().view(np.uint64) % np.uint64(parts)).astype(np.int32))


def anchor_rows(source: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """akey, segkey, row, pos for every anchor; pos packs first window, windows and lead."""

    def run(batches):
        release()
        for batch in byte_batches(batches, batch_bytes):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            found = anchors(texts, length)
            rows = np.array([row_id(d, t) for d, t in zip(batch.column(0).to_pylist(), texts)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["akey"].view(np.int64)), pa.array(found["segkey"].view(np.int64)), pa.array(rows[found["text"]]), pa.array(_pack(found["first"], found["last"], found["place"]))],
                names=["akey", "segkey", "row", "pos"],
            )

    return source.mapInArrow(run, "akey long, segkey long, row long, pos long")


def _pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    return first << 24 | (last - first) << 12 | (place - first)


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 24, pos >> 12 & 4095, pos & 4095


def _requested(items, take):
    """Calls ``take(row, text, akeys, positions, singles, crowded)`` for each text that is asked for; requests come before texts."""
    asked, rows = [], None
    for _, blob in items:
        table = unstream(blob)
        if "pos" in table.column_names:
            asked.append(table)
            continue
        if not asked:
            continue
        if rows is None:
            held = pa.concat_tables(asked).sort_by("row")
            rows, pos, akey = (held[n].to_numpy() for n in ("row", "pos", "akey"))
            single, crowded = (held[n].to_numpy(zero_copy_only=False) for n in ("single", "crowded"))
        for row, text in zip(table["row"].to_pylist(), table["text"]):
            a, b = np.searchsorted(rows, row, "left"), np.searchsorted(rows, row, "right")
            if a < b:
                yield from take(row, text.as_py(), akey[a:b], pos[a:b], single[a:b], crowded[a:b])


def _batched(rows, kinds: dict, size: int):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield stream(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds)))
            held = []
    if held:
        yield stream(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds)))


def repeated_spans(source: DataFrame, texts, parts: int, scratch: Scratch, length: int, batch_bytes: int, segments_at_once: int, held_bytes: int, crowd: int):
    """row, first, end of repeated bytes, dealt out by row as blobs; spans of one row may overlap."""
    spark = source.sparkSession
    found = scratch.table("found", anchor_rows(source, length, batch_bytes), compression="lz4")
    # counted by anchor and segment together, and by anchor from partial sums: no task holds all segments of an anchor
    counted = found.groupBy("akey", "segkey").agg(F.count(F.lit(1)).alias("n"))
    anchors_of = counted.groupBy("akey").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1").select("akey", "kinds")
    kept = scratch.table("segments", counted.join(anchors_of.hint("merge"), "akey").select("akey", "segkey", "n", "kinds"))
    marked = scratch.table("anchors", found.join(kept, ["akey", "segkey"]).select("akey", "segkey", "row", "pos", "kinds", "n"))
    scratch.drop("found")

    first, windows = F.shiftright("pos", 24), F.shiftright("pos", 12).bitwiseAND(F.lit(4095))
    covers = marked.where("n > 1").select("row", first.alias("first"), (first + windows + length).alias("end"))
    crowded = (F.col("kinds") > crowd).alias("crowded")
    wanted = marked.where("kinds > 1 and n = 1").select("row", "pos", "akey", crowded, F.lit(True).alias("single"))
    shared = marked.where("kinds > 1 and n > 1").groupBy("akey", "segkey").agg(F.min(F.struct("row", "pos", "kinds")).alias("one")).select("one.*", "akey")
    wanted = wanted.union(shared.select("row", "pos", "akey", crowded, F.lit(False)))
    requests = spark.sparkContext.union([dealt(wanted.mapInArrow(lambda b: _by_row(b, parts), "part int, blob binary"), parts), texts])
    kinds = {"akey": pa.int64(), "row": pa.int64(), "first": pa.int64(), "lead": pa.int32(), "single": pa.bool_(), "bytes": pa.binary()}
    pieces = as_frame(spark, requests.mapPartitions(lambda items: _batched(_pieces(items, length), kinds, 8192)), "akey long, row long, first long, lead int, single boolean, bytes binary")
    grouped = pieces.repartition(parts, "akey").sortWithinPartitions("akey")
    folder = scratch.path("columns")

    def sort_columns(batches):
        release()
        for table in _whole_anchors(batches, segments_at_once):
            twice = _equal_windows(table, length)
            if twice is not None:
                yield twice
                table = table.filter(pc.greater_equal(table["lead"], 0))
            lead, single, row, start = (table[n].to_numpy(zero_copy_only=False) for n in ("lead", "single", "row", "first"))
            if not len(lead):
                continue
            files = ColumnFiles(folder, held_bytes)
            try:
                segment, window = repeated_windows(table["bytes"].to_pylist(), lead.astype(np.int64), length, files)
            finally:
                files.close()
            own = single[segment]
            segment, window = segment[own], window[own]
            rank = np.lexsort((window, segment))
            segment, window = segment[rank], window[rank]
            new = np.ones(len(segment), bool)
            new[1:] = (np.diff(segment) != 0) | (np.diff(window) != 1)
            at = np.flatnonzero(new)
            last = window[np.append(at[1:], len(window)) - 1] if len(at) else window[at]
            base = start[segment[at]]
            yield pa.RecordBatch.from_arrays([pa.array(row[segment[at]]), pa.array(base + window[at]), pa.array(base + last + length)], names=["row", "first", "end"])

    kind = "part int, blob binary"
    found = covers.mapInArrow(lambda b: _by_row(b, parts), kind).union(grouped.mapInArrow(lambda b: _by_row(sort_columns(b), parts), kind))
    return dealt(found, parts)


def _pieces(items, length: int):
    """(akey, row, first, lead, single, bytes) of every segment that is asked for.

    A crowded anchor's segment gives its windows instead, each under a key of
    its own content: lead -1, and 16 bytes of hash.  Windows that the partition
    has more than once are one row here, and their places are sure already:
    lead -2.
    """
    alone: dict[tuple[int, bytes], tuple[int, int, bool]] = {}

    def cut(row, data, akey, pos, single, crowded):
        start, many, lead = _unpack(pos)
        for i in range(len(pos)):
            s, n = int(start[i]), int(many[i])
            if not crowded[i]:
                yield int(akey[i]), row, s, int(lead[i]), bool(single[i]), data[s : s + n + length]
                continue
            for at in range(s, s + n + 1):
                digest = xxhash.xxh3_128_digest(data[at : at + length])
                key = (int(akey[i]) ^ int.from_bytes(digest[:8], "little", signed=True), digest)
                if key not in alone:
                    alone[key] = (row, at, bool(single[i]))
                    continue
                before = alone[key]
                if before[2]:
                    alone[key] = (*before[:2], False)
                    yield _anywhere(*before[:2]), *before[:2], -2, True, None
                if single[i]:
                    yield _anywhere(row, at), row, at, -2, True, None

    yield from _requested(items, cut)
    for (key, digest), (row, at, single) in alone.items():
        yield key, row, at, -1, single, digest


def _anywhere(row: int, at: int) -> int:
    """A key for a window that is settled: of its place, so that a hot window's rows do not go to one task."""
    return row ^ at << 20


def _equal_windows(table: pa.Table, length: int) -> pa.RecordBatch | None:
    """Spans of the windows of crowded anchors that are there twice, or are known to be; None if the table has no such windows."""
    own = table.filter(pc.less(table["lead"], 0))
    if not own.num_rows:
        return None
    lead, first, row = (own[n].to_numpy() for n in ("lead", "first", "row"))
    keys = own["bytes"].combine_chunks().fill_null(b"").dictionary_encode().indices.to_numpy()
    both = np.stack([own["akey"].to_numpy(), keys.astype(np.int64)])
    _, back, many = np.unique(both, axis=1, return_inverse=True, return_counts=True)
    hit = (lead == -2) | ((many[back.ravel()] > 1) & own["single"].to_numpy(zero_copy_only=False))
    return pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array(first[hit]), pa.array(first[hit] + length)], names=["row", "first", "end"])


def _whole_anchors(batches, at_once: int):
    """Sorted batches joined to tables of about ``at_once`` segments that cut no anchor's group."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            table = pa.Table.from_batches([batch.slice(at, at_once)])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < at_once:
                continue
            key = held["akey"].to_numpy()
            last = np.flatnonzero(key != key[-1])
            if len(last):
                yield held.slice(0, int(last[-1]) + 1)
                held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batch_bytes: int = 1 << 20, segments_at_once: int = 2048, held_bytes: int = 16 << 20, crowd: int = 1000, keep_text: bool = False, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes
    and the text that they are, without characters that were cut apart.

    Removes every byte that lies in a string of ``length`` bytes that starts
    anywhere else in the table, the same text included; strings are judged on
    the input.  A null text is empty; texts shorter than ``length`` keep all;
    ``length`` is 65 to 255 bytes; repeated rows and copies repeat each other and lose all; a null id stays
    null; an empty table gives none; other columns are not read, but for
    ``carry``, which comes back with its row.

    The segments of about ``segments_at_once`` go into one transform, which is
    in memory up to ``held_bytes`` and in files of the shared folder beyond.  An
    anchor that over ``crowd`` different segments share is a passage cut off in
    ever other places, and would fill a task: its windows are dealt out one by
    one, by their content, and found by counting it (128 bits of hashes).

    The texts are shuffled once, compressed; both jobs that need them by row
    read that one shuffle.
    """
    if not ANCHOR < length < 256:
        raise ValueError("length is from 65 to 255 bytes")
    spark = docs.sparkSession
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    scratch = Scratch(spark, "suffix")
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    parts = shuffle_partitions(source)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))

    def number(batches):
        release()
        for batch in byte_batches(batches, 4 * batch_bytes):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            rows = np.array([row_id(d, t) for d, t in zip(batch.column(0).to_pylist(), texts)], np.uint64).view(np.int64)
            table = pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), pa.array(texts, pa.binary()), *batch.columns[2:]], names=["row", "doc_id", "text", *batch.schema.names[2:]])
            yield _blobs(table, (rows.view(np.uint64) % np.uint64(parts)).astype(np.int32))

    texts = dealt(own.mapInArrow(number, "part int, blob binary"), parts)
    spans = repeated_spans(source, texts, parts, scratch, length, batch_bytes, segments_at_once, held_bytes, crowd)

    def finish(items):
        marks = []
        for _, blob in items:  # the spans come before the texts
            table = unstream(blob)
            if "first" in table.column_names:
                marks.append(table)
                continue
            if marks and isinstance(marks[0], pa.Table):
                held = pa.concat_tables(marks)
                rank = np.lexsort((held["first"].to_numpy(), held["row"].to_numpy()))
                marks = [tuple(held[n].to_numpy()[rank] for n in ("row", "first", "end"))]
            out = []
            for row, text in zip(table["row"].to_pylist(), table["text"]):
                data = text.as_py()
                runs = []
                if marks:
                    a, b = np.searchsorted(marks[0][0], row, "left"), np.searchsorted(marks[0][0], row, "right")
                    runs = merge_spans(marks[0][1][a:b], marks[0][2][a:b])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, kept.decode(errors="ignore")))
            columns = list(zip(*out))
            arrays = [table["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())))]
            more = [n for n in table.column_names if n == "carried"]
            own = 5 + 2 * keep_text
            names = [*["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"][:own], *more]
            yield stream(pa.RecordBatch.from_arrays([*arrays[:own], *(table[n].combine_chunks() for n in more)], names=names))

    done = spark.sparkContext.union([spans, texts]).mapPartitions(finish)
    return as_frame(spark, done, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * keep_text + carried_schema(docs, carry, text=False))


def merge_spans(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans in ascending order of their first bytes; touching spans are one run."""
    out: list[list[int]] = []
    for a, b in zip(first.tolist(), end.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
