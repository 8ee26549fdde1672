"""Vector codes: product quantisation by Lloyd's rounds with Hamerly's bounds (operator 12).

A vector's components become integers and are cut into equal parts; every part
position has a codebook of its own.  All distances are squared and integer, so
they are exact.  From round to round each part of each row keeps its entry, an
upper bound of its distance to that entry and a lower bound of its distance to
the second nearest.  When entries have moved, the bounds are loosened by their
moves; only where they fail is a part compared with the whole codebook.

Bounds are distances, not squares, as 32-bit floats rounded outwards: an upper
bound that lies strictly under the lower one proves that no other entry is as
near, so a tie can never hide behind it, and ties go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.joins import broadcast_if_small

from .common import Scratch, release

#: Scaled components are smaller than this in size: squared distances then fit 64 bits for parts of up to 127 components.
RANGE = 1 << 27


def _up(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(distance.astype(np.float32), np.float32(np.inf))


def _down(distance: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(distance.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to all entries of a codebook, as integers."""
    total = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        total += (x[:, j, None] - book[None, :, j]) ** 2
    return total


class Lloyd:
    """The entries of all part positions, as (position, entry, component), and how far each has moved since the round before."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books = books
        positions, entries, _ = books.shape
        apart = np.stack([squares(b, b) for b in books]).astype(np.float64)
        apart[:, np.arange(entries), np.arange(entries)] = np.inf
        self.half = _down(np.sqrt(apart.min(axis=2, initial=np.inf)) / 2)  # nearer than that, no other entry is as near
        self.moved = np.zeros((positions, entries), np.float32)
        if before is not None:
            self.moved = np.where((books == before).all(axis=2), np.float32(0), _up(np.sqrt(((books - before) ** 2).sum(axis=2).astype(np.float64))))
        furthest = np.sort(np.concatenate([self.moved, np.zeros((positions, 1), np.float32)], axis=1), axis=1)
        most, second = furthest[:, -1:], furthest[:, -2:-1]
        self.others = np.where(self.moved == most, np.where((self.moved == most).sum(axis=1, keepdims=True) > 1, most, second), most)  # the furthest that any other has moved

    def scan(self, x: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Against the whole codebook: the nearest entry, its squared distance, and both bounds."""
        d = squares(x, self.books[position])
        entry = d.argmin(axis=1)
        nearest = d[np.arange(len(d)), entry]
        second = np.full(len(d), np.inf)
        if d.shape[1] > 1:
            d[np.arange(len(d)), entry] = np.iinfo(np.int64).max
            second = d.min(axis=1).astype(np.float64)
        return entry.astype(np.uint8), nearest, _up(np.sqrt(nearest.astype(np.float64))), _down(np.sqrt(second))

    def assign(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows of (position, component) and their (entry, upper, lower), if they have been assigned before; the new ones, and how many parts were scanned in full."""
        n, positions, _ = x.shape
        if state is None:
            found = [self.scan(x[:, p], p) for p in range(positions)]
            entry, _, upper, lower = (np.stack(f, axis=1) for f in zip(*found))
            return entry, upper, lower, n * positions
        entry, upper, lower = (a.copy() for a in state)
        at = np.arange(positions)[None, :]
        moved, others = self.moved[at, entry], self.others[at, entry]
        upper = np.where(moved > 0, _up(upper.astype(np.float64) + moved), upper)
        lower = np.where(others > 0, _down(np.maximum(lower.astype(np.float64) - others, 0)), lower)
        bound = np.maximum(lower, self.half[at, entry])
        scans = 0
        for p in range(positions):
            loose = np.flatnonzero(~(upper[:, p] < bound[:, p]))
            if not len(loose):
                continue
            own = ((x[loose, p] - self.books[p][entry[loose, p]]) ** 2).sum(axis=1)
            upper[loose, p] = _up(np.sqrt(own.astype(np.float64)))
            fail = loose[~(upper[loose, p] < bound[loose, p])]
            if len(fail):
                entry[fail, p], _, upper[fail, p], lower[fail, p] = self.scan(x[fail, p], p)
                scans += len(fail)
        return entry, upper, lower, scans

    def errors(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over the parts."""
        positions = x.shape[1]
        return ((x - self.books[np.arange(positions)[None, :], entry]) ** 2).sum(axis=(1, 2))


def kept(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def seeds(source: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The codebooks to start from: (position, entry, component); None if no vector can be cut.

    Two bounded top-k reports: the row of the least id fixes the length.
    """
    order = [F.col("id").asc_nulls_last(), F.col("scaled")]
    usable = source.where((F.size("scaled") > 0) & (F.size("scaled") % parts == 0) & F.col("fits")).select("id", "scaled")
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return None
    size = len(first[0]["scaled"])
    rows = usable.where(F.size("scaled") == size).orderBy(*order).limit(entries).collect()
    return np.array([r["scaled"] for r in rows], np.int64).reshape(len(rows), parts, size // parts).transpose(1, 0, 2).copy()


def _components(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), parts, -1).astype(np.int64)


def _bytes_of(values: np.ndarray, kind: str) -> pa.Array:
    """One binary value a row."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values, kind)], pa.binary())


def compress_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256, label.

    A component x becomes floor(``scale`` * x).  Codebooks start as the parts of
    the ``entries`` least ids, are moved ``rounds`` times to the floors of their
    parts' means, and parts are assigned once more at the end.

    Rows whose vector is null or has a null, NaN or infinite component are
    dropped; one row per other input row, repeated rows included.  Null ids come
    last when the first entries are chosen, equal ids go by their components.
    The length is that of the least id whose vector can be cut into ``parts``:
    a vector of another length (an empty one, too) and one with a scaled
    component of ``RANGE`` or more has a null code and error and moves no entry.
    Fewer rows than entries make fewer entries, entries without parts stay, equal
    labels and null labels are summed up, a sum without any error is null; an
    empty table gives an empty one.  Other columns are not read.

    The driver holds the codebooks alone (parts x entries).  Each round reads
    the rows' state from a table in the shared folder and writes the next one:
    the only shuffles are those of each task's sums by entry and of errors by
    label, both summed up before they are sent.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits: 1 to 256 entries")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vector-codes")
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    scaled = F.transform(vector, lambda x: F.floor(x * float(scale)))
    source = vectors.where(kept(vector)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), scaled.alias("scaled"))
    source = source.withColumn("fits", F.forall("scaled", lambda x: (x < RANGE) & (x > -RANGE)))
    books = seeds(source, parts, entries)
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("id", "label")}
    names = ["vec_id", "code", "error", "label"]
    if books is None:
        books = np.zeros((parts, 0, 0), np.int64)
        done = source.select(F.col("id").alias("vec_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label")
    else:
        size = books.shape[0] * books.shape[2]
        usable = F.col("fits") & (F.size("scaled") == size)
        flat = source.select("id", "label", F.when(usable, F.col("scaled").cast("array<int>")).alias("scaled"))
        state = scratch.table("state-0", flat.mapInArrow(_first(books), f"id {kinds['id']}, label {kinds['label']}, {_STATE}"))
        for number in range(1, rounds + 1):
            before, books = books, _moved(state, books)
            step = _next(books, before, last=number == rounds)
            kind = f"vec_id {kinds['id']}, code string, error long, label {kinds['label']}" if number == rounds else state.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
            state = scratch.table(f"state-{number}", state.mapInArrow(step, kind))
            scratch.drop(f"state-{number - 1}")
        done = state if rounds else scratch.table("done", state.mapInArrow(_next(books, books, last=True), f"vec_id {kinds['id']}, code string, error long, label {kinds['label']}"))
    text = ",".join(map(str, books.reshape(-1).tolist()))
    done = done.select(*names)
    totals = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    totals = scratch.table("totals", totals)
    joined = done.join(broadcast_if_small(totals), F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"), "label")


#: Scaled components, the entry of each part, and its bounds; all null for a vector that cannot be coded.
_STATE = "scaled binary, entry binary, upper binary, lower binary"


def _first(books: np.ndarray):
    """Assigns every part by a scan of its whole codebook."""

    def run(batches):
        release()
        lloyd = Lloyd(books)
        for batch in batches:
            lists = batch.column(2)
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            x = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(good), books.shape[0], -1) if len(good) else np.zeros((0, books.shape[0], books.shape[2]), np.int64)
            yield _state(batch, good, x, *lloyd.assign(x, None)[:3])

    return run


def _state(batch: pa.RecordBatch, good: np.ndarray, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    place = np.full(batch.num_rows, -1)
    place[good] = np.arange(len(good))
    at = pa.array(place, mask=place < 0)
    columns = [_bytes_of(v, kind).take(at) for v, kind in ((x, "<i4"), (entry, "u1"), (upper, "<f4"), (lower, "<f4"))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "label", "scaled", "entry", "upper", "lower"])


def _read(batch: pa.RecordBatch, positions: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that have a state, their components and the state."""
    good = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
    own = batch.take(pa.array(good))
    x = _components(own.column(2), positions) if len(good) else np.zeros((0, positions, 1), np.int64)
    state = tuple(np.frombuffer(b"".join(own.column(i).to_pylist()), kind).reshape(len(good), positions) for i, kind in ((3, "u1"), (4, "<f4"), (5, "<f4")))
    return good, x, state


def _next(books: np.ndarray, before: np.ndarray, last: bool):
    """Assigns parts by their bounds; the last time gives codes and errors."""

    def run(batches):
        release()
        lloyd = Lloyd(books, before)
        for batch in batches:
            good, x, state = _read(batch, books.shape[0])
            entry, upper, lower, _ = lloyd.assign(x, state)
            if not last:
                yield _state(batch, good, x, entry, upper, lower)
                continue
            codes, errors = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            codes[good] = [bytes(row).hex() for row in entry]
            lost = np.ones(batch.num_rows, bool)
            lost[good] = False
            if len(good):
                errors[good] = lloyd.errors(x, entry)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(errors, mask=lost), batch.column(1)], names=["vec_id", "code", "error", "label"])

    return run


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries at the floors of their parts' means; each task sends one sum an entry."""
    positions, entries, width = books.shape
    sums = ", ".join(f"s{j} long" for j in range(width))

    def run(batches):
        release()
        many, total = np.zeros(positions * entries, np.int64), np.zeros((width, positions * entries), np.int64)
        for batch in batches:
            _, x, (entry, _, _) = _read(batch, positions)
            if not len(x):
                continue
            place = (np.arange(positions)[None, :] * entries + entry).ravel()
            many += np.bincount(place, minlength=len(many))
            order = np.argsort(place, kind="stable")
            used, first = np.unique(place[order], return_index=True)
            for j in range(width):  # sums of integers, exact beyond what a float holds
                total[j, used] += np.add.reduceat(x[:, :, j].ravel()[order], first)
        used = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(many[used]), *(pa.array(t[used]) for t in total)], names=["place", "n", *(f"s{j}" for j in range(width))])

    rows = state.mapInArrow(run, f"place long, n long, {sums}").groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).collect()
    new = books.copy()
    for r in rows:
        new[r["place"] // entries, r["place"] % entries] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return new
