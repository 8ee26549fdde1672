"""SimHash near-duplicates by pigeonring filtering (operator 6).

A 64-bit fingerprint is a ring of segments.  If two differ in at most ``tau``
bits, then from some segment on every chain of consecutive segments differs in
at most its proportional share of ``tau``.  The first segments' share is zero:
they are the index key.  Buckets too large for one task are dealt out further
along the chain: by the next segment, with as many changed bits as the budget
still allows.  Within a bucket the whole chain prunes before the full check,
and a spanning forest of the links is all that leaves it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling, verify
from .common import Scratch, byte_batches, only, release, shuffle_partitions, small_batches
from .components import connected_components

_BITS = np.array([[b >> j & 1 for j in range(8)] for b in range(256)], np.int64)


#: Buckets of at most so many rows are paired together, larger ones one by one.
SMALL = 32

#: Min-wise hashes of a set of shingles: so many bands of so many.  Sets 0.8 alike share no band with probability (1 - 0.8**4)**20 < 3e-5.
BANDS, BAND = 20, 4
_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit hashes, as a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    bits = np.einsum("ij,ijk->ik", counts.reshape(8, 256), np.broadcast_to(_BITS, (8, 256, 8))) * 2 > n
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``k`` lower-cased words, repeats included; fewer words: of all of them."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(k, len(words))
    first = (end - size)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(first, end[k - 1 :].tolist())], np.uint64)


def budgets(tau: int, segments: int) -> list[int]:
    """Bits that a chain of 1, 2, ... segments may differ in."""
    return [tau * n // segments for n in range(1, segments + 1)]


def borders(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def _links(batch: dict[str, np.ndarray], tau: int, segments: int, extra) -> tuple[np.ndarray, np.ndarray]:
    """Nodes joined by a link within the buckets of one sorted batch: a spanning forest."""
    fp = batch["fp"].view(np.uint64)
    cut = borders(segments)
    share = budgets(tau, segments)
    n = len(fp)
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum((np.diff(batch["key"]) != 0) | (np.diff(batch["ring"]) != 0))
    turned = np.zeros(n, np.uint64)
    for ring in np.unique(batch["ring"]):
        own = batch["ring"] == ring
        turned[own] = _rotated(fp[own], cut[ring])
    # lengths of chains depend on where the ring starts, if segments are of unequal length
    steps = np.array([[(cut[(r + k) % segments + 1] - cut[r]) % 64 or 64 for k in range(segments)] for r in range(segments)])
    checks = [k for k in range(segments) if k == segments - 1 or share[k + 1] > share[k]]
    label = np.arange(n)
    held_a, held_b, held = [], [], 0

    def keep_links(a: np.ndarray, b: np.ndarray) -> None:
        """Of pairs of rows within ``tau`` bits, those whose whole chain keeps to its budget."""
        nonlocal label, held_a, held_b, held
        ok = (batch["used"][a] == 0) | (batch["used"][b] == 0)
        a, b = a[ok], b[ok]
        diff = turned[a] ^ turned[b]
        for k in checks:
            keep = np.bitwise_count(diff >> (64 - steps[batch["ring"][a], k]).astype(np.uint64)) <= share[k]
            a, b, diff = a[keep], b[keep], diff[keep]
        if extra is not None and len(a):
            keep = extra(batch, a, b)
            a, b = a[keep], b[keep]
        held_a, held_b, held = [*held_a, a], [*held_b, b], held + len(a)
        if held > 1_000_000:
            label = _forest(label, np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [], [], 0

    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(cuts, n))
    for first, size in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = turned[first : first + size]
        indexed = int((batch["used"][first : first + size] == 0).sum())  # they stand first; probes do not pair with probes
        for i in range(0, indexed, 256):
            near = np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= tau
            a, b = np.nonzero(near)
            a, b = a[b > a], b[b > a]
            keep_links(first + i + a, first + i + b)
    at, apart = np.flatnonzero((sizes <= SMALL)[group]) if n else np.zeros(0, np.int64), 1
    while True:
        at = at[at < n - apart]
        at = at[group[at] == group[at + apart]]
        if not len(at):
            break
        keep_links(at, at + apart)
        apart += 1
    if held:
        label = _forest(label, np.concatenate(held_a), np.concatenate(held_b))
    joined = np.flatnonzero(label != np.arange(n))
    return batch["node"][joined], batch["node"][label[joined]]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component, given earlier labels and new links."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new[a] == new[b]).all() and (new == new[new]).all():
            return new
        label = new


def _whole_groups(batches):
    """Joins sorted Arrow batches so that no bucket is cut: dicts of arrays."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 50_000:
            continue
        key, ring = held["key"].to_numpy(), held["ring"].to_numpy()
        last = np.flatnonzero((key != key[-1]) | (ring != ring[-1]))
        if len(last):
            yield held.slice(0, int(last[-1]) + 1)
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield held


def _deal_on(batches, level: int, tau: int, segments: int):
    """Rows of hot buckets, one segment further: the exact value, and values within the budget for probes."""
    cut, share = borders(segments), budgets(tau, segments)
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ring, used = cols["ring"].to_numpy(), cols["used"].to_numpy()
        fp = cols["fp"].to_numpy().view(np.uint64)
        key = cols["key"].to_numpy().view(np.uint64)
        for r in np.unique(ring):
            s = (int(r) + level) % segments
            bits = cut[s + 1] - cut[s]
            for d in range(share[level] + 1):
                own = np.flatnonzero((ring == r) & (used + d <= share[level]))
                if not len(own):
                    continue
                value = (fp[own] >> np.uint64(64 - cut[s + 1])) & np.uint64((1 << bits) - 1)
                for flips in combinations(range(bits), d):
                    changed = value ^ np.uint64(sum(1 << f for f in flips))
                    out = batch.take(pa.array(own))
                    new_key = rolling.mix(key[own] * np.uint64(0x100000001B3) + changed).view(np.int64)
                    arrays = [pa.array(new_key) if n == "key" else pa.array((used[own] + d).astype(np.int32)) if n == "used" else out.column(i) for i, n in enumerate(out.schema.names)]
                    yield pa.RecordBatch.from_arrays(arrays, names=out.schema.names)


def link_forest(nodes: DataFrame, scratch: Scratch, *, tau: int, segments: int, hot: int = 2048, extra=None) -> DataFrame:
    """Edges (a, b) that join all nodes linked within ``tau`` bits; ``nodes``: node, fp and what ``extra`` reads.

    Finds every link: buckets of over ``hot`` rows are dealt on along the chain
    until they are smaller or the chain is at its end.
    """
    exact = sum(1 for x in budgets(tau, segments) if x == 0)
    if not exact:
        raise ValueError("tau must be below the number of segments")
    cut = borders(segments)
    fp = F.col("fp")
    keys = []
    for r in range(segments):
        width = (cut[(r + exact - 1) % segments + 1] - cut[r]) % 64
        turned = fp if cut[r] == 0 else F.shiftleft(fp, cut[r]).bitwiseOR(F.shiftrightunsigned(fp, 64 - cut[r]))
        keys.append(F.shiftrightunsigned(turned, 64 - width))
    rows = nodes.select("*", F.posexplode(F.array(*keys)).alias("ring", "key"), F.lit(0).alias("used"))
    rows = rows.withColumn("ring", F.col("ring").cast("int"))
    parts, level = [], exact
    while True:
        sizes = scratch.table(f"hot-{level}", rows.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("ring", "key"))
        if level >= segments or sizes.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(sizes, ["ring", "key"], "left_anti").select(rows.columns))
        heated = rows.join(sizes, ["ring", "key"], "left_semi").select(rows.columns)
        at = level
        rows = scratch.table(f"dealt-{level}", heated.mapInArrow(lambda batches: _deal_on(batches, at, tau, segments), heated.schema))
        level += 1

    def run(batches):
        release()
        for table in _whole_groups(batches):
            arrays = {n: table[n].to_numpy() for n in table.column_names}
            a, b = _links(arrays, tau, segments, extra)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = None
    for part in parts:
        dealt = part.repartition(shuffle_partitions(nodes, 4 << 20), "ring", "key").sortWithinPartitions("ring", "key", "used")
        edges = dealt.mapInArrow(run, "a long, b long")
        found = edges if found is None else found.union(edges)
    return found


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id and fp, a signed 64-bit integer, of every row; no words: zero."""
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        release()
        for batch in byte_batches(batches, 8 << 20):
            fp = [majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


def _text_key(column: Column) -> Column:
    """Hash of a text, null as empty."""
    return F.xxhash64(F.lit(1), F.coalesce(column.cast("string"), F.lit("")))


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def minwise(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A 64-bit key per band, and a byte of each min-wise hash, of a set of shingle hashes; no shingles: no bands."""
    if not len(shingles):
        return np.zeros(0, np.int64), bytes(BANDS * BAND)
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (_FACTORS[:, None] * shingles[i : i + 2048]).min(axis=1), out=least)
    keys = rolling.mix((rolling.mix(least).reshape(BANDS, BAND) * _FACTORS[:BAND]).sum(axis=1, dtype=np.uint64))
    return keys.view(np.int64), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def _band_links(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of one bucket that agree in at least ``least`` min-wise hashes: a spanning forest of each bucket."""
    key, ring, node = (table[n].to_numpy() for n in ("key", "ring", "node"))
    n = len(node)
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum((np.diff(key) != 0) | (np.diff(ring) != 0))
    size = np.bincount(group)
    shared = np.flatnonzero(size[group] > 1)
    if not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group, node = group[shared], node[shared]
    sig = np.frombuffer(b"".join(table["sig"].take(pa.array(shared)).to_pylist()), np.uint8).reshape(-1, BANDS * BAND)
    n, label = len(node), np.arange(len(node))
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(cuts, n))
    for first, many in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = label[first : first + many]
        for i in range(many - 1):
            other = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
            other = other[(sig[first + other] == sig[first + i]).sum(axis=1) >= least]
            if len(other):
                joined = np.isin(own, np.append(own[other], own[i]))
                own[joined] = own[joined].min()
    at, apart, held_a, held_b = np.flatnonzero(np.repeat(sizes <= SMALL, sizes)), 1, [], []
    while True:
        at = at[at < n - apart]
        at = at[group[at] == group[at + apart]]
        if not len(at):
            break
        for i in range(0, len(at), 100_000):
            a = at[i : i + 100_000]
            a = a[(sig[a] == sig[a + apart]).sum(axis=1) >= least]
            held_a, held_b = [*held_a, a], [*held_b, a + apart]
        apart += 1
    if held_a:
        label = _forest(label, np.concatenate(held_a), np.concatenate(held_b))
    joined = np.flatnonzero(label != np.arange(n))
    return node[joined], node[label[joined]]


def band_forest(nodes: DataFrame, scratch: Scratch, *, similarity: float, hot: int) -> DataFrame:
    """Edges (a, b) that join all nodes that share a band and may be ``similarity`` alike; ``nodes``: node, bands, sig.

    The bytes rule out what is four standard deviations below ``similarity``.  A
    band that more than ``hot`` nodes share (a template, a notice) is one key and
    would fill a task: all its nodes are candidates, joined to the least of them
    by a sum over the band, and only their exact comparison rules any out.
    """
    n = BANDS * BAND
    least = int(n * similarity - 4 * np.sqrt(n * similarity * (1 - similarity)))

    def run(batches):
        release()
        for table in _whole_groups(batches):
            a, b = _band_links(table, least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # most nodes share no band: short rows find those that do, and only they carry their hashes
    rows = nodes.select("node", F.posexplode("bands").alias("ring", "key"))
    shared = scratch.table("shared-bands", rows.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"))
    stars = rows.join(shared.where(F.col("n") > hot).hint("merge"), ["ring", "key"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    rows = rows.join(shared.where(F.col("n") <= hot).select("ring", "key").hint("merge"), ["ring", "key"], "left_semi").join(nodes.select("node", "sig").hint("merge"), "node").select("node", "sig", "ring", "key")
    dealt = rows.repartition(shuffle_partitions(nodes, 4 << 20), "ring", "key").sortWithinPartitions("ring", "key", "node")
    return dealt.mapInArrow(run, "a long, b long").union(stars.distinct())


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, key (of the text), node (of the set of shingles), fp of the words, s0 to s3, 256 bits of the shingles, size (how many there are), and ``minwise``'s bands and sig."""
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    salts = [np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1) for i in (1, 2, 3)]

    def run(batches):
        release()
        for batch in byte_batches(batches, 8 << 20):
            out = []
            for text in batch.column(2):
                shingles = shingle_hashes(text.as_py(), words)
                bits = [majority(shingles), *(majority(rolling.mix(shingles ^ s)) for s in salts)]
                single, times = np.unique(shingle_hashes(text.as_py(), 1), return_counts=True)
                votes = np.unpackbits(single.view(np.uint8), bitorder="little").reshape(-1, 64) * np.sqrt(times)[:, None] if len(single) else np.zeros((1, 64))
                fp = np.packbits(votes.sum(axis=0) * 2 > np.sqrt(times).sum(), bitorder="little").view("<i8")[0]
                distinct = np.unique(shingles)
                node = np.uint64(xxhash.xxh64_intdigest(distinct.tobytes())).astype(np.int64)
                out.append((int(node), int(fp), *bits, len(distinct), *minwise(distinct)))
            columns = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.list_(pa.int64())), pa.array(columns[8], pa.binary())],
                names=["doc_id", "key", "node", "fp", "s0", "s1", "s2", "s3", "size", "bands", "sig"],
            )

    text = F.col(f"`{text_col}`")
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), _text_key(text).alias("key"), text.cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, key long, node long, fp long, s0 long, s1 long, s2 long, s3 long, size long, bands array<long>, sig binary")


def shingle_bits(similarity: float) -> int:
    """Of 256 bits, how many may differ between candidates for this Jaccard similarity of shingles.

    The expected number, by the angle between the shingle counts, and three
    standard deviations more: a loose filter, as candidates are compared exactly.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(256 * p + 3 * np.sqrt(256 * p * (1 - p)))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tau: int = 3, segments: int = 8, hot: int = 2048) -> DataFrame:
    """The rows of ``docs``, all their columns, without near-duplicates: of each group the least id stays.

    Fingerprints of the words, which a few edits hardly change, find pairs
    within ``tau`` bits by pigeonring filtering, by an index key of 16 bits;
    those that 256 bits of SimHash over shingles of ``words`` words do not rule
    out are candidates.  So are pairs that share a band of min-wise hashes of
    their shingles, wherever the edits stand: a block added, cut off or replaced
    changes too many words for the fingerprints, and more bits of them would
    leave an index key too short to tell documents apart.  A candidate is a link only if the Jaccard similarity of the two sets of
    shingles, computed exactly, is ``similarity`` or more.  A null text counts
    as empty; texts without words are copies of each other; texts of fewer
    words than ``words`` are one shingle; of rows that are equal in id and text
    one stays; null ids give way to any other; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    sketch = ["fp", "s0", "s1", "s2", "s3"]
    marked = scratch.table("sketches", _sketches(docs, id_col, text_col, words))
    nodes = scratch.table("nodes", marked.select("node", *sketch, "bands", "sig").dropDuplicates(["node"]))
    limit = shingle_bits(similarity)

    def alike(batch, a, b):
        return sum(np.bitwise_count(batch[s].view(np.uint64)[a] ^ batch[s].view(np.uint64)[b]).astype(np.int64) for s in sketch[1:]) <= limit

    edges = link_forest(nodes.select("node", *sketch), scratch, tau=tau, segments=segments, hot=hot, extra=alike)
    edges = edges.union(band_forest(nodes, scratch, similarity=similarity, hot=hot))
    # copies come down to one row a node before anything is joined
    best = scratch.table("best", marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("best"), F.first("size").alias("size")))
    groups = connected_components(edges, scratch)
    one = best.join(groups, "node").select("node", "root", "size", F.col("best.doc_id").alias("one_id"), F.col("best.key").alias("one_key"))
    text = F.col(f"`{text_col}`")
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), _text_key(text).alias("key"), text.cast("string").alias("text"))
    roots = verify.exact_components(source, one, scratch, lambda t: _shingle_set(t, words), similarity=similarity)
    grouped = best.join(roots, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min("best").alias("best"))
    kept = scratch.table("kept", first.select(F.col("best.doc_id").alias("kept_id"), F.col("best.key").alias("kept_key")))
    key = _text_key(docs[f"`{text_col}`"])
    out = docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["kept_id"]) & (key == kept["kept_key"]), "left_semi")
    if marked.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        return out
    return out.dropDuplicates([id_col, text_col])


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2, segments: int = 8) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id it is linked to).

    Equal fingerprints are one node, so copies are never paired.  A text without
    words (null, empty, blanks) has fingerprint zero and is linked like any
    other.  One row per input row, repeated rows too; null ids are not the
    least of a component unless it has no other; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table("fps", fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    nodes = scratch.table("nodes", marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = link_forest(nodes.select(F.col("fp").alias("node"), "fp"), scratch, tau=tau, segments=segments)
    joined = connected_components(edges, scratch)
    by_fp = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.table("named", by_fp.join(by_root, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
