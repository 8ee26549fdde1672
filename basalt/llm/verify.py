"""Exact components of near-duplicate candidates, by the Jaccard similarity of their shingles.

Candidates come in groups: whatever is joined by any chain of them.  A group
that is small enough is compared in one task.  A large one is dealt to chunks by
a hash of the node; a few of its nodes, the leaders, stand in every chunk, so that
the copies of one text find each other across chunks.  That leaves the nodes
outside the group's largest component: they are compared, in blocks, with all
chunks.  Two nodes that are never compared are in one component already, so the
components are exact, whatever a group's size, and no task holds more than a
chunk and a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, shuffle_partitions
from .components import connected_components

#: Nodes, and shingles, that a chunk or a block holds.
NODES, SHINGLES = 1000, 4_000_000
#: Nodes of a large group that stand in every chunk.
LEADERS = 8


def alike_within(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Least index of each set's component, sets (of distinct hashes) being linked if their Jaccard similarity is ``similarity`` or more.

    Exact.  Sets that are already in one component are not compared again, so a
    group of near copies takes about one pass.
    """
    n = len(sets)
    label, size = np.arange(n), np.fromiter(map(len, sets), np.int64, n)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(size)[:-1])
    marked = np.zeros(len(values), bool)
    for i in range(n - 1):
        low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        other = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (low > 0) & (low >= similarity * high - 1))
        if not len(other):
            continue
        marked[parts[i]] = True
        starts = np.cumsum(size[other]) - size[other]
        shared = np.add.reduceat(marked[np.concatenate([parts[j] for j in other])], starts, dtype=np.int64)
        marked[parts[i]] = False
        linked = other[shared / (size[i] + size[other] - shared) >= similarity]
        if len(linked):
            joined = np.isin(label, np.append(label[linked], label[i]))
            label[joined] = label[joined].min()
    return label


def links_between(queries: list[np.ndarray], query_label: np.ndarray, members: list[np.ndarray], member_label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(query, member) of sets that are alike and whose labels differ, one for each pair of labels that they join.  Exact."""
    out: list[tuple[int, int]] = []
    if not queries or not members:
        return out
    query_label, member_label = query_label.copy(), member_label.copy()
    size = np.fromiter(map(len, members), np.int64, len(members))
    values, ids = np.unique(np.concatenate([*members, *queries]), return_inverse=True)
    parts = np.split(ids, np.cumsum([*size, *map(len, queries)])[:-1])
    marked = np.zeros(len(values), bool)
    for i in range(len(queries)):
        own = parts[len(members) + i]
        low, high = np.minimum(size, len(own)), np.maximum(size, len(own))
        other = np.flatnonzero((member_label != query_label[i]) & (low > 0) & (low >= similarity * high - 1))
        if not len(other):
            continue
        marked[own] = True
        starts = np.cumsum(size[other]) - size[other]
        shared = np.add.reduceat(marked[np.concatenate([parts[j] for j in other])], starts, dtype=np.int64)
        marked[own] = False
        linked = other[shared / (size[other] + len(own) - shared) >= similarity]
        if len(linked):
            labels, first = np.unique(member_label[linked], return_index=True)
            out += [(i, int(linked[f])) for f in first]
            joined = np.append(labels, query_label[i])
            for label in (query_label, member_label):
                label[np.isin(label, joined)] = joined.min()
    return out


def _groups(batches, keys: list[str]):
    """Rows of sorted batches, as (key values, list of rows), a row being the values of the other columns."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            key = row[: len(keys)]
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row[len(keys) :])
    if rows:
        yield now, rows


def _placed(one: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidates with the number of their group's chunks and of those they stand in; and the large groups."""
    leaders = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(LEADERS))))
    sizes = one.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), leaders.alias("leaders"))
    chunks = F.greatest(F.ceil(F.col("n") / NODES), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    large = scratch.table("large", sizes.withColumn("chunks", chunks).where((F.col("chunks") > 1) & (F.col("n") > 1)).select("root", "chunks", "leaders"))
    placed = one.join(large.hint("merge"), "root", "left")
    own = F.array(_chunk(F.col("node"), F.coalesce("chunks", F.lit(1))))
    every = F.when(F.array_contains("leaders", F.col("node")), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)
    return placed.select(*one.columns, F.coalesce("chunks", F.lit(1)).alias("chunks"), every.alias("places")), large


def _chunk(node: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("chunk")), chunks).cast("int")


def exact_components(source: DataFrame, one: DataFrame, scratch: Scratch, shingle_set, *, similarity: float) -> DataFrame:
    """(node, root) of candidates: root is the least node of the exact component.

    ``one`` has a row per candidate: node, root (of its group), size (its number
    of shingles), one_id and one_key, which name one of the rows of ``source``
    (doc_id, key, text) that have its text; ``shingle_set`` makes of a text its
    sorted shingle hashes.
    """
    one, large = _placed(one, scratch)
    one = scratch.table("candidates", one)
    parts = shuffle_partitions(source)
    named = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("key") == F.col("one_key"))

    def within(batches):
        release()
        for (root, _), rows in _groups(batches, ["root", "chunk"]):
            texts = dict(rows)  # rows may be repeated
            nodes = np.array(list(texts), np.int64)
            label = alike_within([shingle_set(t) for t in texts.values()], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), root)), pa.array(nodes), pa.array(nodes[label])], names=["root", "node", "least"])

    texts = source.join(one, named).select("root", F.explode("places").alias("chunk"), "node", "text")
    dealt = texts.repartition(parts, "root", "chunk").sortWithinPartitions("root", "chunk", "node")
    first = scratch.table("within", dealt.mapInArrow(within, "root long, node long, least long"))
    if large.isEmpty():
        return first.select("node", F.col("least").alias("root"))

    few = first.join(large.hint("merge"), "root", "left_anti").select("node", F.col("least").alias("root"))
    edges = first.join(large.select("root").hint("merge"), "root").select(F.col("node").alias("a"), F.col("least").alias("b"))
    members = one.where("chunks > 1").select("node", F.col("root").alias("group"), "chunks", "one_id", "one_key")
    found = connected_components(edges, Scratch(source.sparkSession, "chunks"))
    members = scratch.table("members", members.join(found, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("label")))
    counts = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    largest = scratch.table("largest", largest.withColumn("blocks", F.ceil(F.col("others") / NODES).cast("int")))
    if not largest.isEmpty():
        more = _across(source, members.join(largest.hint("merge"), "group"), named, scratch, shingle_set, parts, similarity)
        found = connected_components(edges.union(more), Scratch(source.sparkSession, "blocks"))
    joined = members.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return few.union(joined)


def _across(source: DataFrame, members: DataFrame, named: Column, scratch: Scratch, shingle_set, parts: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes outside their group's largest component and any other; their sets are made once."""

    def as_sets(batches):
        release()
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "set"])

    columns = ["group", "node", "label", "chunks", "blocks", "largest"]
    texts = source.join(members, named).select(*columns, "text")
    sets = scratch.table("sets", texts.mapInArrow(as_sets, "group long, node long, label long, chunks int, blocks int, largest long, set binary"))
    chunk, block = _chunk(F.col("node"), F.col("chunks")), F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(block.alias("block"), c.alias("chunk"), F.lit(0).alias("member")))
    answers = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), chunk.alias("chunk"), F.lit(1).alias("member")))
    placed = sets.select("group", "node", "label", "set", F.explode(F.when(F.col("label") == F.col("largest"), answers).otherwise(F.concat(answers, asks))).alias("at"))

    def between(batches):
        release()
        for _, rows in _groups(batches, ["group", "block", "chunk"]):
            roles = [{n: (label, np.frombuffer(s, np.uint64)) for member, n, label, s in rows if member == role} for role in (0, 1)]
            asked, held = roles
            nodes = [list(r) for r in roles]
            labels = [np.array([v[0] for v in r.values()], np.int64) for r in roles]
            found = links_between([v[1] for v in asked.values()], labels[0], [v[1] for v in held.values()], labels[1], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[0][q] for q, _ in found], pa.int64()), pa.array([nodes[1][m] for _, m in found], pa.int64())], names=["a", "b"])

    dealt = placed.select("group", "at.block", "at.chunk", "at.member", "node", "label", "set").repartition(parts, "group", "block", "chunk").sortWithinPartitions("group", "block", "chunk", "member", "node")
    return scratch.table("across", dealt.mapInArrow(between, "a long, b long"))
