"""Language-model scores by deleted interpolation (operator 10).

A token's probability is a mixture of the maximum-likelihood estimates of its
pair with the token before it, of itself alone, and of the uniform
distribution; by order three, of that mixture and of the estimate of its triple
with the two tokens before it.  The weights depend on how often the context
occurs, in powers of two, and are learned by expectation-maximisation on a part
of the training documents whose counts are left out of the estimates.

Counts are those of the whole training part.  A batch of documents asks the
parts of the key space for the counts of its distinct tokens and pairs, giving
its own share of them; the answers come back to the batch.  So no token crosses
the network twice, and a hot token costs one number per batch.  A batch sends
``FAN`` questions at most: if the key space has more parts, questions go to
relays, which unite those of many batches, sum their counts and ask the parts
themselves.  So questions grow with the data and not with its square.

Triples are asked for after pairs.  A triple occurs no more often than either of
its pairs; so where all occurrences of one of them are in the batch, the batch
knows the triple's count itself, and asks only for the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import rolling
from .blobs import as_frame, deal, dealt, least_type, planes, squeeze, stream, unplanes, unsqueeze
from .common import byte_batches, id_crc, only, release, shuffle_partitions, small_batches

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Questions of a sender, and so the answers that it waits for.
FAN = 1024
#: Context-frequency buckets: 0 for an unseen context, then by the power of two, the last open.
BUCKETS = 32
#: Cells of the held-out histogram per doubling of a ratio of probabilities.
FINE = 8


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and end, in a row, and the number of each text's tokens."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]  # a space after every text
    size = np.array([len(t) + 1 for t in texts], np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    first = np.flatnonzero(~blank & before)
    end = np.flatnonzero(blank & ~before)
    words = rolling.mix(rolling.spans(rolling.prefix(data), first, end))
    upto = np.searchsorted(first, np.cumsum(size))
    return np.insert(words, upto, _END), np.diff(upto, prepend=0) + 1


def _contexts(tokens: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each token's context is: the token before it, or -1 at a document's start."""
    before = np.arange(-1, len(tokens) - 1)
    before[np.cumsum(many) - many] = -1
    return before


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space that counts each key; parts are ranges, so they ascend with the keys."""
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _pair_keys(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return rolling.mix(np.where(before < 0, _START, tokens[before]) * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _triple_keys(pairs: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of triples: of the pair that ends before each token, and the token."""
    return rolling.mix(np.where(before < 0, _START, pairs[before]) * np.uint64(0xD1B54A32D192ED03) + tokens)


def _parts_of_training(crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a document is learned from, and whether its counts are among the estimates that the weights are learned on."""
    train = crc % 7 != 2
    return train, train & (crc // 7 % 10 != 0)


def _distinct(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in ascending order, each once; where each of ``keys`` is among them; the sums of their counts."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(fresh)
    where = np.empty(len(keys), np.int64)
    where[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ranked))))
    return ranked[at], where, *(np.add.reduceat(c[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64) for c in counts)


def pack_counts(full: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, and those of them that are kept, as a byte each: the count and what is not kept; larger ones apart."""
    lost = full - held
    code = np.where((full < 16) & (lost < 15), full << 4 | lost, 255).astype(np.uint8)
    over = code == 255
    return code, least_type(full[over]), least_type(lost[over])


def unpack_counts(packed: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and kept counts of packed ones, one after another."""
    code, *over = (np.concatenate([p[i] for p in packed]).astype(np.int64) if packed else np.zeros(0, np.int64) for i in range(3))
    full, lost = code >> 4, code & 15
    full[code == 255], lost[code == 255] = over
    return full, full - lost


def _questions(sender: int, home: int, lists: list[tuple[np.ndarray, ...]], parts: int, targets: int):
    """(target, blob) for the targets, ranges of parts, that have some of the keys of the (keys, counts, counts kept); answers go to ``home``."""
    target = [_part_of(keys, parts) * np.uint64(targets) // np.uint64(parts) for keys, _, _ in lists]
    cuts = [np.searchsorted(t, np.arange(targets + 1, dtype=np.uint64)) for t in target]
    for t in range(targets):
        out = []
        for (keys, full, held), cut in zip(lists, cuts):
            own = slice(cut[t], cut[t + 1])
            out += [planes(np.diff(keys[own], prepend=np.uint64(0))), pack_counts(full[own], held[own])]
        if any(len(c[0]) for c in out[1::2]):
            yield t, b"a" + squeeze("ask", sender, home, t, *out)


def _dealt_questions(number: int, lists: list[tuple[np.ndarray, ...]], parts: int, fan: int):
    """(part, blob): a batch's questions to the parts, or to the relays of the ranges of parts, each for some of the batches."""
    ranges = min(parts, fan)
    relays = -(-parts // ranges)
    for t, blob in _questions(number, number % parts, lists, parts, ranges):
        yield (t + ranges * (number % relays)) % parts, blob


def _ask(source: DataFrame, parts: int, fan: int, batch_bytes: int, batch_tokens: int) -> DataFrame:
    """(part, blob): questions to the parts of the key space or their relays, and each batch's own record to part ``batch % parts``."""

    def emit(number, hashes, many, docs, crc):
        tokens, many, crc = np.concatenate(hashes), np.concatenate(many), np.concatenate(crc)
        train, kept = (np.repeat(x, many) for x in _parts_of_training(crc))
        lists = [_distinct(keys, train, kept) for keys in (tokens, _pair_keys(tokens, _contexts(tokens, many)))]
        words, where = lists[0][:2]
        home = number % parts
        rows_part, rows_blob = [home], [b"b" + squeeze("batch", number, docs, least_type(many), crc, planes(np.diff(words, prepend=np.uint64(0))), planes(where))]
        for part, blob in _dealt_questions(number, [(keys, *counts) for keys, _, *counts in lists], parts, fan):
            rows_part.append(part)
            rows_blob.append(blob)
        return pa.RecordBatch.from_arrays([pa.array(rows_part, pa.int32()), pa.array(rows_blob, pa.binary())], names=["part", "blob"])

    def run(batches):
        release()
        number = TaskContext.get().partitionId() << 24
        hashes, many, docs, crc, size = [], [], [], [], 0
        for batch in byte_batches(batches, batch_bytes):
            h, n = token_hashes([(t.as_py() or "").encode() for t in batch.column(2)])
            hashes.append(h)
            many.append(n)
            docs += batch.column(0).to_pylist()
            crc.append(batch.column(1).to_numpy())
            size += len(h)
            if size >= batch_tokens:
                yield emit(number, hashes, many, docs, crc)
                hashes, many, docs, crc, size, number = [], [], [], [], 0, number + 1
        if docs:
            yield emit(number, hashes, many, docs, crc)

    return source.mapInArrow(run, "part int, blob binary")


def _united(asked: list[tuple]) -> list[tuple]:
    """For tokens, pairs and triples: the distinct keys of all questions, where each question's are among them, and their summed counts."""
    out = []
    for k in range(4, len(asked[0]), 2) if asked else (4, 6):
        keys = [np.cumsum(unplanes(a[k]), dtype=np.uint64) for a in asked]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        unique, where, *counts = _distinct(flat, *unpack_counts([a[k + 1] for a in asked]))
        out.append((unique, np.split(where, np.cumsum([len(x) for x in keys])[:-1]), *counts))
    return out


def _replies(asked: list[tuple], united: list[tuple], counts: list[tuple]):
    """(home, blob): the counts of each question's keys, in its order."""
    for i, a in enumerate(asked):
        out = [pack_counts(*(count[where[i]] for count in both)) for (_, where, _, _), both in zip(united, counts)]
        yield int(a[2]), b"r" + squeeze("reply", a[1], a[3], *out)


def _answer(part: int, items):
    """For each question to a part: the counts of its keys; and the part's totals."""
    asked = [unsqueeze(blob[1:]) for _, blob in items if _is(blob, "ask")]
    united = _united(asked)
    _, _, full, held = united[0]
    yield 0, b"t" + squeeze([int(x) for count in (full, held) for x in (count.sum(), (count > 0).sum())])
    yield from _replies(asked, united, [u[2:] for u in united])


def _pass_on(parts: int):
    """A relay's questions to the parts: those of its batches, united."""

    def run(part, items):
        asked = [unsqueeze(blob[1:]) for _, blob in items if _is(blob, "ask")]
        if asked:
            yield from _questions(part, part, [(keys, *counts) for keys, _, *counts in _united(asked)], parts, parts)

    return run


def _pass_back(items):
    """A relay's answers to its batches; the parts' answers to the relay come before the batches' questions."""
    got, asked = [], []
    for _, blob in items:
        if _is(blob, "reply"):
            got.append(unsqueeze(blob[1:]))
        elif _is(blob, "ask"):
            asked.append(unsqueeze(blob[1:]))
    if asked:
        got.sort(key=lambda r: r[2])
        counts = [unpack_counts([r[k] for r in got]) for k in range(3, len(got[0]))]
        yield from _replies(asked, _united(asked), counts)


def exchange(asked, parts: int, fan: int):
    """(replies, totals) for questions that were dealt out: RDDs of blobs, the replies at their senders' homes."""
    if parts <= fan:
        replies = deal(asked.mapPartitionsWithIndex(_answer), parts)
        return replies, replies
    answers = deal(deal(asked.mapPartitionsWithIndex(_pass_on(parts)), parts).mapPartitionsWithIndex(_answer), parts)
    return deal(asked.context.union([answers, asked]).mapPartitions(_pass_back), parts), answers


def _is(blob: bytes, kind: str) -> bool:
    """Kinds are told by the first byte, so that only the blobs that are needed are unpacked."""
    return blob[:1] == kind[:1].encode()


class Counts:
    """What a batch knows after the answers: per token, counts of itself, its context and its pair; once triples have been answered, of its triple and that one's context."""

    def __init__(self, record: tuple, replies: list[tuple], kept: bool, longer: bool = False):
        _, self.number, self.docs, many, self.crc, unique, where = record
        self.many = many.astype(np.int64)
        where = unplanes(where).astype(np.int64)
        tokens = np.cumsum(unplanes(unique), dtype=np.uint64)[where]
        self.flags = [np.repeat(x, self.many) for x in _parts_of_training(self.crc)]
        short = sorted((r for r in replies if len(r) == 5), key=lambda r: r[2])
        words, of_pairs = (unpack_counts([r[k] for r in short]) for k in (3, 4))
        before = _contexts(tokens, self.many)
        pairs = _pair_keys(tokens, before)
        _, of_pair, *own = _distinct(pairs, *self.flags)
        self.word, self.pair = words[kept][where], of_pairs[kept][of_pair]
        starts = np.repeat(self.word[np.cumsum(self.many) - 1], self.many)  # a document's start occurs as often as its end
        self.context = np.where(before < 0, starts, self.word[before])
        if not longer:
            return
        # whether a pair occurs in other batches: if one of a triple's does not, the triple does not
        elsewhere = (of_pairs[0] > own[0])[of_pair]
        self.keys, of_triple, *self.local = _distinct(_triple_keys(pairs, before, tokens), *self.flags)
        self.asked = np.zeros(len(self.keys), bool)
        self.asked[of_triple[elsewhere & (before >= 0) & elsewhere[before]]] = True
        count = self.local[kept].copy()
        rest = sorted((r for r in replies if len(r) == 4), key=lambda r: r[2])
        if rest:
            count[self.asked] = unpack_counts([r[3] for r in rest])[kept]
        self.triple = np.where(before < 0, self.pair, count[of_triple])  # before a start stands nothing: it is the pair
        self.long_context = np.where(before < 0, starts, self.pair[before])


def _each_batch(items, kept: bool, longer: bool = False):
    """Counts of each batch of a partition; the answers come before the records."""
    replies: dict[int, list] = {}
    for _, blob in items:
        if _is(blob, "reply"):
            got = unsqueeze(blob[1:])
            replies.setdefault(got[1], []).append(got)
        elif _is(blob, "batch"):
            record = unsqueeze(blob[1:])
            yield Counts(record, replies.pop(record[1]), kept, longer)


def _ask_triples(items, parts: int, fan: int):
    """(part, blob): questions for the triples of each batch that may occur in others."""
    for c in _each_batch(items, kept=False, longer=True):
        yield from _dealt_questions(c.number, [(c.keys[c.asked], *(x[c.asked] for x in c.local))], parts, fan)


def held_out_cells(counts: Counts, n: int, v: int) -> dict[int, int]:
    """How many held-out tokens have each bucket and each pair of ratios to the uniform estimate."""
    own = counts.flags[0] & ~counts.flags[1]
    context, word, pair = counts.context[own], counts.word[own], counts.pair[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(pair > 0, np.round(FINE * np.log2(np.maximum(pair, 1) / np.maximum(context, 1) * (v + 1))), -4096).astype(np.int64)
        one = np.where(word > 0, np.round(FINE * np.log2(np.maximum(word, 1) / max(n, 1) * (v + 1))), -4096).astype(np.int64)
    cell, many = np.unique((bucket_of(context).astype(np.int64) << 28) + (two + 4096 << 14) + (one + 4096), return_counts=True)
    return dict(zip(cell.tolist(), many.tolist()))


def triple_cells(counts: Counts, weights: np.ndarray, n: int, v: int) -> dict[int, int]:
    """How many held-out tokens have each bucket of the longer context, and each pair of ratios of triple and lower mixture to the uniform estimate."""
    own = counts.flags[0] & ~counts.flags[1]
    context, triple, lower = counts.long_context[own], counts.triple[own], mixture(counts, weights, n, v)[own]
    three = np.where(triple > 0, np.round(FINE * np.log2(np.maximum(triple, 1) / np.maximum(context, 1) * (v + 1))), -4096).astype(np.int64)
    rest = np.round(FINE * np.log2(lower * (v + 1))).astype(np.int64)
    cell, many = np.unique((bucket_of(context).astype(np.int64) << 28) + (three + 4096 << 14) + (rest + 4096), return_counts=True)
    return dict(zip(cell.tolist(), many.tolist()))


def mixture(c: Counts, weights: np.ndarray, n: int, v: int) -> np.ndarray:
    """The probability of each token by pair, single and uniform estimates."""
    weight = weights[bucket_of(c.context)]
    return weight[:, 0] * c.pair / np.maximum(c.context, 1) + weight[:, 1] * c.word / max(n, 1) + weight[:, 2] / (v + 1)


def learn_weights(cells: dict[int, int], rounds: int = 100, *, start: tuple[float, ...] = (0.3, 0.6, 0.1)) -> np.ndarray:
    """Mixture weights per bucket, by expectation-maximisation on the held-out cells: of pair, single and uniform, or of triple and the lower mixture."""
    out = np.tile(np.array(start), (BUCKETS, 1))
    keys, many = np.array(list(cells), np.int64), np.array(list(cells.values()), np.float64)
    bucket = keys >> 28
    ratio = np.stack([(keys >> 14 & 16383) - 4096, (keys & 16383) - 4096, np.zeros(len(keys), np.int64)][: len(start)], axis=1)
    likely = np.where(ratio > -4096, 2.0 ** (ratio / FINE), 0.0)

    def fit(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        weight = start
        for _ in range(rounds):
            share = likely[own] * weight
            share /= share.sum(axis=1, keepdims=True)
            weight = (share * many[own, None]).sum(axis=0) + 0.01  # none is ever zero
            weight /= weight.sum()
        return weight

    if len(keys):
        pooled = fit(np.ones(len(keys), bool), out[0])
        out[:] = pooled
        for b in np.unique(bucket):
            out[b] = fit(bucket == b, pooled)
    out[0] = [0, *(out[0][1:] / out[0][1:].sum())]  # an unseen context says nothing
    return out


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, batch_tokens: int = 800_000, fan: int = FAN, order: int = 3) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose id's crc32 modulo 7 is not 2; a tenth of those
    give the counts that the weights are learned on, and the weights then mix
    the estimates of all of them.  Texts are whole; a null or empty text is its
    end alone; a null id counts as empty text and is learned from; one row per
    input row, and repeated rows count as often as they occur; if nothing can
    be learned the model is the uniform distribution; an empty table gives
    none; other columns are not read.  Tokens, pairs and triples are told by 64
    bits of a hash.  ``order`` is 3, or 2 for a model of pairs alone.

    The driver gets one line of totals per part of the key space and a
    histogram whose cells are bounded by the buckets and the range of doubles.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    id_type = docs.schema[id_col].dataType
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), id_crc(F.col(f"`{id_col}`"), 1 << 33).alias("crc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = shuffle_partitions(source)
    if source.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    dealt_out = dealt(_ask(source, parts, fan, batch_bytes, batch_tokens), parts)
    replies, answers = exchange(dealt_out, parts, fan)
    totals = answers.filter(lambda x: _is(x[1], "totals")).map(lambda x: unsqueeze(x[1][1:])[0]).collect()
    n_all, v_all, n_kept, v_kept = (sum(t[i] for t in totals) for i in range(4))
    both = spark.sparkContext.union([replies, dealt_out])

    def cells(items):
        for counts in _each_batch(items, kept=True):
            yield from held_out_cells(counts, n_kept, v_kept).items()

    weights = learn_weights(dict(both.mapPartitions(cells).reduceByKey(lambda a, b: a + b).collect()))

    def longer(items):
        for counts in _each_batch(items, kept=True, longer=True):
            yield from triple_cells(counts, weights, n_kept, v_kept).items()

    shares = None
    if order == 3:
        triples, _ = exchange(deal(both.mapPartitions(lambda items: _ask_triples(items, parts, fan)), parts), parts, fan)
        both = spark.sparkContext.union([replies, triples, dealt_out])
        shares = learn_weights(dict(both.mapPartitions(longer).reduceByKey(lambda a, b: a + b).collect()), start=(0.5, 0.5))

    def finish(items):
        for c in _each_batch(items, kept=False, longer=order == 3):
            p = mixture(c, weights, n_all, v_all)
            if shares is not None:
                share = shares[bucket_of(c.long_context)]
                p = share[:, 0] * c.triple / np.maximum(c.long_context, 1) + share[:, 1] * p
            if not n_all:
                p = np.ones(len(p))
            base = np.log10((c.word + 1) / (n_all + v_all + 1))
            at = np.cumsum(c.many) - c.many
            yield stream(
                pa.RecordBatch.from_arrays(
                    [pa.array(c.docs, to_arrow_type(id_type)), pa.array(c.crc % 7 == 2), pa.array(c.many), pa.array(np.add.reduceat(c.word > 0, at, dtype=np.int64)), pa.array(np.full(len(at), n_all)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )

    return as_frame(spark, both.mapPartitions(finish), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

