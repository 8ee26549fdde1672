"""Quality classifier by supervised subword embeddings (operator 7).

A document is the average of learned vectors of its hashed words, word pairs
and character n-grams of words; a softmax over the average gives the label.  The
vectors are learned by stochastic gradient descent in numpy.  As the softmax has two
classes, a document's score needs one number per vector, so scoring a text is
one table lookup per n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .blobs import least_type, squeeze, unsqueeze
from .common import byte_batches, carried, carried_schema, id_crc, only, release, small_batches

#: Hash of the pair of a word and the mark that stands for its repetition.
_AGAIN = np.uint64(1 << 20)


class Features:
    """Buckets of a text's words, word pairs and the character n-grams of its words; case counts.

    A word's n-grams are those of its characters with a mark on either side,
    which is a blank here: "<cat>" has "<ca", "cat" and "at>".  A word that stands
    right after itself is read as a mark, the same for all words, so that the
    model can learn what such a mark is worth.
    """

    def __init__(self, buckets: int = 1 << 17, grams: tuple[int, ...] = (3, 4)):
        self.buckets, self.grams = buckets, grams

    def of_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind of feature: buckets of all texts in a row, first and end of each text there."""
        # a blank before, between and behind the texts: a word begins and ends with one
        data = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "replace"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size + 1)
        first = end - size
        mask = np.uint32(self.buckets - 1)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        wide = np.where(blank, np.uint32(0), data + np.uint32(1))
        # words before each place, in which n-grams are counted
        begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        out = []
        for n in self.grams:
            many = max(len(data) - n + 1, 0)
            h, inside = np.zeros(many, np.uint32), np.ones(many, bool)
            for j in range(n):
                h = h * np.uint32(0x01000193) + wide[j : j + many]
                if 0 < j < n - 1:
                    inside &= ~blank[j : j + many]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B + 2 * n)
            h ^= h >> np.uint32(13)
            at = np.flatnonzero(inside)
            # a text's n-grams start at the blank before it, or later
            out.append((h[at] & mask, np.searchsorted(at, first - 1), np.searchsorted(at, end - n + 2)))
        sums = rolling.prefix(data)
        word = rolling.mix(rolling.spans(sums, begins, ends))
        a, b = np.searchsorted(begins, first), np.searchsorted(begins, end)
        out.append(((word >> np.uint64(20)).astype(np.uint32) & mask, a, b))
        pair = rolling.mix(word[:-1] * np.uint64(31) + word[1:]) if len(word) else word
        pair[word[:-1] == word[1:]] = _AGAIN
        a2 = np.minimum(a, len(pair))
        out.append(((pair >> np.uint64(20)).astype(np.uint32) & mask, a2, np.maximum(np.minimum(b - 1, len(pair)), a2)))
        return [(h, x, np.maximum(x, y)) for h, x, y in out]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's buckets, ascending, and how often each occurs."""
        found = np.concatenate([h[a[0] : b[0]] for h, a, b in self.of_batch([text])])
        which, times = np.unique(found, return_counts=True)
        return which, least_type(times.astype(np.uint64))

    def totals(self, texts: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of ``weight`` over each text's features, and their number."""
        total, many = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for buckets, first, end in self.of_batch(texts):
            sums = np.concatenate([[0.0], np.cumsum(weight[buckets], dtype=np.float64)])
            total += sums[end] - sums[first]
            many += end - first
        return total, many


class SubwordModel:
    """Weights per bucket and a bias, of the log-odds of label 1; learned as embeddings and a softmax."""

    def __init__(self, features: Features, weight: np.ndarray, bias: float):
        self.features, self.weight, self.bias = features, weight, bias

    @classmethod
    def fit(cls, sample: list[tuple[np.ndarray, np.ndarray, int]], *, features: Features, dim: int = 8, steps: int = 24_000, rate: float = 0.5, seed: int = 7) -> "SubwordModel":
        """Learns from (buckets, counts, label) by ``steps`` documents in random order, each as often as the others, and at most 60 times each.

        A step goes down the gradient of the document's loss: by ``rate`` for the
        softmax, a tenth of it for its bias, and for the vectors by the rate over
        the largest share that a feature has in the document, as the gradient of
        an average over thousands of features is small.  The rate falls to 0.
        """
        rng = np.random.default_rng(seed)
        table = ((rng.random((features.buckets, dim)) - 0.5) / dim).astype(np.float32)
        top, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
        rows = [(which, (times / max(int(times.sum()), 1)).astype(np.float32)) for which, times, _ in sample]
        labels = [label for _, _, label in sample]
        epochs = min(-(-steps // len(rows)), 60)
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                lr = rate * (1 - done / steps)
                done += 1
                which, share = rows[i]
                vectors = table[which]
                mean = share @ vectors
                z = top @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ top
                top -= lr * np.outer(p, mean)
                bias -= lr * 0.1 * p
                table[which] = vectors - lr * np.outer(share / max(share.max(initial=0), 1e-9), back)
        return cls(features, (table @ (top[1] - top[0])).astype(np.float32), float(bias[1] - bias[0]))

    def scores(self, texts: list[str]) -> np.ndarray:
        total, many = self.features.totals(texts, self.weight)
        z = total / np.maximum(many, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, features: Features, *, id_col: str, text_col: str, label_col: str, most: int, batch_bytes: int = 2 << 20) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """At most ``most`` labelled rows that are not held out: (buckets, their counts, label), by the order of the ids' hash.

    Only rows are bounded: each is learned from as a whole.  The executors count
    its features, so the driver gets at most ``features.buckets`` numbers a row
    however long its text is.  Of rows that share an id, the one whose text has
    the least hash stands for it, so the sample is the same in every run; an id
    that is marked both 0 and 1 counts once as either.
    """
    mark = only(labels, id_col, label_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    mark = mark.where((id_crc(F.col("id"), 4) != 2) & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    mark = mark.withColumn("order", F.xxhash64(F.col("id").cast("string"), F.lit("quality sample"))).orderBy("order", "id", "label").limit(most)
    text = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(mark), "id").select("order", "label", F.xxhash64("text").alias("tie"), "text")  # at most ``most`` short rows are sent

    def run(batches):
        release()
        for batch in byte_batches(batches, batch_bytes, "text"):
            found = [squeeze(*features.counts(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["order", "label", "tie", "counts"])

    counted = rows.mapInArrow(run, "order long, label int, tie long, counts binary")
    one = counted.groupBy("order", "label").agg(F.min(F.struct("tie", "counts")).alias("one")).select("order", "label", "one.counts").collect()
    return [(*unsqueeze(bytes(r["counts"])), r["label"]) for r in sorted(one, key=lambda r: (r["order"], r["label"]))]


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 4000, buckets: int = 1 << 17) -> SubwordModel:
    """The model, learned from the whole texts of at most ``train_rows`` labelled rows; without any, one that scores 0.5.

    Rows with a null id or label, or a label but 0 and 1, teach nothing; a null
    text is empty; ids without a document teach nothing; repeated ids and ties
    are as ``labelled_sample`` says; other columns are not read.
    """
    small_batches(docs)
    features = Features(buckets)
    rows = labelled_sample(docs, labels, features, id_col=id_col, text_col=text_col, label_col=label_col, most=train_rows)
    if not rows:
        return SubwordModel(features, np.zeros(buckets, np.float32), 0.0)
    return SubwordModel.fit(rows, features=features)


def score_quality(docs: DataFrame, model: SubwordModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, batch_bytes: int = 2 << 20, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Whole texts are scored, in one pass and without a shuffle.  A null text is
    empty and gets the score of the bias, as does a text without features; one
    row per input row, repeats and ties included; a null id is not held out;
    an empty table gives an empty table; other columns are not read, but for
    ``carry``, which comes back with its row and the text.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(docs)
    held = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        release()
        model = held.value
        for batch in byte_batches(batches, batch_bytes):
            more = batch.columns[2:] if carry else []
            score = model.scores([t.as_py() or "" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), *more], names=["doc_id", "held_out", "score", "predicted", *["text", "carried"][: len(more)]])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (id_crc(F.col(f"`{id_col}`"), 4) == 2).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int" + carried_schema(docs, carry))
