"""Toxicity by a weighted lexicon that is matched by Aho-Corasick (operator 11).

Texts are folded first: case, accents, letters that look like Latin ones, and
digits and signs that stand for letters inside a word.  The lexicon has whole
words and stems, each with a weight, and exception phrases inside which nothing
counts.  A text's weights are summed up, repeats of one entry counting less and
less, and normalised by its length; a logistic function of both makes the score.

Weights, exceptions and the function are learned from labelled rows; callers may
add entries and exceptions of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, carried, carried_schema, id_crc, kept_model, only, release, small_batches

# Letters of other scripts that look like a Latin letter, and what they look like.
_ALIKE = "аa вb сc еe һh іi јj кk ԛq ԝw мm нh оo рp ѕs тt уy хx ґr ԁd ɡg αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw ɑa ıi ʟl ɴn ʀr"
# Digits and signs that stand for letters.
_DIGITS, _SIGNS = "0o 1i 3e 4a 5s 7t 8b", "@a $s !i |l"

_LOOKS = {p[0]: p[1] for p in _ALIKE.split()}
_DIGIT = {p[0]: p[1].upper() for p in _DIGITS.split()}  # in capitals until it is known whether they stand in a word
_SIGN = {ord(p[0]): p[1].upper() for p in _SIGNS.split()}


class _Fold(dict):
    """What a character becomes, worked out when it is first met; blanks for all that is no letter."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in _DIGIT:
            out = _DIGIT[char]
        elif code in _SIGN:
            out = char
        else:
            plain = [c for c in unicodedata.normalize("NFKD", char.casefold()) if unicodedata.category(c) not in ("Mn", "Cf", "Me")]
            out = "".join(_LOOKS.get(c, c) if c.isalpha() else _DIGIT.get(c, " ") for c in plain)
        self[code] = out
        return out


_FOLD = _Fold()
_SIGN_AT_END = re.compile(r"[@$!|]+(?![^\s@$!|])")
_NUMBER = re.compile(r"(?<!\S)[A-Z]+(?!\S)")


def folded(text: str | None) -> str:
    """The words of a text, folded, with one blank before, between and behind them.

    A sign counts as a letter only before another letter or digit of its word,
    a digit only in a word that has a letter.
    """
    out = _SIGN_AT_END.sub(" ", (text or "").translate(_FOLD)).translate(_SIGN)
    words = _NUMBER.sub(" ", out).lower().split()
    return f" {' '.join(words)} " if words else " "


def _pattern(entry: str) -> str:
    """An entry as it is looked for: a whole word or phrase, or a stem if it ends with a star."""
    words = folded(entry.rstrip("*"))
    return words[:-1] if entry.endswith("*") else words


class Lexicon:
    """Weights by pattern, exception phrases, and the logistic function's numbers."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: np.ndarray):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.name = hashlib.sha256(repr((sorted(weights.items()), sorted(exceptions))).encode()).hexdigest()

    def matcher(self) -> "Matcher":
        return Matcher(self.weights, self.exceptions)

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(total, words) @ self.curve, -60, 60)))


class Matcher:
    """One automaton over entries and exceptions."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            if pattern.strip():
                self.automaton.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            if phrase.strip():
                self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """Of a folded text: (length, weight) of the longest entry at each place that no exception covers."""
        found: dict[int, tuple[int, float]] = {}
        covered = []
        if self.empty:
            return found
        for end, (length, weight) in self.automaton.iter(text):
            first = end - length + 1
            if weight is None:
                covered.append((first, end))
            elif length > found.get(first, (0, 0.0))[0]:
                found[first] = (length, weight)
        for first, end in covered:
            for at in [p for p in found if first <= p < end]:
                del found[at]
        return found

    def total(self, text: str) -> float:
        return weight_of(text, self.hits(text))


def weight_of(text: str, hits: dict[int, tuple[int, float]]) -> float:
    """The weights of hits, those of one entry being worth less and less: its weight times one and the logarithm of their number."""
    many: dict[str, list] = {}
    for first, (length, weight) in hits.items():
        many.setdefault(text[first : first + length], [weight, 0])[1] += 1
    return math.fsum(weight * (1 + math.log(n)) for weight, n in many.values())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the score depends on: the weight of a text, and its weight by length."""
    return np.stack([np.log1p(total), np.log1p(100 * total / (words + 10)), np.ones(len(total))], axis=1)


def fit_curve(total: np.ndarray, words: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, a little ridge; a factor below zero is taken as zero."""
    x = features(total, words)
    used = [0, 1, 2]
    while True:
        w = np.zeros(len(used))
        a = x[:, used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(used)), a.T @ (p - label) + 0.01 * w)
            w -= np.clip(step, -5, 5)
        below = [u for u, v in zip(used, w) if v < 0 and u != 2]
        if not below:
            out = np.zeros(3)
            out[used] = w
            return out
        used.remove(below[0])


def stems(words: set[str], least: int, most: int) -> Iterator[str]:
    """The patterns that words could match: each word, and its stems of ``least`` to ``most`` letters."""
    for word in words:
        if len(word) <= 2 * most:
            yield f" {word} "
        for n in range(least, min(len(word), most) + 1):
            yield f" {word[:n]}"


def without_idle_stems(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """The weights without stems that no more toxic rows have than one of their continuations: those would only catch other words."""
    rows = {}
    for key, (_, toxic) in found.items():
        rows[key[:-1]] = max(rows.get(key[:-1], 0), toxic)
    return {key: weight for key, (weight, toxic) in found.items() if key.endswith(" ") or rows.get(key, 0) < toxic}


def _counted(counts: dict[str, list[int]], label: int, keys, most: int) -> Iterator[pa.RecordBatch]:
    """Counts a row's keys by label; gives the counts back when there are many, so that a task holds a bounded number."""
    for key in keys:
        counts.setdefault(key, [0, 0])[label] += 1
    if len(counts) > most:
        yield from _sent(counts)


def _sent(counts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
    if counts:
        clean, toxic = zip(*counts.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["key", "toxic", "clean"])
        counts.clear()


_COUNTS = "key string, toxic long, clean long"


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(label, text) of at most ``most`` labelled rows that are not held out, whole, by the order of the ids' hash.

    Of rows that share an id, the one whose text has the least hash stands for
    it; an id that is marked both 0 and 1 counts once as either.
    """
    mark = only(labels, id_col, label_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    mark = mark.where((id_crc(F.col("id"), 4) != 2) & F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    mark = mark.withColumn("order", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity sample"))).orderBy("order", "id", "label").limit(most)
    text = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(mark), "id")  # at most ``most`` short rows are sent
    one = rows.groupBy("order", "id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("one"))
    return one.select("label", "one.text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 10_000, entries: int = 20_000, support: int = 5, least_weight: float = 1.5, stem_letters: tuple[int, int] = (4, 12), lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon, learned from the whole texts of at most ``train_rows`` labelled rows.

    An entry is a word or stem that ``support`` toxic rows or more have and whose
    log-odds of toxic against clean rows, less two standard deviations, is
    ``least_weight`` or more: that is its weight.  At most ``entries`` are kept,
    the best supported first, and no stem that adds no row to its continuations.  An exception is an entry's word with the word
    before or behind it that ``support`` clean rows or more have, and no larger
    share of the toxic ones.  ``lexicon`` and ``exceptions`` add the caller's own;
    an entry that ends with a star is a stem.

    Rows with a null id or label, or a label but 0 and 1, teach nothing; a null
    text is empty; ids without a document teach nothing; other columns are not
    read.  Without labelled rows of both kinds every score is the share of toxic
    ones (0 without any).  Counts are summed up per task and by Spark; the driver
    gets the entries, the exceptions and two numbers a labelled row.
    """
    small_batches(docs)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.table("sample", labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most=train_rows))
    many = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = many.get(1, 0), many.get(0, 0)
    own = {_pattern(k): float(v) for k, v in (lexicon or {}).items()}
    spared = [_pattern(e) for e in exceptions]
    if not toxic or not clean:
        share = toxic / max(toxic + clean, 1)
        return Lexicon(own, spared, np.array([0.0, 0.0, 60.0 if share == 1 else -60.0]))

    def count_stems(batches):
        release()
        counts: dict[str, list[int]] = {}
        for batch in byte_batches(batches, 1 << 20):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _counted(counts, label, stems(set(folded(text).split()), *stem_letters), 200_000)
        yield from _sent(counts)

    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    counted = sample.mapInArrow(count_stems, _COUNTS).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counted.where(F.col("toxic") >= support).withColumn("weight", odds - 2 * doubt).where(F.col("weight") >= least_weight)
    weights = without_idle_stems({r["key"]: (r["weight"], r["toxic"]) for r in found.orderBy((F.col("weight") * F.col("toxic")).desc(), "key").limit(entries).collect()}) | own

    def count_phrases(batches):
        release()
        matcher = Matcher(weights, [])
        counts: dict[str, list[int]] = {}
        for batch in byte_batches(batches, 1 << 20):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _counted(counts, label, phrases(matcher, folded(text)), 200_000)
        yield from _sent(counts)

    around = sample.mapInArrow(count_phrases, _COUNTS).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = around.where((F.col("clean") >= support) & (F.col("toxic") * clean <= F.col("clean") * toxic))
    spared += [r["key"] for r in harmless.orderBy(F.col("clean").desc(), "key").limit(entries).collect()]

    def weigh(batches):
        release()
        matcher = Matcher(weights, spared)
        for batch in byte_batches(batches, 1 << 20):
            texts = [folded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.total(t) for t in texts], pa.float64()), pa.array([t.count(" ") - 1 for t in texts], pa.int64())], names=["label", "total", "words"])

    rows = sorted(map(tuple, sample.mapInArrow(weigh, "label int, total double, words long").collect()))  # the sum does not depend on the order of tasks
    label, total, words = (np.array(c, float) for c in zip(*rows))
    return Lexicon(weights, spared, fit_curve(total, words, label))


def phrases(matcher: Matcher, text: str) -> set[str]:
    """The words in which entries were found, each with the word before it and with the one behind."""
    out = set()
    for first in matcher.hits(text):
        end = text.index(" ", first + 1)
        before, behind = text.rfind(" ", 0, first), text.find(" ", end + 1)
        if before >= 0:
            out.add(text[before : end + 1])
        if behind >= 0:
            out.add(text[first : behind + 1])
    return out


def score_toxicity(docs: DataFrame, model: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, batch_bytes: int = 2 << 20, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_hits.

    Whole texts are scored, in one pass and without a shuffle.  A null text is
    empty; a text without an entry has the score of that; one row per input row,
    repeats and ties included; a null id is not held out; an empty table gives
    an empty table; other columns are not read, but for ``carry``, which comes
    back with its row and the text.  What is sent is the lexicon, of at most
    twice its bound of entries.
    """
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        model = held.value
        matcher = kept_model(f"toxicity {model.name}", model.matcher)
        for batch in byte_batches(batches, batch_bytes):
            more = batch.columns[2:] if carry else []
            texts = [folded(t) for t in batch.column(2).to_pylist()]
            found = [matcher.hits(t) for t in texts]
            total = np.array([weight_of(t, f) for t, f in zip(texts, found)])
            score = model.score(total, np.array([t.count(" ") - 1 for t in texts], float))
            columns = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array([len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "held_out", "score", "predicted", "n_hits", *["text", "carried"][: len(more)]])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (id_crc(F.col(f"`{id_col}`"), 4) == 2).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits long" + carried_schema(docs, carry))
