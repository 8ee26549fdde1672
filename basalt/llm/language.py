"""Language identification by cross-parsing (operator 2).

Per language, a suffix automaton of labelled text yields the longest match from
any place of a new text; parsing the text greedily into such matches takes few
phrases if the language is the same.  The language whose phrases, times the
logarithm of its sample's length, are fewest per symbol wins.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, id_crc, kept_model, only, small_batches

#: Symbols of a lane: long texts are parsed from many places at once, and the parses joined exactly.
LANE = 1024


class Alphabet:
    """Numbers of symbols: 0 is anything but a letter, the last a letter that no sample has; case is ignored."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for text in texts for c in text.lower() if c.isalpha()})
        self.size = len(letters) + 2
        number = {c: i + 1 for i, c in enumerate(letters)}
        other = self.size - 1
        self.table = np.array([number.get(chr(i).lower()[:1], other) if chr(i).isalpha() else 0 for i in range(0x110000)], np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """The text's symbols; a run of anything but letters is one symbol, and none at the ends."""
        code = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = code > 0
        keep[1:] |= code[:-1] > 0
        code = code[keep]
        return code[:-1] if len(code) and code[-1] == 0 else code


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``symbols``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Automata:
    """Suffix automata with all their transitions in one sparse table.

    A state's transitions stand at its ``base`` plus their symbols, where no
    other state's do; an entry holds the state it is of, and the next one.  The
    table so grows with the samples' length, not with the alphabet.
    """

    def __init__(self, samples: list[np.ndarray], size: int):
        steps, owner, symbol, to = 1, [], [], []  # state 0 has no transitions: an unseen symbol leads there
        self.root = np.zeros((len(samples), size), np.int32)
        for k, sample in enumerate(samples):
            moves = suffix_automaton(sample)
            for state, row in enumerate(moves):
                owner += [steps + state] * len(row)
                symbol += row.keys()
                to += [steps + x for x in row.values()]
            self.root[k, list(moves[0])] = [steps + x for x in moves[0].values()]
            steps += len(moves)
        self.base, self.entry = _sparse(np.array(owner, np.int64), np.array(symbol, np.int64), np.array(to, np.int64), steps, size)

    def start(self, symbol: np.ndarray) -> np.ndarray:
        """States (automata, lanes) after a phrase's first symbol."""
        return self.root[:, symbol]

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more symbol of each lane, and where a phrase had to start with it."""
        found = self.entry[self.base[state] + symbol]
        new = (found >> 32) != state
        after = found.astype(np.int32)  # the lower half
        if new.any():
            which, lane = np.nonzero(new)
            after[which, lane] = self.root[which, symbol[lane]]
        return after, new


def _sparse(owner: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases and entries of transitions, which come state by state: places are drawn at random until all are free, the states with most first."""
    room = size + 3 * len(owner) + 64
    entry, base = np.full(room, -1, np.int64), np.zeros(states, np.int64)
    claim = np.zeros(room, np.int64)
    rng = np.random.default_rng(11)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    many = np.diff(np.append(first, len(owner)))
    rank = np.argsort(-many, kind="stable")
    levels = np.unique(np.frexp(many[rank].astype(float))[1])[::-1]
    for level in levels:
        todo = rank[np.frexp(many[rank].astype(float))[1] == level]
        while len(todo):
            at = np.repeat(np.arange(len(todo)), many[todo])
            edge = np.arange(len(at)) + np.repeat(first[todo] - (np.cumsum(many[todo]) - many[todo]), many[todo])
            drawn = rng.integers(0, room - size, len(todo))
            place = drawn[at] + symbol[edge]
            claim[place] = at
            fits = np.bincount(at, (entry[place] < 0) & (claim[place] == at), len(todo)) == many[todo]
            keep = fits[at]
            entry[place[keep]] = owner[edge[keep]] << 32 | to[edge[keep]]
            base[owner[first[todo[fits]]]] = drawn[fits]
            todo = todo[~fits]
    return base, entry


def phrase_counts(texts: list[np.ndarray], automata: Automata) -> np.ndarray:
    """Phrases of each text of symbols by each automaton: array (automata, texts).

    Whole texts are parsed.  A text is cut into lanes that are all parsed at
    once, each as if a phrase started with it.  A lane then goes on beyond its
    end until one of its phrases starts where a phrase of the lane that it has
    reached starts: from there both are the same parse.  The text's own parse
    is the first lane's up to that place, then that of the lane reached, and so on.
    """
    kinds = len(automata.root)
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((kinds, len(texts)), np.int64)
    if not size.sum() or not kinds:
        return out
    flat = np.concatenate(texts)
    ends = np.cumsum(size)
    lanes = -(-size // LANE)
    text = np.repeat(np.arange(len(texts)), lanes)
    begin = (ends - size)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    end = np.minimum(begin + LANE, ends[text])
    starts = np.zeros((kinds, len(flat)), bool)  # where phrases start, by the lane that a place belongs to
    order = np.argsort(begin - end, kind="stable")  # the longest first
    long = (end - begin)[order]
    state = np.zeros((kinds, len(order)), np.int32)
    for t in range(int(long[0])):
        live = int(np.searchsorted(-long, -t, "left"))
        place = begin[order[:live]] + t
        symbol = flat[place]
        if t == 0:
            state[:, :live], new = automata.start(symbol), np.True_
        else:
            state[:, :live], new = automata.follow(state[:, :live], symbol)
        starts[:, place] = new
    sums = np.zeros((kinds, len(flat) + 1), np.int64)
    np.cumsum(starts, axis=1, out=sums[:, 1:])
    # lanes that a text goes on after, by automaton
    going = np.flatnonzero(end[order] < ends[text[order]])
    kind = np.repeat(np.arange(kinds), len(going))
    lane = np.tile(order[going], kinds)
    now = state[:, going].ravel()
    place, more = end[lane].copy(), np.zeros(len(lane), np.int64)
    joined = np.full((kinds, len(text)), -1, np.int64)
    extra = np.zeros((kinds, len(text)), np.int64)
    while len(lane):
        symbol = flat[place]
        found = automata.entry[automata.base[now] + symbol]
        new = (found >> 32) != now
        now = np.where(new, automata.root[kind, symbol], found.astype(np.int32))
        same = new & starts[kind, place]
        joined[kind[same], lane[same]] = place[same]
        more += new & ~same
        place = place + 1
        over = same | (place == ends[text[lane]])
        extra[kind[over], lane[over]] = more[over]
        keep = ~over
        kind, lane, now, place, more = kind[keep], lane[keep], now[keep], place[keep], more[keep]
    # every text's own parse, lane by lane
    kind, text = np.repeat(np.arange(kinds), len(texts)), np.tile(np.arange(len(texts)), kinds)
    kind, text = kind[size[text] > 0], text[size[text] > 0]
    first = np.cumsum(lanes) - lanes
    lane, place = first[text], (ends - size)[text]
    while len(lane):
        out[kind, text] += sums[kind, end[lane]] - sums[kind, place] + extra[kind, lane]
        place = joined[kind, lane]
        keep = place >= 0
        kind, text, place = kind[keep], text[keep], place[keep]
        lane = first[text] + (place - (ends - size)[text]) // LANE
    return out


def model_of(sample: dict[str, list[str]]) -> tuple:
    """Alphabet, languages, automata and weights.

    Passages of a language's sample follow one another, with something that is no letter between.
    """
    known = sorted(sample.items())
    alphabet = Alphabet([text for _, texts in known for text in texts])
    parts = [(lang, alphabet.symbols(" ".join(texts))) for lang, texts in known]
    parts = [(lang, p) for lang, p in parts if len(p)]
    return alphabet, [lang for lang, _ in parts], Automata([p for _, p in parts], alphabet.size), np.array([np.log2(len(p) + 1) for _, p in parts])


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, letters_per_lang: int, passage: int = 2000, most_langs: int = 100) -> dict[str, list[str]]:
    """Labelled passages per language, at least ``letters_per_lang`` characters if there are as many, in the order of a hash of id and place.

    Learns only from rows that are not held out and whose language is known.
    Texts are dealt into passages of ``passage`` characters, and any of them may
    be drawn, wherever it stands in its text; the share that is drawn is set by
    the language's total size, so the driver gets a bounded amount at any size
    of the corpus and of a text.  Passages that are equal in all count once.  Of
    more than ``most_langs`` label values those with the most characters are
    learned, ties by name: the others are never predicted.
    """
    rows = only(docs, id_col, text_col, lang_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where((id_crc(F.col("id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a text's passages: whole texts are dealt into them, and every one is as likely to be learned from
    pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / passage).cast("int"))
    sizes = rows.groupBy("lang").agg(F.sum(F.char_length("text").cast("long")).alias("n")).where("n > 0")
    total = {r["lang"]: r["n"] for r in sizes.orderBy(F.col("n").desc(), "lang").limit(most_langs).collect()}
    if not total:
        return {}
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(total.items()) for x in (lang, min(1.0, 3.0 * letters_per_lang / n)))), F.col("lang"))
    draw = lambda i: F.pmod(F.xxhash64(F.col("id").cast("string"), i, F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.filter(F.transform(pieces, lambda i: F.struct(draw(i).alias("draw"), i.alias("piece"))), lambda p: p["draw"] < F.col("share"))
    rows = rows.where((F.col("text") != "") & F.col("lang").isin(*total)).withColumn("share", share).select("lang", "text", F.explode(drawn).alias("p"))
    sample = rows.select("lang", "p.draw", F.substring("text", F.col("p.piece") * passage + 1, F.lit(passage)).alias("text")).distinct().collect()
    out: dict[str, list[str]] = {}
    room = dict.fromkeys(total, letters_per_lang)
    for row in sorted(sample):
        if room[row["lang"]] > 0:
            out.setdefault(row["lang"], []).append(row["text"])
            room[row["lang"]] -= len(row["text"])
    return out


def predict_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", letters_per_lang: int = 24_000, passage: int = 2000, most_langs: int = 100, batch_bytes: int = 2 << 20) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``score`` is one minus the ratio of the winner's normalised phrases to the
    runner-up's (1 if one language alone was learned).  Whole texts are parsed,
    and all letters of all samples are told apart.  A null text, and one without
    a letter, is ``und`` with score 0, as is every text if nothing could be
    learned; ties go to the language first in order; one row per input row; a
    null id is not held out; an empty table gives none; other columns are not
    read.  One pass over the texts, no shuffle.

    At most ``most_langs`` languages are learned, those with the most text: a
    label column may hold anything.  A worker holds some 130 bytes per character
    of the samples (``letters_per_lang`` a language) and a root of four bytes per
    language and letter.
    """
    spark = docs.sparkSession
    small_batches(docs)
    sample = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, letters_per_lang=letters_per_lang, passage=passage, most_langs=most_langs)
    held = spark.sparkContext.broadcast(sample)
    name = f"language {uuid.uuid4().hex}"  # a worker builds the automata once from the text it is sent
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        alphabet, names, automata, weights = kept_model(name, lambda: model_of(held.value))
        for batch in byte_batches(batches, batch_bytes):
            texts = [alphabet.symbols(t.as_py() or "") for t in batch.column(2)]
            lettered = np.array([t.any() for t in texts], bool)
            pred, score = np.array(["und"] * batch.num_rows, object), np.zeros(batch.num_rows)
            if names:
                cost = phrase_counts(texts, automata) * weights[:, None]
                best = np.argmin(cost, axis=0)
                pred = np.where(lettered, np.array(names, object)[best], "und")
                if len(names) > 1:
                    two = np.partition(cost, 1, axis=0)
                    score = np.where(lettered, 1 - two[0] / np.maximum(two[1], 1e-9), 0.0)
                else:
                    score = lettered.astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), (id_crc(F.col(f"`{id_col}`"), 4) == 2).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
