"""Benchmark decontamination by one Aho-Corasick automaton (operator 8).

Texts are normalised byte for byte: A-Z become a-z, every other ASCII byte
that is no digit or letter becomes a space, bytes beyond ASCII stay.  A
normalised text is as long as the original, so a match's offsets are offsets
in the original UTF-8 bytes.

The automaton runs over numbers of words and is kept in integer arrays of some
25 bytes per word of the benchmark, with its unbranched paths folded: a state is
a place in the benchmark and a depth, the words since which are the longest
suffix of the text that some item holds, up to a window.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, carried, carried_schema, only, release, small_batches

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words of a lane: the texts of a batch are scanned from many places at once.
LANE = 512


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WindowAutomaton:
    """Finds every occurrence of the items' windows in texts.

    A window is ``window`` words in a row of an item, or a whole item of fewer
    words; items without words have none.  ``row`` holds the items' words, with
    0 after each item.  State (i, d) stands for the words row[i:i+d], i being the
    first place where they occur.  Its next state by a word is (i, d+1) if the
    word is row[i+d]; otherwise it is (j, d+1) if j is the first place of the
    longer string, which the branch table tells; otherwise the state fails to
    the string without its first word.  At place p the first ``seen[p]`` words
    have occurred before, at ``before[p]`` for the first time.  A text's word
    that no item has is -1 and leads to the root.
    """

    def __init__(self, rows: list[np.ndarray], owners: list, words: int, window: int):
        if not 1 <= window <= 15:
            raise ValueError("a window has 1 to 15 words")
        self.window, self.owners, self.words = window, owners, words
        size = np.array([len(r) for r in rows], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        self.row = np.concatenate([np.append(r, 0) for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        n = len(self.row)
        room = np.repeat(self.begin + size, size + 1) - np.arange(n)  # words from each place to its item's end
        self.seen, self.before = np.zeros(n, np.int8), np.zeros(n, np.int32)
        self.ends, self.root = np.zeros(n + 1, np.uint16), np.zeros(words + 1, np.int32)
        whole = {int(k): self.begin[size == k] for k in np.unique(size[(size > 0) & (size < window)])}
        more = []  # (first place, depth, item) of windows that occur again
        first, place = np.zeros(n, np.int32), np.flatnonzero(room > 0)
        alone = np.zeros(0, np.int64)  # places whose words have not occurred before and do not occur again
        for depth in range(1, window + 1):
            place, alone = place[room[place] >= depth], alone[room[alone] >= depth]
            key = first[place].astype(np.int64) * (words + 1) + self.row[place + depth - 1]
            _, at, back, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            first[place] = place[at][back]
            first[alone] = alone
            again = place[first[place] != place]
            self.seen[again], self.before[again] = depth, first[again]
            if depth == 1:
                self.root[self.row[place]] = first[place]
            if depth in whole:  # items of just so many words are windows
                of = np.unique(first[whole[depth]])
                for own in (place, alone):
                    hit = own[np.isin(first[own], of)]
                    self.ends[hit + depth] |= np.uint16(1 << depth)
                more.append(np.stack([first[whole[depth]].astype(np.int64), np.full(len(whole[depth]), depth), self.item_of(whole[depth])]))
            if depth == window:
                more.append(np.stack([first[again].astype(np.int64), np.full(len(again), depth), self.item_of(again)]))
            single = many[back] == 1
            alone, place = np.concatenate([alone, place[single]]), place[~single]
        branch = np.flatnonzero((self.seen > 0) & (self.seen < np.minimum(room, window)))
        key = self._key(self.before[branch], self.seen[branch], self.row[branch + self.seen[branch]])
        order = np.argsort(key)
        self.keys, self.targets = key[order], branch[order].astype(np.int32)
        more = np.unique(np.concatenate(more, axis=1), axis=1) if more else np.zeros((3, 0), np.int64)
        self.shared, self.sharers = more[0] << 4 | more[1], more[2].astype(np.int32)
        self.empty = not n

    def item_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def _key(self, place, depth, word) -> np.ndarray:
        return (place.astype(np.int64) << 4 | depth) * (self.words + 1) + word

    def _first(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place of the ``depth`` words at ``place``."""
        while True:
            back = np.flatnonzero((depth <= self.seen[place]) & (depth > 0))
            if not len(back):
                return place
            place[back] = self.before[place[back]]

    def _step(self, place: np.ndarray, depth: np.ndarray, word: np.ndarray) -> None:
        """Moves the states of all lanes on by a word each."""
        full = np.flatnonzero(depth == self.window)
        if len(full):
            place[full] = self._first(place[full] + 1, depth[full] - 1)
            depth[full] -= 1
        depth[word < 0] = 0
        todo = np.flatnonzero(word > 0)
        while len(todo):
            i, d, c = place[todo], depth[todo], word[todo]
            on = (d > 0) & (self.row[i + d] == c)
            fresh = d == 0
            i = np.where(fresh, self.root[c], i)
            on |= fresh
            rest = np.flatnonzero(~on)
            if len(rest) and len(self.keys):
                key = self._key(i[rest], d[rest], c[rest])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                i[rest[found]] = self.targets[at[found]]
                on[rest[found]] = True
            place[todo[on]], depth[todo[on]] = i[on], d[on] + 1
            todo, i, d = todo[~on], i[~on], d[~on]
            if len(todo):
                place[todo], depth[todo] = self._first(i + 1, d - 1), d - 1

    def find(self, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in texts of ``size`` words, all in a row: (last word, words, first place in the benchmark).

        Every text is scanned once; lanes start ``window - 1`` words before their own first one.
        """
        none = np.zeros(0, np.int64)
        if self.empty or not len(word):
            return none, none, none
        ends = np.cumsum(size)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        own = (ends - size)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(own + LANE, ends[text])
        at = np.maximum(own - self.window + 1, (ends - size)[text])
        order = np.argsort(at - end, kind="stable")  # the longest first
        own, end, at = own[order], end[order], at[order]
        place, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        out = []
        for t in range(int((end - at)[0])):
            live = int(np.searchsorted(at - end, -t, "left"))
            here = at[:live] + t
            self._step(place[:live], depth[:live], word[here])
            good = np.flatnonzero((here >= own[:live]) & (depth[:live] > 0))
            full = good[depth[good] == self.window]
            if len(full):
                out.append((here[full], np.full(len(full), self.window), place[full]))
            marks = self.ends[place[good] + depth[good]]
            for lane, mark in zip(good[marks > 0], marks[marks > 0]):
                short = np.flatnonzero([mark >> e & 1 for e in range(int(depth[lane]) + 1)])
                out.append((np.full(len(short), here[lane]), short, self._first(place[lane] + depth[lane] - short, short.copy())))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (none, none, none)

    def items(self, place: int, words: int) -> set:
        """Items that hold a window, by the first place of the window."""
        key = place << 4 | words
        a, b = np.searchsorted(self.shared, key, "left"), np.searchsorted(self.shared, key, "right")
        own = {self.owners[k] for k in self.sharers[a:b]}
        if words == self.window:
            own.add(self.owners[int(self.item_of(np.int64(place)))])
        return own


def build_automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, most_words: int) -> tuple[dict[bytes, int], list[WindowAutomaton]]:
    """Numbers of the benchmark's words, and its automaton.

    The benchmark is a stated query set, not the corpus: it comes to the driver
    partition by partition, and what stays is four bytes a word and each
    different word once.  Beyond ``most_words`` words the items are dealt to a
    further automaton, so that no worker holds one of over some 200 MB.
    """
    number: dict[bytes, int] = {}
    groups, size = [([], [])], 0
    for item, text in only(benchmark, id_col, text_col).toLocalIterator():
        row = np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], np.int32)
        if size and size + len(row) > most_words:
            groups, size = [*groups, ([], [])], 0
        if len(row):
            groups[-1][0].append(row)
            groups[-1][1].append(item)
            size += len(row)
    return number, [WindowAutomaton(rows, owners, len(number), window) for rows, owners in groups]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_words: int = 8_000_000, spans: bool = False, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked, spans.

    ``spans`` are the maximal runs of hit words as [first byte, end byte) of the
    original text.  One row per input row; a null or empty text has no words; a
    null item id counts as the text "null"; items without words and an empty
    benchmark match nothing; repeated items count by their id; windows that
    several items hold count for each; an empty table gives none.  Columns
    besides the named ones are not read, but for ``carry``, which comes back
    with its row and the text.  No shuffle: the automaton, some 25 bytes a word
    of the benchmark, goes to the executors once, a worker keeps it from task
    to task, and every text is scanned once.  Only a benchmark of over
    ``most_words`` words (some 50 MB) has further automata, each a further scan.
    """
    spark = docs.sparkSession
    small_batches(docs)
    held = spark.sparkContext.broadcast(build_automata(benchmark, item_col, item_text_col, window, most_words))
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", spans array<struct<first:long,end:long>>" * spans + carried_schema(docs, carry)

    def run(batches):
        release()
        number, automata = held.value
        get = number.get
        for batch in byte_batches(batches, 2 << 20):
            texts = [(t.as_py() or "").encode().translate(_TABLE) for t in batch.column(1)]
            lists = [t.split() for t in texts]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            word = np.fromiter((get(w, -1) for row in lists for w in row), np.int64, int(size.sum()))
            begin = np.cumsum(size) - size
            marks, items = np.zeros(len(word) + 1, np.int64), {}
            for auto in automata:
                last, many, place = auto.find(word, size)
                np.add.at(marks, last - many + 1, 1)
                np.add.at(marks, last + 1, -1)
                text = np.searchsorted(begin + size, last, "right")
                for t, p, n in np.unique(np.stack([text, place, many]), axis=1).T.tolist():
                    items.setdefault(t, set()).update(auto.items(p, n))
            hit = np.cumsum(marks)[:-1] > 0
            out, more = [], batch.columns[1:] if carry else []
            for t, (data, a, n) in enumerate(zip(texts, begin.tolist(), size.tolist())):
                own = items.get(t, ())
                names = ",".join(sorted("null" if i is None else str(i) for i in own))
                row = [n, int(hit[a : a + n].sum()) if own else 0, len(own), hashlib.sha256(names.encode()).hexdigest(), bool(own)]
                if spans:
                    row.append(hit_spans(data, hit[a : a + n]) if own else [])
                out.append(row)
            columns = list(zip(*out)) if out else [[]] * (5 + spans)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), *more], names=[*["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"][: 6 + spans], *["text", "carried"][: len(more)]])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))
    return source.mapInArrow(run, schema)


def hit_spans(data: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as byte offsets of the original text."""
    places = [m.span() for m in _WORD.finditer(data)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": places[a][0], "end": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
