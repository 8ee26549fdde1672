"""Fill-in-the-middle transformation by a table-driven automaton over bytes (operator 13).

A text's units are its runs of ASCII letters and all its other characters.  One
automaton reads the UTF-8 bytes of a batch of texts: its table tells, by state
and class of byte, the next state and whether a unit starts, a character starts
or a sentinel ends there.  The first scan keeps only the counts of these
transitions; the second goes to the stretch in which a cut lies, by the counts,
and finds its byte.

After three bytes the state is the same whatever it was before, as no sentinel
is longer; so a text is scanned from many places at once, each started three
bytes early.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, only, release, small_batches

SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Bytes of a lane, and how many bytes before its own it starts.
LANE, BEFORE = 1024, 3

# states: nothing open, a run of letters, "<" was read, "<" and a sentinel's letter were read
_PLAIN, _LETTERS, _OPEN, _NAMED = range(4)
# classes of bytes
_OTHER, _LETTER, _NAME, _LESS, _MORE, _CONTINUES = range(6)
# what a transition emits
UNIT, CHARACTER, SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalpha():
            kind[c] = _NAME if chr(c) in "PSM" else _LETTER
    kind[ord("<")], kind[ord(">")] = _LESS, _MORE
    kind[0x80:0xC0] = _CONTINUES
    return kind


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and what is emitted, by state * 8 + class."""
    after, emit = np.zeros(4 * 8, np.uint8), np.zeros(4 * 8, np.uint8)
    for state in range(4):
        for kind in range(6):
            at = state * 8 + kind
            letter = kind in (_LETTER, _NAME)
            if kind == _CONTINUES:  # the character goes on
                after[at] = _PLAIN
                continue
            emit[at] = CHARACTER
            if not (letter and state in (_LETTERS, _NAMED)):
                emit[at] |= UNIT
            if letter:
                after[at] = _NAMED if state == _OPEN and kind == _NAME else _LETTERS
            else:
                after[at] = _OPEN if kind == _LESS else _PLAIN
                if state == _NAMED and kind == _MORE:
                    emit[at] |= SENTINEL
    return after, emit


CLASS = _classes()
AFTER, EMIT = _tables()


class Texts:
    """The texts of a batch, as bytes in a row, and the counts of their stretches.

    ``first`` is where each text starts, with the end of the last one behind.
    Lanes are stretches of at most ``LANE`` bytes of one text; ``units`` and
    ``characters`` count the transitions of each lane, ``marked`` tells the texts
    in which a sentinel ends.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray):
        self.data, self.first = data, first
        size = np.diff(first)
        lanes = -(-size // LANE)
        self.lane_of = np.concatenate([[0], np.cumsum(lanes)])  # first lane of each text
        self.text = np.repeat(np.arange(len(size)), lanes)
        self.begin = first[:-1][self.text] + (np.arange(len(self.text)) - self.lane_of[:-1][self.text]) * LANE
        self.end = np.minimum(self.begin + LANE, first[1:][self.text])
        self.units, self.characters = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.int64)
        sentinels = np.zeros(len(self.text), np.int64)
        for lane, emitted in self._scan(np.arange(len(self.text))):
            self.units[lane] += emitted & UNIT
            self.characters[lane] += emitted >> 1 & 1
            sentinels[lane] += emitted >> 2
        self.marked = np.bincount(self.text, sentinels, len(size)) > 0
        self.units_before = np.concatenate([[0], np.cumsum(self.units)])

    def _scan(self, lanes: np.ndarray):
        """Steps the automaton through lanes, a byte of each at a time: (lanes, what each emits)."""
        at = np.maximum(self.begin[lanes] - BEFORE, self.first[self.text[lanes]])
        order = np.argsort(at - self.end[lanes], kind="stable")  # the longest first
        lanes, at = lanes[order], at[order]
        own, length = self.begin[lanes] - at, self.end[lanes] - at
        state = np.zeros(len(lanes), np.uint8)
        for t in range(int(length[0]) if len(lanes) else 0):
            live = int(np.searchsorted(-length, -t, "left"))
            step = state[:live] * np.uint8(8) + CLASS[self.data[at[:live] + t]]
            state[:live] = AFTER[step]
            emitted = EMIT[step]
            if t < BEFORE:
                emitted[t < own[:live]] = 0
            yield lanes[:live], emitted

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Units and characters of each text."""
        characters = np.concatenate([[0], np.cumsum(self.characters)])
        return np.diff(self.units_before[self.lane_of]), np.diff(characters[self.lane_of])

    def places(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where unit number ``unit`` of each of the texts starts, or the text ends if it has no more: its byte, and the characters before it."""
        wanted = self.units_before[self.lane_of[text]] + unit
        lane = np.searchsorted(self.units_before, wanted, "right") - 1
        inside = (lane < self.lane_of[text + 1]) & (unit >= 0)
        place, characters = self.first[text + 1].copy(), self.counts()[1][text]
        todo = np.flatnonzero(inside)
        before = np.concatenate([[0], np.cumsum(self.characters)])
        lanes, back = np.unique(lane[todo], return_inverse=True)
        slot = np.full(len(self.text), -1)
        slot[lanes] = np.arange(len(lanes))
        emitted = np.zeros((len(lanes), LANE), np.uint8)
        seen = np.zeros(len(lanes), np.int64)
        early = self.begin[lanes] - np.maximum(self.begin[lanes] - BEFORE, self.first[self.text[lanes]])
        for own, got in self._scan(lanes):
            row = slot[own]
            col = seen[row] - early[row]
            good = col >= 0
            emitted[row[good], col[good]] = got[good]
            seen[row] += 1
        units = np.cumsum(emitted & UNIT, axis=1, dtype=np.int64)
        chars = np.cumsum(emitted >> 1 & 1, axis=1, dtype=np.int64)
        for i, row in zip(todo, back):
            col = int(np.searchsorted(units[row], wanted[i] - self.units_before[lane[i]] + 1))
            place[i] = self.begin[lane[i]] + col
            characters[i] = before[lane[i]] - before[self.lane_of[text[i]]] + chars[row, col] - 1
        return place, characters


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made from."""
    if form == "plain":
        return output
    if form == "psm":
        s, m = output.index(b"<S>"), output.index(b"<M>")
        return output[3:s] + output[m + 3 :] + output[s + 3 : m]
    p, m = output.index(b"<P>"), output.index(b"<M>")
    return output[p + 3 : m] + output[m + 3 :] + output[3:p]


def transform_infill(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, spm_below: int = 20, batch_bytes: int = 4 << 20, keep_output: bool = False) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked, output.

    Four numbers of the id's hash fix the two cuts and the form: ``plain`` if the
    text is empty, has a sentinel or the third number's last two digits are
    ``plain_from`` or more; ``spm`` if those of the fourth are less than
    ``spm_below``; else ``psm``.  A null text is empty and a null id counts as
    empty text; a text of one unit has empty pieces; equal ids with equal texts
    give equal rows, one for each input row; bytes that are no UTF-8 pass as they
    are; an empty table gives an empty one.  Other columns are not read.

    Whole texts, whatever their length, in one pass over the rows and without a
    shuffle; a worker holds the texts of a batch of ``batch_bytes``, or one longer
    text, and its pieces.
    """
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]
    number = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.substring(number, 1, 32).alias("dice"), text.alias("text"))

    def run(batches):
        release()
        for batch in byte_batches(batches, batch_bytes):
            dice = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), ">u4").reshape(batch.num_rows, 4).astype(np.int64)
            raw = [t.as_buffer() for t in batch.column(2)]
            first = np.concatenate([[0], np.cumsum([r.size for r in raw])]).astype(np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            texts = Texts(data, first)
            n, _ = texts.counts()
            plain = (n == 0) | texts.marked | (dice[:, 2] % 100 >= plain_from)
            spm = ~plain & (dice[:, 3] % 100 < spm_below)
            cut = np.sort(dice[:, :2] % (n[:, None] + 1), axis=1)
            todo = np.flatnonzero(~plain)
            (a, a_chars), (b, b_chars) = (texts.places(todo, cut[todo, i]) for i in (0, 1))
            place = dict(zip(todo.tolist(), zip(a.tolist(), b.tolist())))
            outputs, hashes, back = [], [], []
            for i in range(batch.num_rows):
                form = "plain" if plain[i] else "spm" if spm[i] else "psm"
                whole = data[first[i] : first[i + 1]].tobytes()
                if plain[i]:
                    out = whole
                else:
                    x, y = (p - int(first[i]) for p in place[i])
                    out = b"".join((b"<S>", whole[y:], b"<P>", whole[:x], b"<M>", whole[x:y]) if spm[i] else (b"<P>", whole[:x], b"<S>", whole[y:], b"<M>", whole[x:y]))
                hashes.append(hashlib.sha256(out).hexdigest())
                back.append(hashlib.sha256(restore(out, form)).hexdigest())
                if keep_output:
                    outputs.append(out)
            prefix, middle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            prefix[todo], middle[todo] = a_chars, b_chars - a_chars
            forms = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
            columns = [batch.column(0), pa.array(n), forms, pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
            if keep_output:
                columns, names = [*columns, pa.array(outputs, pa.binary())], [*names, "output"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output binary" * keep_output)
