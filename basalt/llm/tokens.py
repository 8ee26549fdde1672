"""Exact tokenization by pieces, and token counts (operator 9).

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the
ids of a text are the ids of its pieces in a row.  Each distinct piece goes
through the library once per worker and batch of texts; repeats are looked up.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import byte_batches, kept_model, only, small_batches

#: UTF-8 of the code points beyond ASCII with Unicode property White_Space.
_WIDE_BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


#: Bytes of text that are hashed at once; a longer text is hashed alone.
_STRETCH = 1 << 19


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Works by pieces for byte-level BPE without normalizer (``byte_level``) and
    for BPE whose pre-tokenizer drops white space (``drops_blanks``: text is
    never joined across a space or line end).  Any other file goes through the
    library whole, as do texts that hold a special string or, in the first
    case, blanks beyond ASCII.

    Pieces are found, hashed (64 bits) and looked up as arrays; ``max_cached``
    bounds those kept from batch to batch, the first ones seen, and pieces of
    more than ``max_piece`` bytes are never kept.
    """

    def __init__(self, path: str, max_cached: int = 1_000_000, max_piece: int = 40):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.byte_level = pre.get("type") == "ByteLevel" and not norm and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.drops_blanks = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"
        self.blank = np.zeros(256, bool)
        self.blank[[10, 32] if self.drops_blanks else [9, 10, 11, 12, 13, 32]] = True
        if self.byte_level:
            vocab = self.tok.get_vocab()
            self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.bytes_of[i] = len(token)  # one letter a byte
        self.max_cached, self.max_piece = max_cached, max_piece
        self.known = np.zeros(0, np.uint64)  # sorted hashes of the pieces kept, and their slots
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)  # by slot: where its ids are in the pool, and how many
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end bytes of all pieces of texts that lie in a row."""
        blank = self.blank[data]
        before = np.ones(len(data), bool)
        before[1:] = blank[:-1]
        before[begin[end > begin]] = True
        if self.drops_blanks:
            starts = np.flatnonzero(~blank & before)
            after = np.ones(len(data), bool)
            after[:-1] = blank[1:]
            after[end[end > begin] - 1] = True
            return starts, np.flatnonzero(~blank & after) + 1
        # a run of blanks is a piece but for its last, which begins the next piece
        follows = np.zeros(len(data), bool)
        follows[:-1] = ~blank[1:]
        follows[end[end > begin] - 1] = False
        start = blank & (~before | follows)
        start[begin[end > begin]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces: first positions, counts, ids."""
        if not self.byte_level:
            return self._learn_each(pieces)
        # pieces that begin with one blank and then a word can stand in a row as one text
        odd = np.fromiter((p[0] not in " \n" or len(p) < 2 or p[1] in "\t\n\v\f\r " for p in pieces), bool, len(pieces))
        run = [p for p, o in zip(pieces, odd) if not o]
        ids: list[np.ndarray] = []
        for at in range(0, len(run), 10_000):
            ids += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(["".join(run[at : at + 10_000])], add_special_tokens=False)]
        pool = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        sizes = np.fromiter((len(p.encode()) for p in run), np.int64, len(run))
        cuts = np.searchsorted(np.cumsum(self.bytes_of[pool]), np.cumsum(sizes), "left") + 1
        first_odd, count_odd, pool_odd = self._learn_each([p for p, o in zip(pieces, odd) if o])
        first, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[~odd], count[~odd] = np.concatenate([[0], cuts[:-1]])[: len(run)], np.diff(cuts, prepend=0)
        first[odd], count[odd] = first_odd + len(pool), count_odd
        return first, count, np.concatenate([pool, pool_odd])

    def _learn_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, words, done = [], [], 0
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            enc = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(enc.ids, np.uint32))
            words.append(np.array(enc.word_ids, np.int64) + done)
            done += len(part)
        pool = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        count = np.bincount(np.concatenate(words) if words else np.zeros(0, np.int64), minlength=len(pieces))
        return np.cumsum(count) - count, count, pool

    def _slots(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all pieces in a row, and how many pieces each text has."""
        raw = b"".join(parts)
        size = np.array([len(p) for p in parts], np.int64)
        end = np.cumsum(size)
        begin = end - size
        found, i = [], 0
        while i < len(parts):  # a stretch of texts at a time: hashing takes some forty bytes of memory a byte
            j = max(int(np.searchsorted(end, begin[i] + _STRETCH, "right")), i + 1)
            data = np.frombuffer(raw, np.uint8, int(end[j - 1] - begin[i]), int(begin[i]))
            first, stop = self._pieces(data, begin[i:j] - begin[i], end[i:j] - begin[i])
            found.append((first + begin[i], stop + begin[i], rolling.mix(rolling.spans(rolling.prefix(data), first, stop))))
            i = j
        starts, stops, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(hashes, kind="quicksort")
        ranked = hashes[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        unique, sample = ranked[fresh], order[fresh]
        at = np.searchsorted(self.known, unique)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == unique[hit]
        found = np.empty(len(unique), np.int64)
        found[hit] = self.slot[at[hit]]
        new = np.flatnonzero(~hit)
        kept = len(self.first)
        if len(new):
            first, count, pool = self._learn([raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), stops[sample[new]].tolist())])
            self.first = np.concatenate([self.first, first + len(self.pool)])
            self.count = np.concatenate([self.count, count])
            self.pool = np.concatenate([self.pool, pool])
            found[new] = np.arange(kept, kept + len(new))
        slots = np.empty(len(hashes), np.int64)
        slots[order] = np.repeat(found, np.diff(np.append(np.flatnonzero(fresh), len(ranked))))
        short = (stops - starts)[sample[new]] <= self.max_piece
        self._fresh = unique[new][short], found[new][short], kept
        return slots, np.searchsorted(starts, end) - np.searchsorted(starts, begin)

    def _keep(self) -> None:
        """Keeps what the last batch brought in, or drops it if the bound is reached."""
        hashes, slots, kept = self._fresh
        if len(self.known) + len(hashes) > self.max_cached:
            grown = int((self.first[:kept] + self.count[:kept]).max(initial=0))
            self.first, self.count, self.pool = self.first[:kept], self.count[:kept], self.pool[:grown]
        elif len(hashes):
            at = np.searchsorted(self.known, hashes)  # both ascend
            self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slots)

    def _split(self, texts: list[str]) -> tuple[dict[int, list[int]], list[bytes]]:
        """Ids of the texts that must go whole, and the bytes of the others (empty for those)."""
        whole, parts = {}, []
        for i, text in enumerate(texts):
            data = text.encode()
            if not (self.byte_level or self.drops_blanks) or any(s in text for s in self.special) or self.byte_level and not text.isascii() and any(b in data for b in _WIDE_BLANKS):
                whole[i], data = self.tok.encode(text, add_special_tokens=False).ids, b""
            parts.append(data)
        return whole, parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (unsigned 32-bit), and the number of ids of each text."""
        whole, parts = self._split(texts)
        slots, many = self._slots(parts)
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(self.first[slots] - ends[:-1], count) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], np.cumsum(many)])
        lengths = ends[cuts[1:]] - ends[cuts[:-1]]
        self._keep()
        if whole:
            rows, at = [], 0
            for i, n in enumerate(lengths):
                rows.append(np.array(whole[i], np.uint32) if i in whole else out[at : at + n])
                at += n
            out, lengths = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
        return out, lengths

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        whole, parts = self._split(texts)
        slots, many = self._slots(parts)
        ends = np.concatenate([[0], np.cumsum(self.count[slots])])
        cuts = np.concatenate([[0], np.cumsum(many)])
        out = ends[cuts[1:]] - ends[cuts[:-1]]
        self._keep()
        for i, ids in whole.items():
            out[i] = len(ids)
        return out


def encoder_for(path: str, max_cached: int = 1_000_000) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, kept from task to task with the pieces it knows."""
    return kept_model(f"tokens {max_cached} {path}", lambda: PieceEncoder(path, max_cached))


def make_counter(path: str):
    """``lengths(texts)`` for a vocabulary file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)
    return encoder_for(path).lengths


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 2 << 20) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Arrow batches are cut into runs of about ``batch_bytes`` bytes, whatever the
    number of rows, and texts of any length are cut at safe boundaries.  A worker
    holds a batch, or one longer text whole, at some forty bytes a byte.  One row per input row: repeated rows and
    ties stay apart, a null text counts as empty (0 bytes, 0 tokens), a null id
    stays null, an empty table gives an empty table, and columns besides the
    two named ones are not read.  No shuffle.
    """
    small_batches(docs)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        lengths = make_counter(path)
        for batch in byte_batches(batches, batch_bytes):
            texts = batch.column(1).fill_null("")
            n = lengths(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
