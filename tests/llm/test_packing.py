import zlib

import numpy as np
import pytest

from basalt.llm import packing
from basalt.llm.tokens import tokenizer_path


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once_and_tightly(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 50, 400]))
    lengths = np.clip(rng.lognormal(np.log(capacity) - 1.5, 1, 3000), 1, capacity).astype(int)
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins = packing.plan_bins(counts, capacity)
    placed = np.zeros_like(counts)
    for items, times in bins:
        assert sum(x * n for x, n in items) <= capacity
        for x, n in items:
            placed[x] += n * times
    assert (placed == counts).all()
    assert sum(n for _, n in bins) <= np.ceil(lengths.sum() / capacity * 1.01) + 1


def plain_best_two_fit(lengths, capacity):
    """One bin after another over the pieces themselves: longest first, then the smallest for two that fill more, while that helps."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, rest, gap = [], [], capacity
        for x in left:
            if x <= gap:
                bin_.append(x)
                gap -= x
            else:
                rest.append(x)
        while gap and len(set(bin_)) + len(bin_) > 2:
            least, room = min(bin_), gap + min(bin_)
            pairs = [(a + b, a) for i, a in enumerate(rest) for b in rest[i + 1 :] if a + b <= room]
            if not pairs or max(pairs)[0] <= least:
                break
            total = max(pairs)[0]
            first = min(max(a, total - a) for t, a in pairs if t == total)  # of equal sums the evenest
            bin_.remove(least)
            rest.append(least)
            for x in (first, total - first):
                bin_.append(x)
                rest.remove(x)
            gap += least - total
        bins.append(sorted(bin_, reverse=True))
        left = sorted(rest, reverse=True)
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_that_of_plain_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 23, 60]))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 60))).tolist()
    planned = [sorted((x for x, n in items for _ in range(n)), reverse=True) for items, times in packing.plan_bins(np.bincount(lengths, minlength=capacity + 1), capacity) for _ in range(times)]
    assert planned == plain_best_two_fit(lengths, capacity)


def test_a_length_is_cut_into_groups(spark, monkeypatch):
    """Two lengths have nearly all pieces; groups of ten of them are ranked apart and no place is taken twice."""
    docs = spark.createDataFrame([(i, "the cat" if i % 3 else "dog " * 40) for i in range(300)], "doc_id long, text string").repartition(5)
    pieces = packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=32, id_col="doc_id", text_col="text").persist()
    got = packing.place_pieces(pieces, 32, cell=10).collect()
    assert len(got) == pieces.count() == len({(r["sequence_id"], r["offset"]) for r in got})
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= 32


def test_the_smallest_gives_way_to_two_that_fit_better():
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    # greedily 6 + 3, gap 1; 3 gives way to 2 + 2 and the bin is full
    assert packing.plan_bins(counts, 10)[0] == ([(6, 1), (2, 2)], 1)


def test_best_pair():
    free = np.bincount([5, 4, 4, 1], minlength=20)
    size = np.arange(20)
    assert sorted(packing.best_pair(free, size, 9)) == [4, 5]
    assert sorted(packing.best_pair(free, size, 8)) == [4, 4]
    assert packing.best_pair(free, size, 1) is None
    assert packing.best_pair(np.bincount([5], minlength=20), size, 10) is None


def test_documents_of_every_kind(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = [None, "", "the cat", "dog " * 200, "x y z " * 9, "the cat", "cat " * 31] + [f"word {i}" for i in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "lone", "a"), (2, "the cat", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    packed = packing.pack_documents(docs, path, end_id=1, capacity=32, keep_ids=True)
    got = packed.collect()
    tok = Tokenizer.from_file(path)
    expected = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(str(i), k // 32, k, len(ids[k : k + 32]), zlib.crc32(np.array(ids[k : k + 32], "<u4").tobytes())) for k in range(0, len(ids), 32)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in bins.values():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and len(ids) == length
            at += length
        assert at <= 32
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert whole == {s: [i for _, _, ids in sorted(parts) for i in ids] for s, parts in bins.items()}
    assert len(bins) <= -(-sum(r["length"] for r in got) // 32) + 1
    assert packing.pack_documents(docs.limit(0), path, end_id=1).count() == 0
