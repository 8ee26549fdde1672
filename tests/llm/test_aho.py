import hashlib
import re

import numpy as np
import pytest

from basalt.llm import aho

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(doc) - n + 1 if w else 0):
            if tuple(doc[i : i + n]) in grams:
                found.add(item)
                hit.update(range(i, i + n))
    names = ",".join(sorted("null" if i is None else str(i) for i in found))
    return len(doc), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(found)


ITEMS = [
    (1, "What is the capital of the old country by the sea, my friend?"), (2, "one two"), (10, "one two"), (3, None), (4, " ?! "), (5, "à la carte"),
    (6, " ".join(f"w{i}" for i in range(25))), (7, "x x x x x x x x x x x x"), (None, "no id here"),
]
TEXTS = [
    None, "", "...", "ONE, two! three", "someone two", "one twofold", "WHAT is the capital of the old country by the river", "capital of the old country by the sea, my friend?", "À LA CARTE à la carte",
    "pre " + " ".join(f"W{i}" for i in range(3, 20)) + " post", "x " * 30, "no id here", "one\x00two", "one two", "filler words " * 20000 + "one two", "one two one two",
]


@pytest.mark.parametrize("most_words", [8_000_000, 12])
def test_hits_are_those_of_brute_force(spark, most_words):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "one two", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in ITEMS] + [(2, "one two", 0)], "item_id long, text string, doc_id int")
    got = aho.find_contamination(docs, bench, most_words=most_words).collect()
    expected = [(str(i), *brute(t, ITEMS)) for i, t in [*enumerate(TEXTS), (None, "one two"), (3, TEXTS[3])]]
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted(expected)
    assert aho.find_contamination(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in aho.find_contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_what_brute_force_finds(monkeypatch, seed):
    """Few words, so that items and texts overlap at every depth; items are repeated, nested and shorter than a window."""
    monkeypatch.setattr(aho, "LANE", [1, 3, 7, 20, 64, 512][seed])
    rng = np.random.default_rng(seed)
    window, words = 4, 2 + seed % 3
    items = [rng.integers(1, words + 1, int(n)).astype(np.int32) for n in rng.integers(1, 12, 12)]
    items += [items[0], items[1][1:] if len(items[1]) > 1 else items[1]]
    texts = [rng.integers(0, words + 1, int(n)) for n in rng.integers(0, 60, 15)] + [np.concatenate(items)]
    texts = [np.where(t == 0, -1, t) for t in texts]
    auto = aho.WindowAutomaton(items, list(range(len(items))), words, window)
    size = np.array([len(t) for t in texts])
    last, many, place = auto.find(np.concatenate(texts), size)
    got = {(e, n): auto.items(p, n) for e, n, p in zip(last.tolist(), many.tolist(), place.tolist())}
    assert len(got) == len(last)
    expected, at = {}, 0
    for t in texts:
        for k, item in enumerate(items):
            n = min(window, len(item))
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            for i in range(len(t) - n + 1):
                if tuple(t[i : i + n]) in grams:
                    expected.setdefault((at + i + n - 1, n), set()).add(k)
        at += len(t)
    assert got == expected


def test_automaton_of_a_large_benchmark_is_small():
    rng = np.random.default_rng(9)
    rows = [np.minimum(rng.zipf(1.3, 300), 20_000).astype(np.int32) for _ in range(2000)]
    auto = aho.WindowAutomaton(rows, list(range(2000)), 20_000, 10)
    held = sum(x.nbytes for x in vars(auto).values() if isinstance(x, np.ndarray))
    assert held < 30 * sum(map(len, rows))
    last, many, place = auto.find(np.concatenate(rows[:50]).astype(np.int64), np.full(50, 300))
    assert set(last.tolist()) == {300 * t + e for t in range(50) for e in range(9, 300)}


def test_spans_are_places_in_the_original_text(spark):
    text = "é: ÖNE, One two! — à LA carte. one"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    spans = aho.find_contamination(docs, bench, spans=True).first()["spans"]
    assert [text.encode()[s["first"] : s["end"]].decode() for s in spans] == ["One two", "à LA carte"]
    other = spark.createDataFrame([(1, "— one — two, à la carte!")], "doc_id long, text string")
    got = aho.find_contamination(other, bench, spans=True).first()["spans"]
    assert ["— one — two, à la carte!".encode()[s["first"] : s["end"]].decode() for s in got] == ["à la carte"]
