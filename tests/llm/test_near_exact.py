"""The near-duplicate stage against exact Jaccard similarities of five-word shingles."""

import random

import numpy as np
import pytest

from basalt.llm import simhash, verify


def shingles(words):
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def exact_kept(docs, similarity=0.8):
    """Least id of each component of the pairs at ``similarity`` or more."""
    sets = {i: shingles(w) for i, w in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in docs}


def table_of(spark, docs):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")


def new_words(rng, n):
    return [f"w{rng.randrange(1 << 30)}" for _ in range(n)]


def test_both_sides_of_the_similarity(spark):
    rng = random.Random(8)
    docs = {}
    for g in range(40):
        base = new_words(rng, 200)
        docs[10 * g] = base
        # scattered edits, five shingles each: likeness about 0.85, 0.80, 0.78, 0.74, 0.70
        for c, edits in enumerate((3, 4, 5, 6, 7), 1):
            edited = list(base)
            for at in rng.sample(range(len(base)), edits):
                edited[at] = new_words(rng, 1)[0]
            docs[10 * g + c] = edited
        # of one base only, so that no other text joins them
        docs = {i: w for i, w in docs.items() if i < 10 * g or i % 10 in (0, 1 + g % 5)}
    wanted = exact_kept(docs)
    assert 8 < len(docs) - len(wanted) < 32
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table_of(spark, docs)).collect()}
    assert wanted <= kept  # nothing below 0.8 goes


def test_alike_within_is_exact():
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base[:80], base[:79], np.zeros(0, np.uint64), base[20:] + np.uint64(0), base + np.uint64(500), np.append(base[20:], base[:5] + np.uint64(900))]
    got = verify.alike_within(sets, 0.8)
    # 79 of 80 links the third to the second, which is 80 of 100 of the first
    assert got.tolist() == [0, 0, 0, 3, 0, 5, 0]
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 30, rng.integers(15, 60)).astype(np.uint64)) for _ in range(25)]
        root = list(range(25))
        for _ in range(25):
            for i in range(25):
                for j in range(25):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if len(a & b) / len(a | b) >= 0.8:
                        root[i] = root[j] = min(root[i], root[j])
        assert verify.alike_within(sets, 0.8).tolist() == root


def edited(rng, base, kind, share):
    """``base`` with about ``share`` of its words appended, cut off or replaced as one block."""
    if kind == "appended":
        return base + new_words(rng, round(len(base) * share))
    if kind == "truncated":
        return base[: len(base) - round(len(base) * share)]
    n = round(len(base) * share / 2)
    at = rng.randrange(len(base) - n)
    return base[:at] + new_words(rng, n) + base[at + n :]


def test_block_edits_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"v{int(i)}" for i in np.arange(3000)]
    docs = {}
    for g in range(90):
        base = [vocabulary[int(3000 * rng.random() ** 3)] for _ in range(rng.randint(150, 900))]
        docs[2 * g] = base
        docs[2 * g + 1] = edited(rng, base, ("appended", "truncated", "replaced")[g % 3], 0.19)
    wanted = exact_kept(docs)
    assert len(docs) - len(wanted) > 60
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table_of(spark, docs)).collect()} == wanted


def test_links_between_are_exact():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 25, rng.integers(0, 50)).astype(np.uint64)) for _ in range(24)]
        label = rng.integers(0, 9, 24)
        queries, members = list(range(9)), list(range(9, 24))
        found = verify.links_between([sets[i] for i in queries], label[queries], [sets[i] for i in members], label[members], 0.8)

        def joined(links):
            root = {int(x): int(x) for x in label}
            for _ in range(24):
                for q, m in links:
                    a, b = root[int(label[q])], root[int(label[9 + m])]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
            return root

        alike = [(q, m) for q in queries for m in range(15) if len(sets[q]) and len(sets[9 + m]) and len(np.intersect1d(sets[q], sets[9 + m])) / len(np.union1d(sets[q], sets[9 + m])) >= 0.8]
        assert set(found) <= set(alike) and joined(found) == joined(alike)
    assert verify.links_between([], np.zeros(0, int), [sets[0]], label[:1], 0.8) == []


@pytest.mark.parametrize("nodes, shingles_, hot", [(6, 10**9, 2048), (1000, 900, 2048), (5, 10**9, 4), (10**9, 10**9, 3)])
def test_large_groups_are_dealt_out_and_exact(spark, monkeypatch, nodes, shingles_, hot):
    """Chains, copies with a shared template and unlike texts in one group of candidates, compared by chunks of a few."""
    monkeypatch.setattr(verify, "NODES", nodes)
    monkeypatch.setattr(verify, "SHINGLES", shingles_)
    monkeypatch.setattr(verify, "LEADERS", 2)
    rng = random.Random(11)
    docs, template = {}, new_words(rng, 120)
    chain = new_words(rng, 100)
    for i in range(20):  # each is like the next, the first is not like the last
        docs[i] = list(chain)
        at = 5 * i % 95
        chain[at : at + 5] = new_words(rng, 5)
    for i in range(100, 130):  # a template with a page of their own: candidates, not alike
        docs[i] = template + new_words(rng, 45 + i % 7)
    for i in range(200, 225):  # copies with single edits
        docs[i] = list(template)
        docs[i][4 * (i - 200)] = new_words(rng, 1)[0]
    docs[300], docs[301] = [], ["one"]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(table_of(spark, docs), hot=hot).collect())
    assert kept == sorted(exact_kept(docs))
