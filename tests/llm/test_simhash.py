import numpy as np
import pytest
import xxhash

from basalt.llm import simhash
from basalt.llm.common import Scratch
from basalt.llm.components import connected_components


def brute_components(fps, tau):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= tau:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = set()
    for _ in range(n):
        x = int(rng.choice(centres))
        for _ in range(int(rng.integers(0, 6))):
            x ^= 1 << int(rng.integers(0, 64))
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("tau,segments,hot", [(2, 8, 2048), (2, 8, 8), (2, 16, 8), (3, 7, 16), (3, 8, 8), (8, 9, 32)])
def test_links_are_those_of_brute_force(spark, tau, segments, hot):
    fps = clustered(400, tau)
    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    scratch = Scratch(spark, "test-simhash")
    edges = simhash.link_forest(nodes, scratch, tau=tau, segments=segments, hot=hot)
    got = {f: f for f in fps} | {r["node"]: r["root"] for r in connected_components(edges, scratch).collect()}
    assert got == brute_components(fps, tau)


def reference_fp(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    rows = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(r, 42) >> bit & 1 for r in rows) * 2 > len(rows) for bit in range(64)]
    return sum(v << bit for bit, v in enumerate(votes)) if rows else 0


def test_documents_of_every_kind(spark):
    texts = ["a b c d e", "A B C D E", None, "", " \t", "one", "one two", "x " * 5000, "héé ß a b", "a b c d e"]
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(None, "one", "x", 2.0), (3, "", "x", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id double")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        assert by_id[i]["fingerprint"] == f"{reference_fp(t, 3):016x}"
    assert by_id[9]["component_id"] == by_id[1]["component_id"] == 0
    assert by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[4]["component_id"] == 2
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [5]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
