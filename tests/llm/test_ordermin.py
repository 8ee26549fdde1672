import hashlib
import random
import re

import pytest
import xxhash

from basalt.llm import ordermin

SYMBOL = re.compile(r"[^\x20\x09-\x0D]{1,16}")
HIGH = ~((1 << 32) - 1)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(values, seed=42):
    """xxhash64 of columns: each value's XXH64 seeds the next, longs and ints as little-endian bytes."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def reference(text, k=3, bins=64):
    words = SYMBOL.findall(text)
    kmers = [xx(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    seen, numbered = {}, []
    for place, h in enumerate(kmers):
        h &= HIGH
        numbered.append((xx([(h, 8), (seen.get(h, 0), 4)]) & HIGH, place))
        seen[h] = seen.get(h, 0) + 1
    n = len(kmers)
    levels = 1 if n < 2 else -(-448 // (n - 1))
    order = {}  # each bin's k-mers: by the first of their hashes that falls into it, then by that hash
    for level in range(levels):
        for h, place in numbered:
            h = xx([(h, 8), (level, 4)]) if level else h
            order.setdefault(h >> 58, []).append((level, (h >> 26) & (1 << 32) - 1 if levels > 1 else h, place))
    out = []
    for b in range(-bins // 2, bins // 2):
        found = sorted(order.get(b, []))
        places = [x[2] for x in found]
        if n > 1:
            places += [p for _, p in sorted((xx([(h, 8), (b, 4), "other"]) & HIGH, p) for h, p in numbered)]
        two = sorted(list(dict.fromkeys(places))[:2])
        out.append(f"{xx([(kmers[p], 8) for p in two]) & 0xFFFF:04x}" if two else "----")
    return out


def test_every_bin_of_two_kmers_has_two(spark):
    """Texts of 2 to 600 k-mers: no bin is empty, and all are those of plain sorting."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([4, 4, 4, 5, 5, 6, 7, 9, 30, 100, 300, 449, 450, 451, 452, 453, 500, 600] * 4)]
    rows += [(1000, "a b a b a b a b"), (1001, "x " * 600), (1002, "one two three"), (1003, "")]
    got = {r["doc_id"]: cut(r["fingerprint"]) for r in ordermin.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == reference(text)
        assert i >= 1002 or "----" not in got[i]
    long = next(i for i, t in rows if len(t.split()) == 500)
    assert len(set(got[long])) > 50


def near(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x != "----" or y != "----"]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_every_kind_of_document(spark):
    texts = ["the cat sat on the mat " * 9, None, "", "one", "one two", "x " * 300, "y" * 100, "é ü ß " * 40, "a b c d e f g h i j", "a b c d e f g h i j", "j i h g f e d c b a"]
    rows = [(3 * i, t, "clash", 0.5) for i, t in enumerate(texts)] + [(None, "lone text here", "x", 0.5), (6, "", "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, near_next double")
    got = ordermin.fingerprint_edits(docs).collect()
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = []
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = reference(t), reference(edited), reference(after)
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == sorted(expected)
    assert ordermin.fingerprint_edits(docs.limit(0)).count() == 0
    one = ordermin.fingerprint_edits(docs.limit(1)).first()
    assert one["near_next"] == 1.0


def test_order_counts(spark):
    rows = [("a b c d e f g h i j k l m n o p",), ("i j k l m n o p a b c d e f g h",), ("q r s t u v w x y z",)]
    sigs = [r["fingerprint"] for r in ordermin.fingerprint(spark.createDataFrame(rows, "text string"), k=1).collect()]
    assert 0 < near(cut(sigs[0]), cut(sigs[1])) < 1 and near(cut(sigs[0]), cut(sigs[2])) == 0


def cut(s):
    return [s[i : i + 4] for i in range(0, len(s), 4)]


@pytest.mark.parametrize("words", [12, 20, 40, 160])
def test_swapped_halves_are_less_alike_than_their_kmers(spark, words):
    """Plain MinHash sees nearly the same k-mers; the order of short texts counts as well as that of long ones."""
    rng = random.Random(words)
    rows, jaccard = [], []
    for _ in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        rows.append((" ".join(w), " ".join(w[words // 2 :] + w[: words // 2])))
        a, b = ({tuple(x[i : i + 3]) for i in range(words - 2)} for x in (w, w[words // 2 :] + w[: words // 2]))
        jaccard.append(len(a & b) / len(a | b))
    docs = spark.createDataFrame(rows, "text string, swapped string")
    both = ordermin.fingerprint(ordermin.fingerprint(docs), text_col="swapped", out="other").collect()
    likeness = sum(near(cut(r["fingerprint"]), cut(r["other"])) for r in both) / len(both)
    assert likeness < sum(jaccard) / len(jaccard) - 0.15 and likeness < 0.6


def test_a_hot_id_is_cut_by_its_texts(spark):
    """Half of all rows share an id, a quarter has none: every row still gets the next one's text."""
    rows = [(7, f"hot row number {i} of many") for i in range(200)] + [(None, f"row {i} without an id") for i in range(100)] + [(i, f"own row {i}") for i in range(1000, 1100)] + [(7, "")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:3] for r in ordermin.fingerprint_edits(docs).collect())
    tie = {t: signed(xxhash.xxh64_intdigest(t.encode(), 42)) for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    expected = []
    for n, (_, t) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(t) // 2
        expected.append((len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert got == sorted(expected)


def test_very_long_text(spark):
    text = " ".join(f"word{i % 5000}" for i in range(120_000))
    sig = ordermin.fingerprint(spark.createDataFrame([(text,)], "text string")).first()["fingerprint"]
    assert cut(sig) == reference(text)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = ordermin.fingerprint_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
