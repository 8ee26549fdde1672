import math

import numpy as np

from basalt.llm import quality


def test_features_do_not_cross_texts():
    features = quality.Features(1 << 12)
    texts = ["one two two", "", "x", "\u00e9 \u00e9", "abcd" * 50, " lead and trail ", "\n", "\u6f22\u5b57 x", "a"]
    weight = np.random.default_rng(1).random(1 << 12).astype(np.float32)
    together = features.totals(texts, weight)
    for i, t in enumerate(texts):
        alone = features.totals([t], weight)
        assert np.isclose(together[0][i], alone[0][0]) and together[1][i] == alone[1][0]
        words = t.split()
        grams = sum(max(len(w) + 2 - n + 1, 0) for w in words for n in (3, 4))
        assert alone[1][0] == len(words) + max(len(words) - 1, 0) + grams


def test_labels_are_learned_and_odd_rows_scored(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "ran"], 30)) for _ in range(60)]
    bad = [" ".join(w + "!!" for w in rng.choice(["BUY", "NOW", "FREE", "WIN"], 30)) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(500, None, "x"), (501, "", "x"), (502, "WIN!! " * 20000, "x"), (None, "the cat", "x"), (0, good[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0, "x") for i in range(120)] + [(None, 1, "x"), (7, None, "x"), (9999, 0, "x")], "doc_id long, quality int, text string")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["predicted"] == (i < 60) for i in range(120))
    assert by_id[500]["score"] == by_id[501]["score"] and by_id[502]["predicted"] == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0
    blank = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, blank).collect()} == {0.5}


def mixed(x):
    """The finisher of the polynomial hashes, in plain integers."""
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain_score(model, text):
    """Mean weight of a text's features, one by one, through the logistic function."""
    n, base = model.features.buckets, 0x9E3779B97F4A7C15
    found, words = [], text.split()
    for word in words:
        marked = [0, *(ord(c) + 1 for c in word), 0]
        for size in model.features.grams:
            for i in range(len(marked) - size + 1):
                h = 0
                for c in marked[i : i + size]:
                    h = (h * 0x01000193 + c) % 2**32
                h = (h ^ h >> 15) * (0x85EBCA6B + 2 * size) % 2**32
                found.append((h ^ h >> 13) % n)
    hashes = [mixed(sum((ord(c) + 1) * base**j for j, c in enumerate(w)) % 2**64) for w in words]
    found += [(h >> 20) % n for h in hashes]
    found += [1 if a == b else (mixed((a * 31 + b) % 2**64) >> 20) % n for a, b in zip(hashes, hashes[1:])]
    z = sum(float(model.weight[b]) for b in found) / max(len(found), 1) + model.bias
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_plain_counting(spark):
    model = quality.SubwordModel(quality.Features(1 << 10), np.random.default_rng(3).normal(0, 3, 1 << 10).astype(np.float32), 0.3)
    texts = [None, "", "a", "two two two words", "\u00e9t\u00e9 \u00e0 la mer\tand\nso on " * 40, " x " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score_quality(docs, model).collect():
        assert math.isclose(r["score"], plain_score(model, texts[r["doc_id"]] or ""), rel_tol=1e-6)


def test_whole_texts_are_learned_from_and_repeats_are_settled(spark):
    """What tells the labels apart stands after 60,000 characters; ids come twice, or with both labels."""
    rows = [(i, "the same for all " * 4000 + ("good words " if i % 2 else "bad noise ") * 300) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:10] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(5, 0), (5, 1)], "doc_id long, quality int")
    features = quality.Features(1 << 12)
    take = lambda d: quality.labelled_sample(d, labels, features, id_col="doc_id", text_col="text", label_col="quality", most=4000)
    one, other = take(docs), take(docs.repartition(7))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2] for a, b in zip(one, other, strict=True))
    expected = {(i, i % 2) for i in range(40)} | {(5, 0)}
    import zlib

    assert len(one) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in expected)
    fresh = spark.createDataFrame([(1, "good words " * 50), (2, "bad noise " * 50)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(fresh, quality.fit_quality(docs, labels)).collect()}
    assert score[1] > 0.7 > 0.3 > score[2]


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)


def test_fit_is_that_of_plain_gradient_steps():
    """Every number of every step worked out one by one, in Python."""
    features, dim, rate = quality.Features(16), 3, 0.4
    rng = np.random.default_rng(5)
    sample = []
    for i in range(12):
        which = np.sort(rng.choice(16, 5, replace=False))
        sample.append((which, rng.integers(1, 4, 5), i % 2))
    model = quality.SubwordModel.fit(sample, features=features, dim=dim, steps=30, rate=rate, seed=9)
    rng = np.random.default_rng(9)
    table = [[float(np.float32(x)) for x in row] for row in (rng.random((16, dim)) - 0.5) / dim]
    top, bias, done = [[0.0] * dim, [0.0] * dim], [0.0, 0.0], 0
    for _ in range(3):
        for i in rng.permutation(12):
            lr = rate * (1 - done / 36)
            done += 1
            which, times, label = sample[i]
            share = {int(w): int(t) / int(sum(times)) for w, t in zip(which, times)}
            mean = [sum(s * table[w][d] for w, s in share.items()) for d in range(dim)]
            z = [sum(t * m for t, m in zip(top[c], mean)) + bias[c] for c in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            slope = [p[c] - (c == label) for c in (0, 1)]  # of the loss by z
            of_mean = [sum(slope[c] * top[c][d] for c in (0, 1)) for d in range(dim)]
            for c in (0, 1):
                top[c] = [top[c][d] - lr * slope[c] * mean[d] for d in range(dim)]
                bias[c] -= lr * 0.1 * slope[c]
            for w, s in share.items():
                table[w] = [table[w][d] - lr / max(share.values()) * s * of_mean[d] for d in range(dim)]
    expected = [sum(row[d] * (top[1][d] - top[0][d]) for d in range(dim)) for row in table]
    assert np.allclose(model.weight, expected, atol=1e-4) and math.isclose(model.bias, bias[1] - bias[0], abs_tol=1e-4)
    assert np.abs(model.weight).max() > 0.01


def test_held_out_accuracy_on_a_larger_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_quality(docs, quality.fit_quality(docs, labels)).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
