import math
import zlib

import numpy as np
import pytest

from basalt.llm import toxicity


def test_folding():
    same = ["idiot loser", "IDIOT, LOSER!!", "1d10t l0$3r", "Idіоt lоsеr", "ｉｄｉｏｔ loser", "ídïot lo​ser", "id!ot |oser $$$ 4711"]
    assert {toxicity.folded(t) for t in same} == {" idiot loser "}
    assert [toxicity.folded(t) for t in (None, "", " 12 34 !! $$", "a1!b")] == [" ", " ", " ", " aiib "]
    assert toxicity.folded("trash### 漢字 ß") == " trash 漢字 ss "


def brute_hits(weights, exceptions, text):
    """Longest entry at each word, by looking at every word for every entry."""
    places = [i for i in range(len(text)) if text[i] == " "]
    covered = {p for e in exceptions for p in range(len(text)) if text.startswith(e, p) for p in range(p, p + len(e) - 1)}
    found = {}
    for p in places:
        own = [k for k in weights if text.startswith(k, p)]
        if own and p not in covered:
            best = max(own, key=len)
            found[p] = (len(best), weights[best])
    return found


def brute_total(weights, exceptions, text):
    """An entry's hits are worth its weight times one and the logarithm of their number."""
    entries = [text[p : p + n] for p, (n, _) in brute_hits(weights, exceptions, text).items()]
    return sum(weights[e] * (1 + math.log(entries.count(e))) for e in set(entries))


def test_matching_is_that_of_plain_search():
    weights = {" idiot ": 3.0, " idio": 1.0, " clown": 2.0, " sore loser ": 5.0, " loser ": 2.5, " fish ": 0.5}
    exceptions = [" clown fish ", " no idiot "]
    matcher = toxicity.Matcher(weights, exceptions)
    rng = np.random.default_rng(1)
    words = ["idiot", "idiots", "idio", "clown", "clowns", "fish", "sore", "loser", "losers", "no", "xidiot"]
    for _ in range(200):
        text = toxicity.folded(" ".join(rng.choice(words, rng.integers(0, 12))))
        assert matcher.hits(text) == brute_hits(weights, exceptions, text)
        assert math.isclose(matcher.total(text), brute_total(weights, exceptions, text))
    assert toxicity.Matcher({}, []).hits(" a ") == {} and toxicity.Matcher({" ": 1.0}, [" "]).empty


def corpus(spark, n=400):
    rng = np.random.default_rng(4)
    plain = [f"w{i}x" for i in "abcdefghijklmnop"]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(plain, 30))
        toxic = i % 4 == 0
        if toxic:
            words[3:6] = [["Vile", "v1le", "vіle"][i // 4 % 3], "nasty" + "abcdefg"[i // 4 % 7], "nasty" + "hijklmn"[i // 4 % 7]]
        elif i % 16 == 1:
            words[7:9] = ["vile", "orchid"]  # a phrase that does no harm
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_lexicon_is_learned(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert " nasty" in model.weights and " vile orchid " in model.exceptions
    assert not any(" nasty".startswith(k) for k in model.weights if k != " nasty")  # shorter stems add nothing
    assert toxicity.fit_toxicity(docs.repartition(7), labels.repartition(3)).score(np.array([1.0, 9.0]), np.array([5.0, 50.0])).tolist() == model.score(np.array([1.0, 9.0]), np.array([5.0, 50.0])).tolist()
    texts = ["vile orchid " * 3 + "wax " * 20, "n4styzz vile " + "wax " * 20, "NASTYQQ!! nastyrr vile", None, "", "wax " * 50_000, "wax " * 20_000 + "vile nastya " * 8_000]
    fresh = spark.createDataFrame([*enumerate(texts), (None, "vile nastyb"), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS predicted")
    got = toxicity.score_toxicity(fresh, model).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in got if r["doc_id"] is not None) == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1)]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert toxicity.score_toxicity(fresh.limit(0), model).count() == 0


def test_score_is_that_of_plain_counting(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels, lexicon={"wax*": 2.0, "Wax Candle": 9.0}, exceptions=("wax figure",))
    assert model.weights[" wax"] == 2.0 and model.weights[" wax candle "] == 9.0 and " wax figure " in model.exceptions
    texts = ["wax figure wax candle waxes", "vile nastyc waxing", "nothing", "", None]
    rows = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        text = toxicity.folded(texts[r["doc_id"]])
        found = brute_hits(model.weights, model.exceptions, text)
        total, n = brute_total(model.weights, model.exceptions, text), len(text.split())
        z = model.curve[0] * math.log1p(total) + model.curve[1] * math.log1p(100 * total / (n + 10)) + model.curve[2]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r["n_hits"] == len(found)


@pytest.mark.parametrize("marks, share", [([], 0), ([(1, 0), (3, 0)], 0), ([(1, 1), (3, 1)], 1), ([(None, 1), (1, None), (1, 5), (77, 1)], 0)])
def test_labels_of_one_kind_or_none(spark, marks, share):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(docs, model).collect()} == {share}


def test_repeated_ids_are_settled(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "two"), (1, "two"), (3, "three"), (4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    take = lambda d: sorted(map(tuple, toxicity.labelled_sample(d, labels, id_col="doc_id", text_col="text", label_col="toxic", most=10).collect()))
    assert take(docs) == take(docs.repartition(3)) and len(take(docs)) == 2 + sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (3, 4)) - 2 * (zlib.crc32(b"1") % 4 == 2)


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got)
