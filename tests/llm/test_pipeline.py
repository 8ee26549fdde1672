"""The pipeline on planted cases, each stage against what its input calls for."""

import random

import pytest

import corpus_pipeline
from basalt.llm import registry, simhash, suffix

ITEM = "which of these seven ancient wonders still stands near the great river today"


def word(rng):
    return "".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sha", "ven", "dor"]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(word(rng) for _ in range(n))
    texts = {i: prose(rng.randint(40, 200)) for i in range(120)}
    junk = {i: " ".join("WIN!!" for _ in range(60)) for i in range(200, 230)}
    copies = {300: texts[5], 301: texts[5], 302: texts[6]}
    long = prose(400).split()
    near = {310: " ".join(long), 311: " ".join(long[:100] + ["edited"] + long[101:]), 312: " ".join([*long, "tail"])}
    passage = prose(70)
    shared = {i: f"{prose(30)} {passage} {prose(30)}" for i in range(320, 326)}
    leaked = {330: f"{prose(50)} {ITEM} {prose(50)}"}
    odd = {340: None, 341: "", 342: "é" * 500, 343: "one"}
    docs = texts | junk | copies | near | shared | leaked | odd
    folder = tmp_path_factory.mktemp("planted")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()] + [(7, texts[7], "en", "s", len(texts[7])), (None, prose(60), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(0, 100), *range(200, 225)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, passage


@pytest.fixture(scope="module")
def stages(spark, planted):
    folder, _, _ = planted
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/stage-{n}")
        out.append(spark.read.parquet(f"{folder}/stage-{n}"))
    return out


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_stages_but_the_last_keep_the_columns(stages):
    for df in stages[:-1]:
        assert dict(df.dtypes) == dict(stages[0].dtypes) and df.columns == stages[0].columns
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_rejected_documents_go_and_clean_ones_stay(stages, planted):
    left = texts_of(stages[1])
    assert not any(200 <= (i or 0) < 230 for i in left)
    assert set(range(120)) <= set(left) and {320, 325, 330, 340, 341, None} <= set(left)


def test_one_document_of_each_group_stays(stages, planted):
    before, after = stages[1], texts_of(stages[2])
    assert {5, 6, 7, 310} <= set(after) and not {300, 301, 302, 311, 312} & set(after)
    assert stages[2].where("doc_id = 7").count() == 1 and before.where("doc_id = 7").count() == 2
    assert set(range(120)) <= set(after) and {320, 321, 322, 323, 324, 325, None} <= set(after)


def test_repeats_go_from_every_text(stages, planted):
    _, _, passage = planted
    before, after = texts_of(stages[2]), texts_of(stages[3])
    assert set(before) == set(after)
    assert all(passage[40:-40] not in (t or "") for t in after.values())
    assert all(before[i] == after[i] for i in [*range(120), None, 343])
    assert after.get(340, None) is None
    data = [(t or "").encode() for t in before.values()]
    seen = {}
    for t in data:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for i, t in zip(before, data):
        spans = [a for a in range(len(t) - 199) if seen[t[a : a + 200]] > 1]
        kept = bytes(b for k, b in enumerate(t) if not any(a <= k < a + 200 for a in spans))
        assert (after[i] or "") == kept.decode(errors="ignore")


def test_leaked_documents_go(stages):
    before, after = texts_of(stages[3]), texts_of(stages[4])
    assert set(before) - set(after) == {330}


def test_every_document_is_packed(stages):
    assert {r["doc_id"] for r in stages[5].collect()} == set(texts_of(stages[4]))


def test_run_gives_the_stages_rows(spark, planted, stages):
    key = lambda r: (str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, planted[0]).collect())) == sorted(map(key, stages[5].collect()))


def test_empty_tables(spark, planted, stages):
    folder = planted[0]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, stages[n].limit(0), folder).count() == 0


def test_near_copies_are_those_of_brute_force(spark):
    rng = random.Random(4)
    docs = {}
    for g in range(25):
        base = [word(rng) for _ in range(rng.randint(80, 250))]
        docs[g * 10] = base
        for c in range(1, rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.choice([1, 2, 40])):
                edited[rng.randrange(len(edited))] = "zz" + word(rng)
            docs[g * 10 + c] = edited
    shingles = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table, hot=16).collect()}
    for i in docs:
        likeness = max((alike(i, j) for j in docs if j < i), default=0)
        if likeness >= 0.88:
            assert i not in kept
        if likeness < 0.6:
            assert i in kept


def edited(rng, words, kind):
    """A text whose five-word shingles are 0.80 to 0.88 like those of ``words``, or None."""
    out = list(words)
    share = rng.uniform(0.05, 0.25)
    if kind == "appended":
        out += [word(rng) + "x" for _ in range(int(share * len(words)))]
    elif kind == "cut off":
        out = out[: -max(int(share * len(words)), 1)]
    elif kind == "block":
        n = max(int(share / 2 * len(words)), 1)
        at = rng.randrange(len(words) - n)
        out[at : at + n] = [word(rng) + "x" for _ in range(n)]
    else:
        for at in rng.sample(range(len(words)), max(int(share / 10 * len(words)), 1)):
            out[at] = word(rng) + "x"
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, out))
    return out if 0.8 <= len(a & b) / len(a | b) < 0.88 else None


@pytest.mark.parametrize("kind", ["appended", "cut off", "block", "scattered"])
def test_recall_just_above_the_limit(spark, kind):
    """Pairs of likeness 0.80 to 0.88: at least 95 of 100 lose one document."""
    rng = random.Random(kind)
    rows, pairs = [], 0
    while pairs < 120:
        base = [word(rng) + word(rng) for _ in range(rng.randint(60, 400))]
        other = edited(rng, base, kind)
        if other:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(pairs)} <= kept
    assert sum(2 * i + 1 not in kept for i in range(pairs)) >= 0.95 * pairs


def test_stages_keep_whatever_columns_there_are(spark, planted):
    """Columns named as operators name theirs, in another order, and a very long text, which holds a repeated passage and words of the benchmark."""
    folder, docs, passage = planted
    rng = random.Random(3)
    long = " ".join(word(rng) for _ in range(40_000))
    rows = [("s", docs[i], i, 0.5, "r", "k") for i in range(60)] + [("s", f"{long} {passage}", 900, 0.5, "r", "k"), ("s", f"{passage} {long[:3000]}", 901, 0.5, "r", "k"), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "score string, text string, doc_id long, carried double, row string, kept_id string")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, table, folder).collect()
        assert out[0].__fields__ == table.columns
        assert all(tuple(r)[3:] == (0.5, "r", "k") and r["score"] == "s" for r in out if r["doc_id"] is not None)
        assert {*range(60), 900, 901} <= {r["doc_id"] for r in out} and (None in {r["doc_id"] for r in out})
        if n == 2:
            left = {r["doc_id"]: r["text"] for r in out}
            assert left[900] == f"{long[3000:]} " and left[901].strip() == ""
            assert left[None] is None
    assert {r["doc_id"] for r in corpus_pipeline.best_fit_packing(spark, table, folder).collect()} == {*range(60), 900, 901, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.select("doc_id", "text"), folder).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_a_row_per_document(spark, sf_dir, name):
    table, key = ("embeddings", "vec_id") if name == "op12_vector_codes" else ("documents", "doc_id")
    rows = registry.QUERIES[name](spark, sf_dir).select(key).distinct().count()
    assert rows == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_spans_merge():
    import numpy as np

    assert suffix.merge_spans(np.array([0, 5, 10, 30]), np.array([5, 9, 20, 40])) == [(0, 9), (10, 20), (30, 40)]
