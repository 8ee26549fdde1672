import zlib

import numpy as np
import pytest

from basalt.llm import language


def phrases(text, sample):
    """Greedy longest matches, by the definition."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


@pytest.mark.parametrize("seed, lane", list(enumerate([7, 16, 64, 5, 1, 1024])))
def test_automata_count_longest_match_phrases_of_whole_texts(monkeypatch, seed, lane):
    monkeypatch.setattr(language, "LANE", lane)  # whatever the lanes, the parse is that of the whole text
    rng = np.random.default_rng(seed)
    samples = [bytes(rng.integers(1, 5, 300, dtype=np.uint8)), bytes(rng.integers(1, 4, 500, dtype=np.uint8))]
    texts = [bytes(rng.integers(1, 6, int(n), dtype=np.uint8)) for n in rng.integers(0, 200, 20)] + [samples[0][40:200], samples[1] + samples[0][:100]]
    as_symbols = lambda x: np.frombuffer(x, np.uint8).astype(np.int32)
    got = language.phrase_counts([as_symbols(x) for x in texts], language.Automata([as_symbols(x) for x in samples], 7))
    assert got.tolist() == [[phrases(x, sample) for x in texts] for sample in samples]


def test_winner_and_score_are_those_of_plain_parsing(spark):
    rng = np.random.default_rng(4)
    words = {lang: ["".join(rng.choice(list("abcdefgéß"), 5)) for _ in range(40)] for lang in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choice(words[lang], 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    rows += [(100 + i, " ".join(rng.choice(words["aa"] + words["cc"], int(n))), None) for i, n in enumerate([1, 5, 40, 900])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.train(docs, id_col="doc_id", text_col="text", lang_col="lang", letters_per_lang=1000, passage=150)
    assert sorted(sample) == ["aa", "bb", "cc"] and all(1000 <= sum(map(len, x)) < 1150 for x in sample.values())
    got = {r["doc_id"]: r for r in language.predict_language(docs, letters_per_lang=1000, passage=150).collect()}
    joined = {lang: " ".join(" ".join(x).split()) for lang, x in sample.items()}  # blanks in a row are one symbol
    for doc_id, text, _ in rows:
        cost = sorted((phrases(text, x) * np.log2(len(x) + 1), lang) for lang, x in joined.items())
        assert got[doc_id]["lang_pred"] == cost[0][1] and np.isclose(got[doc_id]["score"], 1 - cost[0][0] / cost[1][0])


def test_scripts_of_many_letters_beside_each_other(spark):
    """Thirteen labels, two of them with 1500 letters each, drawn from one block of characters."""
    rng = np.random.default_rng(5)
    block = rng.permutation(np.arange(0x4E00, 0x4E00 + 3000))
    scripts = {"zz1": [chr(c) for c in block[:1500]], "zz2": [chr(c) for c in block[1500:]]}
    for k in range(11):
        scripts[f"l{k:02}"] = [chr(c) for c in range(0x61 + k, 0x61 + k + 15)]
    vocabulary = {lang: ["".join(rng.choice(letters, 3)) for _ in range(400)] for lang, letters in scripts.items()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 150)), lang) for i, lang in enumerate(list(scripts) * 25)]
    got = language.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(pred[i] == lang for i, _, lang in rows)


def test_any_part_of_a_text_is_learned_from_and_ties_go_to_the_first(spark):
    """The language shows only after 30,000 characters that both have; equal samples tie."""
    same = "x1 y2 " * 5000
    rows = [(i, same + (" ".join(ENGLISH) if lang == "en" else " ".join(GERMAN)) * 200, lang) for i, lang in enumerate(["en", "de"] * 12)]
    docs = spark.createDataFrame([*rows, (100, " ".join(ENGLISH), None), (101, " ".join(GERMAN), None)], "doc_id long, text string, lang string")
    pred = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs).collect()}
    assert pred[100] == "en" and pred[101] == "de"
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:12]
    tied = spark.createDataFrame([(i, ENGLISH[0], lang) for i, lang in zip(learned, ["en", "de"] * 6)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.predict_language(tied).collect()} == {("de", 0.0)}


ENGLISH = ["the cat sat on the mat and the dog ran to the house", "there is a bird in the tree and it sings to the sun", "when the rain comes we go into the house and read", "he said that the water was cold and the road was long"]
GERMAN = ["die Katze sitzt auf der Matte und der Hund läuft nach Hause", "es ist ein Vogel in dem Baum und er singt für die Sonne", "wenn der Regen kommt gehen wir in das Haus und lesen", "er sagte dass das Wasser kalt war und der Weg weit"]


def test_languages_and_odd_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([(t, "en") for t in ENGLISH * 6] + [(t, "de") for t in GERMAN * 6])]
    odd = [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "123 ?!", "en", "x"), (1003, "the house and the dog " * 3000, None, "x"), (None, "das Haus und der Hund", None, "x"), (1004, "日本語", None, "x"), (1, ENGLISH[1], "en", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = language.predict_language(docs).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(pred[i] == lang for i, _, lang, _ in rows)
    assert [pred[i] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert pred[1004] in ("de", "en")
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    assert language.predict_language(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in language.predict_language(unlabelled).collect()} == {"und"}


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_a_bounded_number_of_labels_is_learned(spark):
    """The label column may hold anything: the languages with the most text are learned."""
    rows = [(i, "alpha beta gamma delta " * 20, "la") for i in range(8)] + [(i, "eins zwei drei vier " * 10, "lb") for i in range(10, 18)] + [(i, f"junk {i} word", f"junk{i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.train(docs, id_col="doc_id", text_col="text", lang_col="lang", letters_per_lang=24_000, most_langs=2)
    assert set(sample) == {"la", "lb"}
    got = language.predict_language(docs, most_langs=2).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"la", "lb"}
    assert all(r["lang_pred"] == "la" for r in got if r["doc_id"] < 8)
