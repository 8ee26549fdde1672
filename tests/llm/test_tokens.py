import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from basalt.llm import tokens

PARTS = [" ", "  ", "\n", "\n\n", " \n", "\t", "\r", "a", "bc", "é", "́", "1", "23", "!", "'s", "'ll", "\x1c", "\x85", "\xa0", " ", " ", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "‍", "ΑΣ", "İ", "\x00", "　", "﻿", "x y", "word " * 30]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["z" * 3000, ""]
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(name), max_cached=500)
    for at in range(0, len(texts), 1500):
        part = texts[at : at + 1500]
        ids, n = encoder.encode(part)
        expected = [e.ids for e in encoder.tok.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]
        assert encoder.lengths(part).tolist() == n.tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_every_kind_of_row(spark, name):
    path = tokens.tokenizer_path(name)
    texts = [None, "", "the cat sat", "é" * 2000, "the cat sat"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "y"), (2, "the cat sat", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokens.count_tokens(docs, path, limit=3).collect()
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((str(i), len((t or "").encode()), n, n > 3) for i, t, _ in rows for n in [count(t or "")])
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_longer_than_a_stretch(name):
    """Beyond half a megabyte, with what goes piece by piece and what goes to the library whole."""
    rng = random.Random(9)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    texts = [long, "short one", long[:700_000] + "\xa0" + long[:1000], long[:600_000] + "<|endoftext|>" + long[:50], "", "z" * 600_000 + " end", "\n".join([long[:9000]] * 70)]
    assert sum(len(t.encode()) > tokens._STRETCH for t in texts) >= 5
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(name))
    ids, n = encoder.encode(texts)
    expected = [encoder.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert encoder.lengths(texts).tolist() == n.tolist()


def test_counts_of_long_texts_in_tasks(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["some words " * 80_000, "a b", "one\xa0two " * 60_000]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}
