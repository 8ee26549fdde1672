import zlib

import numpy as np
import pytest

from basalt.llm import simple8b
from basalt.llm.tokens import tokenizer_path


@pytest.mark.parametrize("high", [1, 2, 100, 50257, 1 << 31, 1 << 62])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_round_trip(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64)
    if n > 10:
        ids[3:9] = 0
    words, first = simple8b.encode_ids(ids)
    assert (simple8b.decode_ids(words, first, n) == ids).all()
    assert len(first) == -(-n // simple8b.BLOCK)


def test_escapes_among_small_ids():
    ids = np.array([1, (1 << 64) - 1, 2, 15 << 60, 3, 1 << 60] * 100, np.uint64)
    words, first = simple8b.encode_ids(ids)
    assert (simple8b.decode_ids(words, first, len(ids)) == ids).all()


def test_small_ids_share_words():
    assert len(simple8b.encode_ids(np.ones(120, np.uint64))[0]) == 2


def test_files_hold_whole_documents_in_order(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = {5: "the cat", 3: None, 9: "", 1: "x " * 3000, 7: "a  b\n\nc <|endoftext|> d", None: "no id"}
    rows = [(i, t, 1) for i, t in texts.items()] + [(5, "the cat", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = simple8b.token_file_digest(docs, path, end_id=2).collect()
    assert len(got) == len(rows)
    tok, at = Tokenizer.from_file(path), 0
    for row in sorted(got, key=lambda r: r["start"]):
        ids = tok.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (row["start"], row["n_tokens"]) == (at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 1, 3, 5, 5, 7, 9]
    assert simple8b.token_file_digest(docs.limit(0), path, end_id=2).count() == 0


def test_ids_that_are_no_integers_count_as_null(spark):
    docs = spark.createDataFrame([("7", "the cat"), ("x7", "sat"), (None, "on"), ("3", "")], "doc_id string, text string")
    got = simple8b.token_file_digest(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, 3, 7]
