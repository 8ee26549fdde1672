import hashlib
import random
import re

import duckdb
import numpy as np

from basalt.llm import infill, oracles


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def by_text(rows):
    return sorted((tuple(map(str, r)) for r in rows))


def texts():
    rng = random.Random(5)
    pieces = ["a", "Pq", "<", "<P", ">", "S", "é", "漢", "😀", " ", "\n", "1", "M", "\x00", "-" * 40]
    made = ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 3, 60, 2500]))) for _ in range(150)]
    return [*made, None, "", "x", "x" * 5000, "é" * 3000, "<" * 2000, "<P", "P>", "a<P>b", "a" * 1022 + "<S>" + "b" * 2000, "a" * 1023 + "<M>", "<S" + ">", "ab " * 90_000]


def test_rows_are_those_of_plain_cutting(spark):
    rows = [*enumerate(texts()), (None, "no id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(__import__("pyspark").sql.functions.lit(1).alias(c) for c in ("n", "form")))
    got = infill.transform_infill(docs)
    assert by_text(got.collect()) == by_text(plain(*r) for r in rows)
    assert by_text(infill.transform_infill(docs.repartition(5), batch_bytes=1).collect()) == by_text(plain(*r) for r in rows)
    assert infill.transform_infill(docs.limit(0)).count() == 0


def test_outputs_give_their_texts_back(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in infill.transform_infill(docs, plain_from=100, spm_below=50, keep_output=True).collect():
        assert infill.restore(bytes(r["output"]), r["form"]) == (rows[r["doc_id"]][1] or "").encode()


def test_counts_and_places_of_each_unit():
    for text in ("", "ab1 c", "é<P>é", "x" * 2500 + "1" + "y" * 1200 + "漢"):
        data = text.encode()
        found = infill.Texts(np.frombuffer(b"zz" + data + b"9", np.uint8), np.array([0, 2, 2 + len(data), 3 + len(data)]))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert found.counts()[0].tolist() == [1, len(units), 1] and found.counts()[1].tolist() == [2, len(text), 1]
        at, chars = found.places(np.full(len(units) + 1, 1), np.arange(len(units) + 1))
        before = ["".join(units[:k]) for k in range(len(units) + 1)]
        assert at.tolist() == [2 + len(b.encode()) for b in before] and chars.tolist() == [len(b) for b in before]
        assert found.marked.tolist() == [False, "<P>" in text, False]


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(oracles.INFILL)
    assert [d[0] for d in cursor.description] == infill.transform_infill(spark.read.parquet(f"{sf_dir}/documents.parquet")).columns
    assert by_text(cursor.fetchall()) == by_text(infill.transform_infill(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
