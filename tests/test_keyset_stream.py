"""A database's table as a stream: ranges, restarts, no repeats and no losses."""

import sqlite3

import pytest
from pyspark.sql import types as T

from basalt.sources import keyset_stream

SCHEMA = "id int, name string, changed string"


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE products (id INTEGER, name TEXT, changed TEXT)")
    return path


def add(path, rows):
    with sqlite3.connect(path) as con:
        con.executemany("INSERT INTO products VALUES (?, ?, ?)", rows)


def rows(ids):
    return [(i, f"n{i}", f"2026-01-01 {i // 4:02}:00:00") for i in ids]


def run(spark, database, folder, fail=False):
    """All batches there are, in a new query over the old checkpoint; what each batch held, by the sink."""
    stream = keyset_stream.read_increments(spark, SCHEMA, connect="sqlite3:connect", database=database, table="products", time="changed", key="id", rows_per_task=3)
    calls = []

    def one(batch, number):
        calls.append(number)
        batch.write.mode("overwrite").parquet(str(folder / f"sink/batch={number}"))
        if fail:
            raise OSError("after the write, before the checkpoint")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    if fail:
        with pytest.raises(Exception, match="before the checkpoint"):
            query.awaitTermination()
    else:
        query.awaitTermination()
    if not (folder / "sink").exists():
        return {}
    out = {}
    for r in spark.read.parquet(str(folder / "sink")).collect():
        out.setdefault(r["batch"], []).append(r["id"])
    return {k: sorted(v) for k, v in out.items()}


def test_restarts_neither_repeat_nor_lose_rows(spark, database, tmp_path):
    assert sum(map(len, run(spark, database, tmp_path).values())) == 0
    add(database, [*rows(range(10)), (None, "no id", "2026-01-01 00:00:00"), (99, "no time", None)])
    got = run(spark, database, tmp_path)
    assert sorted(i for ids in got.values() for i in ids) == list(range(10))
    assert run(spark, database, tmp_path) == got
    add(database, rows(range(10, 24)))  # 10 and 11 have the time of 8 and 9
    broken = run(spark, database, tmp_path, fail=True)
    assert sorted(i for ids in broken.values() for i in ids) == list(range(24))
    add(database, rows(range(24, 30)))  # committed while the stream was down
    assert run(spark, database, tmp_path) == broken  # a run to the end first finishes the batch that was cut short, with the same rows
    got = run(spark, database, tmp_path)
    assert sorted(i for ids in got.values() for i in ids) == list(range(30))
    assert all(got[k] == v for k, v in broken.items())


def reader(database, **more):
    options = {"connect": "sqlite3:connect", "database": database, "table": "products", "time": "changed", "key": "id"} | more
    return keyset_stream.KeysetReader(options, T.StructType.fromDDL(SCHEMA))


def test_tasks_read_ranges_of_the_key(database):
    add(database, [*rows(range(20)), *[(7, "again", "2026-01-01 01:30:00")] * 5])
    source = reader(database, rowsPerTask="4")
    start, end = source.initialOffset(), source.latestOffset()
    assert start == {"time": None, "key": None} and end == {"time": "2026-01-01 04:00:00", "key": 19}
    parts = source.partitions(start, end)
    read = [sorted(r[0] for r in source.read(p)) for p in parts]
    assert sorted(i for ids in read for i in ids) == sorted([*range(20), *[7] * 5])
    assert all(len(ids) <= 4 or set(ids) >= {7} for ids in read) and len(parts) >= 5
    assert all(a[-1] < b[0] for a, b in zip(read, read[1:]))
    middle = {"time": "2026-01-01 02:00:00", "key": 9}
    assert sorted(r[0] for p in source.partitions(middle, end) for r in source.read(p)) == list(range(10, 20))
    assert source.partitions(end, end) == [] and source.partitions(start, start) == []
    assert [len(list(reader(database, rowsPerTask="1").partitions(start, end)))] == [20]
    with pytest.raises(ValueError):
        reader(database, rowsPerTask="0")
