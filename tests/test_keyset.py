"""Increments by (time, key): late rows, crashes, restarts."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from basalt.sources import readers
from basalt.streaming.keyset import KeysetCursor

SCHEMA = "ID int, name string, last_updated string"
ROWS = [(i, f"n{i}", f"2026-01-{i // 3 + 1:02} 10:00:00") for i in range(30)]


def run(spark, folder, rows, schema=SCHEMA, **more):
    """A pull in a new process, into folders by run: the ids that each run holds."""
    source = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
    cursor = KeysetCursor(spark, str(folder / "cursor"), **({"time": "last_updated", "key": "ID"} | more))
    cursor.pull(source, lambda df, number: df.write.mode("overwrite").parquet(str(folder / f"sink/run={number}")))
    return sent(spark, folder)


def sent(spark, folder):
    if not (folder / "sink").exists():
        return {}
    out = {}
    for r in spark.read.parquet(str(folder / "sink")).collect():
        out.setdefault(r["run"], []).append(r["ID"])
    return {k: sorted(v) for k, v in out.items()}


def test_late_rows_of_the_cursors_own_time_are_delivered_once(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
    early = [r for r in ROWS[:16] if r[0] not in (15 - 15 % 3, 3)]  # the last time is that of 15, 16 and 17
    got = run(spark, tmp_path, early)
    assert got == {1: sorted(r[0] for r in early)}
    assert run(spark, tmp_path, early) == got  # nothing new
    got = run(spark, tmp_path, ROWS[:18])
    assert got[2] == [15, 16, 17]  # the stored time again, with higher and lower keys; 3 came too late without a look-back
    got = run(spark, tmp_path, ROWS)
    assert got[3] == list(range(18, 30)) and len(got) == 3


def test_look_back_finds_rows_that_were_committed_late(spark, tmp_path):
    early = [r for r in ROWS[:20] if r[0] not in (2, 9, 14)]
    run(spark, tmp_path, early, look_back="4 days")
    got = run(spark, tmp_path, ROWS[:20], look_back="4 days")
    assert got[2] == [9, 14]  # 2 is older than the look-back
    assert run(spark, tmp_path, ROWS[:20], look_back="4 days") == got
    changed = [(9, "later", "2026-01-07 11:00:00")]  # a new time is a new change, and delivered rows of the look-back stay delivered
    assert run(spark, tmp_path, [*ROWS[:9], *ROWS[10:20], *changed], look_back="4 days")[3] == [9]
    assert run(spark, tmp_path, [*ROWS[:9], *ROWS[10:], *changed], look_back="4 days")[4] == list(range(20, 30))


@pytest.mark.parametrize("kind, look_back", [("timestamp", "36 hours"), ("timestamp_ntz", "36 hours"), ("date", "1 day"), ("int", 1)])
def test_types_of_time(spark, tmp_path, kind, look_back):
    time = F.dayofmonth("last_updated") if kind == "int" else F.col("last_updated").cast(kind)
    every = spark.createDataFrame(ROWS, SCHEMA).withColumn("last_updated", time)
    more = {"look_back": look_back}
    run(spark, tmp_path, every.where("ID < 20 AND ID NOT IN (4, 16)"), **more)
    assert run(spark, tmp_path, every, **more)[2] == [16, *range(20, 30)]


def test_a_crash_hands_the_same_rows_on_again(spark, tmp_path):
    calls = []

    def broken(df, number):
        calls.append(sorted(r["ID"] for r in df.collect()))
        raise OSError("broker")

    cursor = lambda: KeysetCursor(spark, str(tmp_path / "cursor"), time="last_updated", key="ID", look_back="2 days")
    with pytest.raises(OSError):
        cursor().pull(spark.createDataFrame(ROWS[:10], SCHEMA), broken)
    assert cursor().held() is None
    got = run(spark, tmp_path, ROWS[:20], look_back="2 days")  # more rows by now: the stored ones first, under their number
    assert got == {1: calls[0]} and calls[0] == list(range(10))
    assert run(spark, tmp_path, ROWS[:20], look_back="2 days")[2] == list(range(10, 20))
    commit = KeysetCursor._commit
    try:  # after the write, before the cursor moves
        KeysetCursor._commit = lambda *a: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            run(spark, tmp_path, ROWS, look_back="2 days")
    finally:
        KeysetCursor._commit = commit
    got = run(spark, tmp_path, ROWS, look_back="2 days")
    assert got[3] == list(range(20, 30)) and sum(map(len, got.values())) == 30
    assert {p.name for p in (tmp_path / "cursor" / "delivered").iterdir()} == {"run=3"} and not list((tmp_path / "cursor" / "stored").iterdir())


def test_nulls_and_repeated_rows(spark, tmp_path):
    odd = [(None, "a", "2026-01-01 00:00:00"), (1, "b", None), (2, "c", "2026-01-01 00:00:00"), (2, "c", "2026-01-01 00:00:00")]
    assert run(spark, tmp_path, odd) == {1: [2, 2]}
    assert run(spark, tmp_path, [*odd, odd[2]]) == {1: [2, 2]}


def test_messages_of_an_increment(spark, tmp_path):
    sent = []
    cursor = KeysetCursor(spark, str(tmp_path / "c"), time="last_updated", key="ID")
    assert cursor.publish(spark.createDataFrame(ROWS[:2], SCHEMA), "ID", lambda df, n: sent.extend(df.collect())) == 1
    assert sorted((r["key"], json.loads(r["value"])["name"]) for r in sent) == [("0", "n0"), ("1", "n1")]
    assert cursor.held() == {"run": 1, "time": "2026-01-01 10:00:00", "key": "1"}


def test_bounds_reach_the_database(spark, tmp_path):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(ROWS, SCHEMA).write.format("jdbc").option("url", url).option("dbtable", "products").option("createTableColumnTypes", "last_updated VARCHAR(32)").options(**driver).save()
    table = readers.read_jdbc_increment(spark, url, "products", "last_updated", None, **driver)
    assert len(run(spark, tmp_path, table.where("ID < 20"), look_back="1 day")[1]) == 20
    assert run(spark, tmp_path, table, look_back="1 day")[2] == list(range(20, 30))
    cursor = KeysetCursor(spark, str(tmp_path / "cursor"), time="last_updated", key="ID", look_back="1 day")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = cursor.window(table, cursor.held(), {"time": "2026-01-12 10:00:00", "key": "99"})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "*GreaterThanOrEqual(last_updated,2026-01-09 10:00:00)" in pushed and "*LessThanOrEqual(last_updated,2026-01-12 10:00:00)" in pushed and "Or(" in pushed
