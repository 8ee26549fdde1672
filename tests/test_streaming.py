import json

from basalt import schemas
from basalt.streaming import messages
from basalt.streaming.sink import KeyedSink

GOOD = [{"ID": 1, "name": "a", "category": "A", "price": 10.0, "last_updated": "2026-01-01"}, {"ID": 2, "name": "b", "category": "a", "price": 4.0, "last_updated": "2026-01-02"}, {"ID": 3, "name": "c", "category": "B", "price": 7.0, "last_updated": "2026-01-02"}]
BAD = ['{"ID": 4, "name"', '{"name": "x", "price": 1.0}', '{"ID": 5, "price": "dear"}', '{"ID": 6}']


def lines(rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def run(spark, tmp_path):
    source = spark.readStream.schema("value string").text(str(tmp_path / "topic"))
    messages.consume(source, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "state"), discount_category="A", discount=0.5).awaitTermination()
    good = messages.read_batches(spark, str(tmp_path / "good" / "*"), schemas.PRODUCT)
    dead = messages.read_batches(spark, str(tmp_path / "dead" / "*"), "value string")
    return good, dead


def test_consumer_transforms_sets_aside_and_restarts(spark, tmp_path):
    (tmp_path / "topic").mkdir()
    (tmp_path / "topic" / "one").write_text(lines([*GOOD, *BAD]))
    good, dead = run(spark, tmp_path)
    assert sorted((r["ID"], r["category"], r["price"]) for r in good.collect()) == [(1, "a", 5.0), (2, "a", 2.0), (3, "b", 7.0)]
    assert sorted(r["value"] for r in dead.collect()) == sorted(BAD)
    good, dead = run(spark, tmp_path)
    assert good.count() == 3 and dead.count() == 4
    (tmp_path / "topic" / "two").write_text(lines([GOOD[0], GOOD[0] | {"price": 20.0, "last_updated": "2026-02-01"}]))
    good, _ = run(spark, tmp_path)
    assert good.count() == 5
    latest = {r["ID"]: r["price"] for r in messages.latest_messages(good).collect()}
    assert latest == {1: 10.0, 2: 2.0, 3: 7.0}


def test_publishing_moves_the_cursor_after_the_write(spark):
    rows = spark.createDataFrame([tuple(g.values()) for g in GOOD], schemas.PRODUCT)
    sent = []
    cursor = messages.publish_increment(rows, "ID", "last_updated", None, lambda df: sent.append(df.collect()))
    assert cursor == "2026-01-02" and len(sent[0]) == 3
    assert json.loads(sent[0][0]["value"])["name"] == "a" and sent[0][0]["key"] == "1"
    assert messages.publish_increment(rows, "ID", "last_updated", cursor, lambda df: sent.append(df.collect())) == cursor
    assert len(sent) == 1

    def fail(df):
        raise OSError("broker")

    try:
        cursor = messages.publish_increment(rows, "ID", "last_updated", "2026-01-01", fail)
    except OSError:
        pass
    assert cursor == "2026-01-02"


def test_avro_record_has_the_messages_fields():
    record = json.loads(messages.avro_schema())
    assert [(f["name"], f["type"]) for f in record["fields"]] == [("ID", "int"), ("name", "string"), ("category", "string"), ("price", "float"), ("last_updated", "string")]


def test_sink_holds_one_row_per_key(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "sink"), "ID int, price float, last_updated string", buckets=3)
    rows = lambda *r: spark.createDataFrame(r, "ID int, price float, last_updated string")
    held = lambda: sorted(tuple(r) for r in sink.rows().collect())
    assert held() == []
    sink.upsert(rows())
    sink.upsert(rows((1, 1.0, "a"), (2, 2.0, "a"), (1, 3.0, "b")))
    assert held() == [(1, 3.0, "b"), (2, 2.0, "a")]
    for _ in range(2):  # run again after a crash
        sink.upsert(rows((2, 5.0, "b"), (3, 7.0, None), (1, 9.0, "a")))
        assert held() == [(1, 3.0, "b"), (2, 5.0, "b"), (3, 7.0, None)]
    sink.upsert(rows((3, 8.0, "a")))
    assert held() == [(1, 3.0, "b"), (2, 5.0, "b"), (3, 8.0, "a")]
    assert KeyedSink(spark, str(tmp_path / "sink"), sink.schema, buckets=3).rows().count() == 3
