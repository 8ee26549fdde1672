"""Cursors, retries, dead letters and sinks: what is promised when something fails."""

import json

import pytest

from basalt import schemas
from basalt.plans import telecom
from basalt.sources import readers
from basalt.streaming import messages
from basalt.streaming.cursor import CursorStore, with_retries
from basalt.streaming.sink import KeyedSink

ROWS = [(i, f"n{i}", "A" if i % 2 else "b", float(i), f"2026-01-{i % 9 + 1:02}") for i in range(1, 41)]


@pytest.fixture
def products(spark):
    return spark.createDataFrame(ROWS, schemas.PRODUCT)


def test_cursor_outlives_a_crash(spark, products, tmp_path):
    sent = []

    def send(df):
        sent.append(sorted(int(r["key"]) for r in df.collect()))

    def broken(df):
        raise OSError("broker")

    store = lambda: CursorStore(spark, str(tmp_path / "cursor"))  # noqa: E731  a new process each time
    early = products.where("last_updated < '2026-01-05'")
    assert store().read() is None
    with pytest.raises(OSError):
        store().publish(early, "ID", "last_updated", broken)
    assert store().read() is None  # nothing was sent, nothing is skipped
    assert store().publish(early, "ID", "last_updated", send) == "2026-01-04"
    with pytest.raises(OSError):
        store().publish(products, "ID", "last_updated", broken)
    assert store().read() == "2026-01-04"
    assert store().publish(products, "ID", "last_updated", send) == "2026-01-09"
    assert store().publish(products, "ID", "last_updated", send) == "2026-01-09" and len(sent) == 2
    assert sorted(sent[0] + sent[1]) == [r[0] for r in ROWS]
    for n in range(5):
        store().commit(n)
    assert store().read() == "4" and len(list((tmp_path / "cursor").glob("cursor-*"))) <= 4


def test_writes_are_tried_again(products):
    tried = []

    def flaky(df):
        tried.append(df.count())
        if len(tried) < 3:
            raise OSError("broker")

    with_retries(flaky, attempts=3, wait=0)(products)
    assert tried == [40, 40, 40]
    with pytest.raises(OSError):
        with_retries(lambda df: (_ for _ in ()).throw(OSError("down")), attempts=2, wait=0)(products)


def test_dead_letters_have_a_reason_and_a_place_and_go_to_a_topic(spark, tmp_path):
    bad = [("1", "{"), ("2", '{"name": "x", "price": 1.0}'), ("3", '{"ID": 5, "price": "dear"}'), ("4", '{"ID": 6}'), ("5", None)]
    good = [("7", json.dumps({"ID": 7, "category": "A", "price": 3.0}))]
    schema = "key string, value string, topic string, partition int, offset long"
    rows = [(k, v, "products", n % 3, n) for n, (k, v) in enumerate(bad + good)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "topic"))

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "topic"))
        dead = lambda df: df.write.mode("append").parquet(str(tmp_path / "dead_topic"))
        messages.consume(source, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "state"), discount_category="A", discount=0.5, dead_topic=dead).awaitTermination()

    run()
    run()  # a restart sends nothing again
    sent = {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "dead_topic")).collect()}
    assert {k: v["reason"] for k, v in sent.items()} == {"1": "not such JSON", "2": "no ID", "3": "price is no number", "4": "no price", "5": "no value"}
    assert all((k, v["topic"], v["partition"], v["offset"]) == (rows[v["offset"]][0], *rows[v["offset"]][2:]) for k, v in sent.items())
    kept = messages.read_batches(spark, str(tmp_path / "dead" / "*"), "value string, reason string, offset long, partition int")
    assert kept.count() == 5 and messages.read_batches(spark, str(tmp_path / "good" / "*"), schemas.PRODUCT).first()["price"] == 1.5


def test_kafka_writer_asks_for_confirmed_delivery(products):
    made = []

    class Writer:
        def __getattr__(self, name):
            return lambda *args, **options: made.append((name, args, options)) or self

    class Messages:
        write = Writer()

    messages.write_kafka(Messages(), "host:9092", "products", **{"kafka.retries": "3"})
    names = [m[0] for m in made]
    options = next(m[2] for m in made if m[0] == "options")
    assert names[0] == "format" and names[-1] == "save" and ("topic", "products") in [m[1] for m in made]
    assert options["kafka.acks"] == "all" and options["kafka.enable.idempotence"] == "true" and options["kafka.retries"] == "3"


def test_kafka_reader_keeps_the_place_and_bounds_its_batches():
    made = []

    class Reader:
        def __getattr__(self, name):
            return lambda *args, **options: made.append((name, args, options)) or self

    class Session:
        readStream = read = Reader()

    readers.read_kafka(Session(), "host:9092", "products", most_per_batch=500, startingOffsets="earliest")
    calls = [(name, args) for name, args, _ in made]
    assert ("format", ("kafka",)) in calls and ("option", ("subscribe", "products")) in calls and ("option", ("maxOffsetsPerTrigger", "500")) in calls
    assert made[-3][2] == {"startingOffsets": "earliest"} and made[-1][0] == "selectExpr" and {"topic", "partition", "offset", "timestamp"} <= set(made[-1][1])
    made.clear()
    readers.read_kafka(Session(), "host:9092", "products", streaming=False, most_per_batch=500, binary=True)
    assert not any(args[:1] == ("maxOffsetsPerTrigger",) for _, args, _ in made) and made[-1][1][1] == "value"


def test_sink_survives_a_lost_checkpoint_and_half_written_versions(spark, tmp_path):
    schema = "ID int, price float, last_updated string"
    rows = lambda *r: spark.createDataFrame(r, schema)
    sink = KeyedSink(spark, str(tmp_path / "sink"), schema, buckets=2, keep=2)
    for n in range(6):
        sink.upsert(rows(*((i, float(n), f"{n}") for i in range(8))))
    held = lambda s: sorted(tuple(r) for r in s.rows().collect())
    assert held(sink) == [(i, 5.0, "5") for i in range(8)]
    again = KeyedSink(spark, str(tmp_path / "sink"), schema, buckets=2, keep=2)  # numbers are the sink's own
    again.upsert(rows((1, 9.0, "9"), (2, 0.0, "0")))
    expected = [(i, 9.0, "9") if i == 1 else (i, 5.0, "5") for i in range(8)]
    assert held(again) == expected
    folders = list((tmp_path / "sink" / "buckets=2").glob("version=*/bucket=*"))
    assert len(folders) <= 2 * 4  # replaced ones go, and so do versions that hold no other
    assert len(list((tmp_path / "sink" / "buckets=2").glob("version=*"))) <= 4
    broken = tmp_path / "sink" / "buckets=2" / "version=99" / "bucket=0"
    broken.mkdir(parents=True)  # a write that did not end counts for nothing
    assert held(again) == expected
    assert held(again.resize(5)) == expected
    assert again.fitted().buckets == 2 and KeyedSink.latest(spark, str(tmp_path / "new"), schema).buckets == 16
    grown = again.fitted(rows_per_bucket=1)
    assert grown.buckets == 8 and held(grown) == expected
    grown.upsert(rows((3, 7.0, "99")))
    latest = KeyedSink.latest(spark, str(tmp_path / "sink"), schema, buckets=2)
    assert latest.buckets == 8 and (3, 7.0, "99") in held(latest) and len(held(latest)) == 8


def test_delta_files_land_and_merge(spark, tmp_path):
    names = [f.split()[0] for f in schemas.TELECOM_DELTA.replace("\n", " ").split(", ")]
    row = lambda i, total, day: [f"c{i}", "F", "0"] + ["Yes"] * 2 + ["7"] + ["No"] * 9 + ["One year"] + ["No"] * 2 + ["70.5", total, "Yes", day]
    (tmp_path / "delta").mkdir()
    lines = [names, row(1, "12.5", "2026-03-02"), row(2, " ", "2026-03-03"), row(1, "13", "2026-03-04"), row(3, "1", "soon")]
    (tmp_path / "delta" / "a.csv").write_text("\n".join(",".join(r) for r in lines))
    delta = telecom.land_delta(spark, str(tmp_path / "delta"))
    assert delta.count() == 4 and delta.columns == names
    base = telecom.stage(telecom.land_delta(spark, str(tmp_path / "delta")).where("customerID = 'c1'").limit(1).drop("load_date"))
    got = {r["customerID"]: (r["TotalCharges"], str(r["load_date"])) for r in telecom.merge_deltas(base, delta).collect()}
    assert got == {"c1": (13.0, "2026-03-04"), "c2": (None, "2026-03-03")}
