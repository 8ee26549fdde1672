"""Changes from a database to the keyed sink, with crashes on the way."""

import json
import uuid

import pytest

from basalt import schemas
from basalt.plans import products
from basalt.sources import readers
from basalt.streaming import order
from basalt.streaming.sink import KeyedSink


def test_changes_reach_the_sink_once_and_in_order(spark, tmp_path):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

    def store(rows):
        df = spark.createDataFrame(rows, schemas.PRODUCT)
        df.write.format("jdbc").mode("append").option("url", url).option("dbtable", "products").option("createTableColumnTypes", "last_updated VARCHAR(32)").options(**driver).save()

    def publish(fail=False):
        def write(messages, run):
            messages.select("value").write.mode("overwrite").text(str(tmp_path / f"topic/run={run}"))
            if fail:
                raise OSError("broker")

        table = readers.read_jdbc_increment(spark, url, "products", "last_updated", None, **driver)
        return products.publish_changes(spark, table, str(tmp_path / "producer"), write, look_back="1 day")

    def held():
        messages = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(str(tmp_path / "topic"))
        sink = KeyedSink(spark, str(tmp_path / "sink"), schemas.PRODUCT, buckets=2)
        products.hold_latest(messages, sink, str(tmp_path / "consumer"), discount_category="A", discount=0.5)
        return {r["ID"]: (r["category"], r["price"], r["last_updated"]) for r in sink.rows().collect()}

    store([(i, f"n{i}", "A" if i % 2 else "B", 10.0 * i, f"2026-01-{i:02} 10:00:00") for i in range(1, 7)])
    assert publish() == 1 and publish() == 0
    assert held() == {i: ("a" if i % 2 else "b", 5.0 * i if i % 2 else 10.0 * i, f"2026-01-{i:02} 10:00:00") for i in range(1, 7)}
    store([(3, "n3", "B", 1.0, "2026-01-07 00:00:00"), (3, "n3", "B", 2.0, "2026-01-08 00:00:00"), (9, "late", "B", 9.0, "2026-01-06 09:00:00")])
    with pytest.raises(OSError):
        publish(fail=True)
    store([(10, "after the crash", "B", 3.0, "2026-01-09 00:00:00")])
    assert publish() == 2 and publish() == 3 and publish() == 0
    got = held()
    assert got[3] == ("b", 2.0, "2026-01-08 00:00:00") and got[9][1] == 9.0 and got[10][1] == 3.0 and len(got) == 8
    sent = [json.loads(line) for f in sorted((tmp_path / "topic").glob("run=*/part-*")) for line in f.read_text().splitlines()]
    assert sorted((m["ID"], m["seq"]) for m in sent) == [(1, 1), (2, 1), (3, 1), (3, 2), (3, 3), (4, 1), (5, 1), (6, 1), (9, 1), (10, 1)]
    numbers = spark.createDataFrame([(m["ID"], m["seq"]) for m in sent], "id int, seq long")
    assert order.missing_numbers(numbers, "id").count() == 0
