"""Increments from a database, and the session's settings."""

import uuid

from basalt.session import SETTINGS, build_session
from basalt.sources import readers


def test_increments_are_asked_of_the_database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"2026-01-{i:02}") for i in range(1, 29)], "id int, changed string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "products").options(**driver).save()
    read = lambda cursor, **more: readers.read_jdbc_increment(spark, url, "products", "id", cursor, **driver, **more)
    assert read(None).count() == 28
    fresh = read(20)
    assert sorted(r["id"] for r in fresh.collect()) == list(range(21, 29)) and readers.next_cursor(fresh, "id") == 28
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,20)]" in fresh._jdf.queryExecution().executedPlan().toString().replace("(id", "(ID")
    assert read(20, inclusive=True).count() == 9
    parallel = read(0, partition_column="id", bounds=(1, 29), partitions=4)
    assert parallel.rdd.getNumPartitions() == 4 and parallel.count() == 28
    assert readers.next_cursor(read(28), "id") is None


def test_session_has_its_settings(spark):
    session = build_session("basalt tests", spark__sql__orc__filterPushdown="true")
    assert all(session.conf.get(name) == value for name, value in SETTINGS.items())
