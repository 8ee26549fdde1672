"""Product changes from a database to a keyed sink: pulled once, sent in order, read as a stream, held by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.streaming.keyset import KeysetCursor
from basalt.streaming.order import OrderedPublisher
from basalt.streaming.sink import KeyedSink, consume_keyed


def publish_changes(spark: SparkSession, source: DataFrame, state: str, write: Callable[[DataFrame, int], None], *, key: str = "ID", time: str = "last_updated", look_back: str | float | None = None, partitions: int = 10) -> int:
    """Sends what has changed since the last call; returns the number of the run, 0 if nothing has.

    ``source`` is the table as it is now, of which only the rows beyond the
    stored cursor are read.  ``write`` gets key, value and number of each message
    and the run's number: a run that is sent again after a crash has the same
    rows, numbers and run.
    """
    cursor = KeysetCursor(spark, f"{state}/cursor", time=time, key=key, look_back=look_back)
    publisher = OrderedPublisher(spark, f"{state}/numbers", key=key, order=[time], partitions=partitions)
    return cursor.pull(source, lambda rows, run: publisher.publish(rows, run, lambda messages: write(messages, run)))


def hold_latest(messages: DataFrame, sink: KeyedSink, state: str, *, discount_category: str, discount: float) -> None:
    """Reads all messages that there are into the sink, from where the last call ended; broken ones are set aside under ``state``."""
    consume_keyed(messages.select("value"), sink, f"{state}/dead", f"{state}/checkpoint", discount_category=discount_category, discount=discount).awaitTermination()
