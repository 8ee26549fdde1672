"""A cursor that outlives the process: read before an increment, moved only after its write."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.streaming.messages import publish_increment


class CursorStore:
    """The last cursor, as text, in numbered files of a shared folder; a file is renamed into place, so it is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, *, keep: int = 3):
        self.spark, self.path, self.keep = spark, path, keep
        jvm = spark.sparkContext._jvm
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        return sorted(int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path()) if s.getPath().getName().startswith("cursor-"))

    def read(self) -> str | None:
        """The cursor of the last commit; None if there was none."""
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"cursor-{numbers[-1]}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, value) -> None:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        draft = self._path(f"_draft-{number}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(str(value).encode()))
        stream.close()
        if not self._fs.rename(draft, self._path(f"cursor-{number}")):
            raise OSError(f"cursor {number} was not moved into place")
        for old in numbers[: -self.keep]:
            self._fs.delete(self._path(f"cursor-{old}"), False)

    def publish(self, df: DataFrame, key: str, cursor_column: str, write: Callable[[DataFrame], None]) -> str | None:
        """Writes all rows beyond the stored cursor, then moves it; a crash in between repeats messages and loses none.

        For sources whose times are committed in order: rows that come late are what ``keyset.KeysetCursor`` is for.
        """
        held = self.read()
        reached = publish_increment(df, key, cursor_column, held, write)
        if reached is not None and str(reached) != held:
            self.commit(reached)
        return self.read()


def with_retries(write: Callable[[DataFrame], None], *, attempts: int = 3, wait: float = 1.0) -> Callable[[DataFrame], None]:
    """The write, tried again after a failure, with twice the wait each time; the last failure is raised."""

    def run(df: DataFrame) -> None:
        for n in range(attempts):
            try:
                return write(df)
            except Exception:
                if n + 1 == attempts:
                    raise
                time.sleep(wait * 2**n)

    return run
