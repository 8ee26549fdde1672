"""A database table as a stream: increments by (time, key), read by tasks in ranges of the key.

The stream's offset is the pair of the last row.  A batch takes the rows beyond
the start and up to the highest pair there was when it was planned, so a batch
that is run again after a restart asks for the same rows.  The database does the
comparing; Spark's checkpoint holds the offsets.

The database is reached through Python's database interface: an option names the
function that connects, as ``module:function``, which every executor must have.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class KeyRange(InputPartition):
    """Rows of a batch from one key to below another; no bound is None."""

    def __init__(self, start: dict, end: dict, first, below):
        super().__init__((start, end, first, below))


class KeysetReader(DataSourceStreamReader):
    """Options: ``connect``, ``database`` (its argument, if it has one), ``table`` (a name or a query in brackets), ``time``, ``key``, ``rowsPerTask``."""

    def __init__(self, options: dict, schema: StructType):
        self.connect, self.database, self.table = options["connect"], options.get("database"), options["table"]
        self.time, self.key, self.rows = options["time"], options["key"], int(options.get("rowsPerTask", "500000"))
        if self.rows < 1:
            raise ValueError("a task reads at least one row")
        self.columns = [f.name for f in schema.fields]

    def _ask(self, sql: str, values: list) -> Iterator[tuple]:
        module, function = self.connect.split(":")
        database = importlib.import_module(module)
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[database.paramstyle]
        connection = getattr(database, function)(*([self.database] if self.database else []))
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", mark), values)
            while rows := cursor.fetchmany(10_000):
                yield from rows
        finally:
            connection.close()

    def _between(self, start: dict, end: dict) -> tuple[str, list]:
        """The condition of a batch: the time's bounds alone first, so that an index on it serves."""
        text, values = f"{self.key} IS NOT NULL AND {self.time} <= ? AND ({self.time} < ? OR {self.key} <= ?)", [end["time"], end["time"], end["key"]]
        if start["time"] is not None:
            text += f" AND {self.time} >= ? AND ({self.time} > ? OR {self.key} > ?)"
            values += [start["time"], start["time"], start["key"]]
        return text, values

    def initialOffset(self) -> dict:
        return {"time": None, "key": None}

    def latestOffset(self) -> dict:
        """The highest pair; that of an empty table is the initial one."""
        sql = f"SELECT {self.time}, max({self.key}) FROM {self.table} t WHERE {self.time} = (SELECT max({self.time}) FROM {self.table} u WHERE {self.key} IS NOT NULL) AND {self.key} IS NOT NULL GROUP BY {self.time}"
        for time, key in self._ask(sql, []):
            return {"time": str(time), "key": key if isinstance(key, int) else str(key)}
        return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        """Ranges of the key with ``rowsPerTask`` rows each, by the database's own numbering; no row, no range."""
        if start == end or end["time"] is None:
            return []
        where, values = self._between(start, end)
        numbered = f"SELECT {self.key} AS k, row_number() OVER (ORDER BY {self.key}) AS n FROM {self.table} t WHERE {where}"
        firsts = [k for (k,) in self._ask(f"SELECT k FROM ({numbered}) q WHERE n % {self.rows} = {1 % self.rows} ORDER BY k", values)]
        firsts = list(dict.fromkeys(firsts))  # a key with more rows than a task reads is one range
        return [KeyRange(start, end, first, below) for first, below in zip(firsts, [*firsts[1:], None])]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        start, end, first, below = partition.value
        where, values = self._between(start, end)
        where, values = f"{where} AND {self.key} >= ?", [*values, first]
        if below is not None:
            where, values = f"{where} AND {self.key} < ?", [*values, below]
        yield from self._ask(f"SELECT {', '.join(self.columns)} FROM {self.table} t WHERE {where}", values)


class KeysetSource(DataSource):
    """``spark.readStream.format("keyset")`` with a declared schema, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def streamReader(self, schema: StructType) -> KeysetReader:
        return KeysetReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeysetSource)


def read_increments(spark: SparkSession, schema: str, *, connect: str, table: str, time: str, key: str, database: str | None = None, rows_per_task: int = 500_000):
    """The stream of a table's changes: each batch is what has been committed beyond the one before.

    Under ``availableNow`` Spark gives such a source one batch a run: after a
    crash, that is the batch that was cut short, and the next run takes what is new.

    A row without time or key is never read; rows that are committed late, at or
    before a time that the stream has passed, are not seen: read with a look-back
    and drop repeats (``messages.deduplicate``), or pull by ``KeysetCursor``.
    """
    register(spark)
    reader = spark.readStream.format("keyset").schema(schema).options(connect=connect, table=table, time=time, key=key, rowsPerTask=str(rows_per_task))
    return (reader.option("database", database) if database else reader).load()
