"""Sinks and tables: full replacement, append, partitions, buckets, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codec by format, where the caller names none.
CODEC = {"orc": "snappy", "parquet": "snappy", "csv": "none"}
#: Rows that one task sorts and writes: each takes some 50 bytes beside its values.
TASK_ROWS = 2 << 20


def write_files(df: DataFrame, path: str, fmt: str = "orc", *, mode: str = "overwrite", codec: str | None = None, partition_by: list[str] | None = None, **options: str) -> None:
    """Writes a folder of files; a second run replaces the first."""
    writer = df.write.format(fmt).mode(mode).option("compression", codec or CODEC.get(fmt, "snappy")).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_clustered(df: DataFrame, path: str, fmt: str = "parquet", *, cluster_by: list[str], lookup: list[str] | None = None, parts: int | None = None, group_bytes: int | None = None, mode: str = "overwrite") -> None:
    """Files whose rows lie together by ``cluster_by``, with bloom filters on ``lookup``, so that reads skip what they cannot need.

    Rows are dealt out by range and sorted, so the least and highest values of a
    row group or stripe say much; the filters tell of columns that the order does
    not help whether a value can be there at all.  ``group_bytes`` is the size of
    a row group or stripe.  By default there are as many files as the table's
    counted size calls for, so that what a task sorts does not grow with the
    table; rows of one ``cluster_by`` value that are too many for a file go on
    in the next.
    """
    parts = parts or _tasks_for(df)
    options = {}
    for column in lookup or []:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
    if lookup:
        options["orc.bloom.filter.columns"] = ",".join(lookup)
    if group_bytes:
        options |= {"parquet.block.size": str(group_bytes), "orc.stripe.size": str(group_bytes)}
    dealt = df.withColumn("__turn", _turn(df)).repartitionByRange(parts, *cluster_by, "__turn").drop("__turn")
    write_files(dealt.sortWithinPartitions(*cluster_by), path, fmt, mode=mode, **options)


#: Types that hold every value of the type before the arrow.
_WIDER = {"tinyint": "smallint int bigint float double", "smallint": "int bigint float double", "int": "bigint double", "bigint": "", "float": "double", "date": "timestamp timestamp_ntz"}


def insert_by_name(df: DataFrame, table: str) -> None:
    """Appends rows to a table, column by column of the same name, whatever their order.

    A column that the table has not, or one of a type that does not fit (the
    table's, or one that holds all of its values), is an error, and nothing is
    written; a column that the rows have not is NULL.  Names are told apart
    without regard to case, as the catalog does.
    """
    spark = df.sparkSession
    target = spark.table(table).schema
    wanted = {f.name.lower(): f for f in target.fields}
    given: dict[str, str] = {}
    for f in df.schema.fields:
        if f.name.lower() in given:
            raise ValueError(f"column {f.name} is there twice")
        given[f.name.lower()] = f.name
        if f.name.lower() not in wanted:
            raise ValueError(f"{table} has no column {f.name}")
        have, want = f.dataType.simpleString(), wanted[f.name.lower()].dataType.simpleString()
        if have not in (want, "void") and want not in _WIDER.get(have, "").split():
            raise ValueError(f"column {f.name} is {have}, and {table} has {want}")
    rows = df.select(*((F.col(f"`{given[n]}`") if n in given else F.lit(None)).cast(f.dataType).alias(f.name) for n, f in wanted.items()))
    partition_by, buckets, bucket_by = _table_layout(spark, table)
    _dealt(rows, partition_by, buckets, bucket_by).write.insertInto(table)


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and bytes of their values, 8 a value and the length of those that have one, counted.

    The optimizer's estimate goes by the files, which may be packed a hundred
    times closer than rows in memory.  Only columns whose values have a length
    are read.
    """
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)
    column = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col(f"`{f.name}`").cast("string")
    lengths = [F.sum(F.octet_length(column(f)).cast("long")) for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    rows, *longer = df.agg(F.count(F.lit(1)), *lengths).first()
    return rows, 8 * len(df.columns) * rows + sum(n or 0 for n in longer)


def _tasks_for(df: DataFrame, task_bytes: int = 512 << 20) -> int:
    """Tasks of which each has at most ``task_bytes`` and ``TASK_ROWS`` of a table."""
    rows, size = table_size(df)
    return max(-(-size // task_bytes), -(-rows // TASK_ROWS), 1)


def writers_for(df: DataFrame, task_bytes: int = 512 << 20) -> int:
    """Tasks that may write one partition: as many as the table has ``task_bytes`` or two million rows, at most the session's number.

    The rows are counted, unless the optimizer's estimate calls for all tasks already.
    """
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most if known > task_bytes * most else min(_tasks_for(df, task_bytes), most)


def _turn(df: DataFrame) -> Column:
    """A number of each row by its values and by the task that reads it.

    So rows that are equal in some columns, or in all, or hold a map, are spread
    as well, and a task that is run again deals them alike.
    """
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)
    values = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, plain)]
    return F.hash(F.lit(0), *values).bitwiseXOR(F.spark_partition_id())


def write_table(df: DataFrame, name: str, *, fmt: str = "orc", mode: str = "overwrite", codec: str = "snappy", partition_by: list[str] | None = None, buckets: int | None = None, bucket_by: str | None = None, writers: int | None = None) -> None:
    """Writes a managed table, in full by default.

    Overwriting replaces the table: partitions that no longer occur are gone, so
    a row that moved to another partition is not there twice.  Rows of a bucketed
    table are dealt out by partition and bucket number, so that each bucket of
    a partition is one file and the buckets set how many tasks write: see
    ``buckets_for``.  Rows of a partition without buckets are dealt to at most
    ``writers`` tasks, by their values and the task that reads them (by default as
    many as the table's counted size calls for), so that no value's rows have to
    pass through one task.
    """
    partition_by = partition_by or []
    out = _dealt(df, partition_by, buckets, bucket_by, writers).write.format(fmt).mode(mode).option("compression", codec)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if buckets and bucket_by:
        out = out.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    out.saveAsTable(name)


def _dealt(df: DataFrame, partition_by: list[str], buckets: int | None, bucket_by: str | None, writers: int | None = None) -> DataFrame:
    """Rows as the tasks are to write them."""
    if buckets and bucket_by:
        if not partition_by:
            return df.repartition(buckets, bucket_by)  # by the hash that numbers buckets: one to a task
        tasks = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(tasks, *partition_by, F.pmod(F.hash(bucket_by), F.lit(buckets)))  # as the writer numbers buckets
    if not partition_by:
        return df
    salt = writers or writers_for(df)
    if salt == 1:
        return df.repartition(*partition_by)
    turn = df.withColumn("__turn", F.pmod(_turn(df), F.lit(salt)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, so that adaptive plans leave them as they are
    return turn.repartition(tasks, *partition_by, "__turn").drop("__turn")


def buckets_for(df: DataFrame, bucket_bytes: int = 256 << 20) -> int:
    """How many buckets a table needs: the power of two with at most ``bucket_bytes`` and two million rows in each, counted.

    Powers of two divide each other, so tables of different sizes still join
    bucket by bucket.
    """
    return 1 << (_tasks_for(df, bucket_bytes) - 1).bit_length()


def _table_layout(spark: SparkSession, table: str) -> tuple[list[str], int | None, str | None]:
    """Partition columns, number of buckets and the column they go by."""
    columns = spark.catalog.listColumns(table)
    said = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    bucketed = [c.name for c in columns if c.isBucket]
    return [c.name for c in columns if c.isPartition], int(said["Num Buckets"]) if bucketed else None, bucketed[0] if bucketed else None


def replace_partitions(df: DataFrame, table: str) -> None:
    """Writes the partitions that ``df`` has rows of, in place of what they held; the table's others stay as they are, files and all."""
    spark, name = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    partition_by, buckets, bucket_by = _table_layout(spark, table)
    said = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "partitionoverwritemode=static" in said.get("Storage Properties", "").lower():
        raise ValueError(f"{table} has an option by which any overwrite would empty its other partitions")
    rows = _dealt(df.select(spark.table(table).columns), partition_by, buckets, bucket_by)
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(name, before)


def drop_partition(spark: SparkSession, table: str, values: dict) -> None:
    """Drops one partition with its files."""
    terms = ", ".join(f"`{c}` = {'NULL' if v is None else repr(str(v))}" for c, v in values.items())
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({terms})")


def use_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.catalog.setCurrentDatabase(name)


def add_columns(spark: SparkSession, table: str, columns: str) -> None:
    """Adds columns at the end; earlier rows read NULL there."""
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def table_statistics(spark: SparkSession, table: str) -> dict[str, int]:
    """Rows, bytes and files of a table."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    said = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    size, rows = said["Statistics"].split(" bytes, ")
    return {"bytes": int(size), "rows": int(rows.split()[0]), "files": len(spark.table(table).inputFiles())}
