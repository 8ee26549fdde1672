"""Sources: delimited text, ORC, Parquet, JDBC increments, Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt import schemas


def read_text(spark: SparkSession, path: str, schema: str, *, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Delimited text with a declared schema; a value of the wrong type is missing, never an error.

    The header is an option, for a header line that is read as data would be a row.
    """
    return spark.read.schema(schema).options(header=header, sep=delimiter, mode="PERMISSIVE", enforceSchema=True).csv(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc_increment(spark: SparkSession, url: str, table: str, cursor_column: str, cursor: str | None, *, inclusive: bool = False, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """Rows of a database table beyond a cursor; the comparison runs in the database.

    With a partition column and its bounds the table is read in parallel.  The
    JDBC driver and credentials come from the caller's options.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    df = reader.load()
    return df if cursor is None else beyond_cursor(df, cursor_column, cursor, inclusive=inclusive)


def beyond_cursor(df: DataFrame, column: str, cursor, *, inclusive: bool = False) -> DataFrame:
    """Rows after the cursor (or at it, too); the filter is pushed to the scan."""
    value = F.lit(cursor).cast(df.schema[column].dataType)
    return df.where(F.col(column) >= value if inclusive else F.col(column) > value)


def next_cursor(df: DataFrame, column: str):
    """The highest value, to start the next increment from; None if there is no new row."""
    return df.agg(F.max(column)).first()[0]


def read_kafka(spark: SparkSession, servers: str, topic: str, *, streaming: bool = True, most_per_batch: int | None = None, binary: bool = False, **options: str) -> DataFrame:
    """Key, value and place of a topic's messages, values as text unless ``binary``; needs Spark's Kafka package on the class path.

    A task reads a partition, so consumers are as many as partitions and cores
    allow.  ``most_per_batch`` bounds what a stream takes on at once.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if streaming and most_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", str(most_per_batch))
    value = "value" if binary else "CAST(value AS STRING) AS value"
    return reader.options(**options).load().selectExpr("CAST(key AS STRING) AS key", value, "topic", "partition", "offset", "timestamp")


#: Joins of bucketed tables: a bucket that is one sorted file needs no sort; tables with more buckets join by merging them.
BUCKET_SETTINGS = {
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
    "spark.sql.bucketing.coalesceBucketsInJoin.maxBucketRatio": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def bucketed_session(spark: SparkSession) -> SparkSession:
    """A session over the same catalog in which bucketed tables join bucket by bucket.

    Spark then lists the files of a bucketed table when it plans: where each
    bucket is one file (``write_table`` sees to it), it trusts the order in which
    the file was written.  The caller's session keeps its settings.
    """
    session = spark.newSession()
    for name, value in BUCKET_SETTINGS.items():
        session.conf.set(name, value)
    return session


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """One date per row, written month/day/year without padding."""
    return read_text(spark, path, schemas.CALENDAR).select(F.to_date("Date", "M/d/yyyy").alias("Date"))


def read_product_hierarchy(spark: SparkSession, subcategories: str, categories: str) -> DataFrame:
    """Subcategories with the names of their categories, a few dozen rows of reference data."""
    sub = read_text(spark, subcategories, schemas.SUBCATEGORIES)
    return sub.join(read_text(spark, categories, schemas.CATEGORIES), "ProductCategoryKey", "left")


def read_territories(spark: SparkSession, path: str) -> DataFrame:
    return read_text(spark, path, schemas.TERRITORIES)
