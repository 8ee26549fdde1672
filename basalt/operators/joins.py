"""Joins whose small side is broadcast only after its size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their values, up to which a dimension is sent to every executor.
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20


def _value_bytes(df: DataFrame):
    """Bytes of a row's values as text, 16 more a column, for what holds them."""
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0)).cast("long")


def measured(df: DataFrame, most: int = SMALL_ROWS) -> tuple[int, int]:
    """Rows and bytes of a table, of ``most`` + 1 rows at most."""
    return tuple(df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_value_bytes(df)), F.lit(0))).first())


def is_hinted(df: DataFrame) -> bool:
    """Whether a table, or one that it takes columns of, has a broadcast hint: its size is known then."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "ResolvedHint" and "broadcast" in node.toString().split("\n")[0]


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """The table with a broadcast hint if it has at most ``most`` rows and ``most_bytes`` bytes, else as it is.

    Counting stops beyond ``most`` rows, and is left out for a table whose size
    was known when it was made; larger tables join by shuffling, where adaptive
    execution splits hot keys.
    """
    if is_hinted(df):
        return F.broadcast(df)
    rows, size = measured(df, most)
    return F.broadcast(df) if rows <= most and size <= most_bytes else df
