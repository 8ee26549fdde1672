"""Expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(column: Column) -> Column:
    """Empty and all-blank text is missing."""
    return F.nullif(F.trim(column), F.lit(""))


def is_blank(column: Column) -> Column:
    """Missing, empty or all blank."""
    return column.isNull() | (F.trim(column) == "")


def safe_float(column: Column) -> Column:
    """Text as FLOAT; anything that is no number is missing, and never an error."""
    return blank_to_null(column).try_cast("float")


def safe_date(column: Column) -> Column:
    """ISO text as DATE; anything else is missing."""
    return blank_to_null(column).try_cast("date")


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds; 0 on empty input."""
    return F.count_if(condition)


def rate(condition: Column, digits: int = 4) -> Column:
    """Share of rows for which the condition holds; missing on empty input."""
    return F.round(F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)


def bucket(column: Column, ranges: list[tuple[float, float, str]], otherwise: str) -> Column:
    """Label of the first closed range that holds the value; all else, missing too, is ``otherwise``."""
    out = None
    for low, high, label in ranges:
        test = column.between(low, high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


#: Closed ranges of tenure in months, labels with an en dash; 60 is in the last but one.
TENURE = [(0, 12, "0–12 months"), (13, 24, "13–24 months"), (25, 36, "25–36 months"), (37, 48, "37–48 months"), (49, 60, "49–60 months")]
TENURE_ABOVE = "60+ months"


def tenure_bucket(column: Column) -> Column:
    """Range of months; negative and missing tenure fall into the last one, as does all above 60."""
    return bucket(column, TENURE, TENURE_ABOVE)
