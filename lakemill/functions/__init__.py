"""Column functions with the dialect's semantics, for use in the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(part: str, value: Column) -> Column:
    """YEAR, MONTH or DAY as BIGINT."""
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[part.lower()](value).cast("long")


def ordered(column: Column, descending: bool = False) -> Column:
    """A sort key with the dialect's null order: last ascending, first descending."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def sum_decimal(column: Column, precision: int, scale: int) -> Column:
    """SUM that keeps the argument's DECIMAL type."""
    return F.sum(column).cast(f"decimal({precision},{scale})")
