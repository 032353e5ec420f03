"""A name for an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once and written once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def some(value: Column) -> Column:
    """The text, or null for an empty one; the value is worked out once, which nullif does not promise inside conditions and lambdas."""
    return let(value, lambda v: F.when(v != "", v))


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often later selects use them or parts of them: an expression of
    a plain column is copied into each of its uses when projections are merged, the one row of a generator is not."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
