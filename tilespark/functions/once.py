"""Keep an expensive column from being evaluated twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters use without repeating its expression.

    A filter is pushed below the projection it tests, taking a copy of the expression along; it is
    not pushed below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def once_unless(df: DataFrame, name: str, value: Column, dropped) -> DataFrame:
    """Like :func:`once`, dropping the rows whose value equals ``dropped``."""
    return df.withColumn(name, F.explode(F.array_remove(F.array(value), dropped)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated a single time, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
