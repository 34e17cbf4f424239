"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def is_label(name: str) -> Column:
    return F.col("label") == name


def count_label(name: str) -> Column:
    return F.count_if(is_label(name))


def label_score() -> Column:
    """Mean of +1, -1 and 0; a missing label counts as 0."""
    return F.avg(F.when(is_label("positive"), 1.0).when(is_label("negative"), -1.0).otherwise(0.0))


def engagement() -> Column:
    return F.coalesce("likes", F.lit(0)) + F.coalesce("comments", F.lit(0)) + F.coalesce("shares", F.lit(0))


def day(column: str = "published_at") -> Column:
    return F.to_date(column)


def has(array: str, value: str) -> Column:
    """Whether an array holds a value; false for a null array and for one with nulls."""
    return F.coalesce(F.array_contains(array, value), F.lit(False))
