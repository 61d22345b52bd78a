"""Checks that fail a query instead of letting bad rows through.

A check lives in the value that a plan goes on with, for Catalyst drops
columns that nobody reads along with the errors they would raise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensured(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds; the query fails with message where it doesn't or is null."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def finite(value: Column, message: str = "scores must be finite") -> Column:
    """value as a double; null, NaN and infinities fail, for NaN would sort above every score."""
    number = value.cast("double")
    return ensured(number, ~F.isnan(number) & (F.abs(number) < float("inf")), message)


def positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be greater than zero")
    return value


def non_negative(name: str, value: int) -> int:
    if value < 0:
        raise ValueError(f"{name} must be non-negative")
    return value


def unique(name: str, values: Iterable[str]) -> list[str]:
    values = list(values)
    if len(values) != len(set(values)):
        raise ValueError(f"{name} values must be unique")
    return values


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, times): keys that occur more than once, which a table of unique rows hasn't."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def contiguity(manifest: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row (rows, lowest, highest, distinct_ordinals, contiguous): whether the ordinals are 0 to n - 1, each once."""
    o = F.col(ordinal)
    found = manifest.agg(F.count("*").alias("rows"), F.min(o).alias("lowest"), F.max(o).alias("highest"), F.count_distinct(o).alias("distinct_ordinals"))
    whole = (F.col("lowest") == 0) & (F.col("highest") == F.col("rows") - 1) & (F.col("distinct_ordinals") == F.col("rows"))
    return found.withColumn("contiguous", (F.col("rows") == 0) | F.coalesce(whole, F.lit(False)))


def require_contiguous(manifest: DataFrame) -> int:
    """The number of rows; fails unless their ordinals are contiguous from zero."""
    row = contiguity(manifest).first()
    if not row.contiguous:
        raise ValueError("manifest ordinals must be contiguous from zero")
    return row.rows


#: How far from one a vector's length may be.
UNIT = 1.1e-5


def norms(rows: DataFrame, tolerance: float = UNIT, vector: str = "embedding") -> DataFrame:
    """rows with ``norm`` (double) and ``unit``, whether it is 1 within tolerance."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("norm", length).withColumn("unit", F.abs(F.col("norm") - 1) <= tolerance)


def all_finite(vector: str) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
