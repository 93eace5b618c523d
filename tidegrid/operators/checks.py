"""Quality reports as aggregates: no row leaves the executors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_merge(
    df: DataFrame, core: Sequence[str], groups: Sequence[str] = ("operator", "direction"), ts: str = "ts"
) -> DataFrame:
    """One row: nulls in core columns, duplicate keys, missing hours."""
    nulls = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in core])
    by_key = df.groupBy(*groups, ts).agg(F.count(F.lit(1)).alias("n"), nulls.alias("nulls"))
    by_group = by_key.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("nulls").alias("nulls"),
        F.min(ts).alias("lo"), F.max(ts).alias("hi"),
    )
    hours = (F.unix_seconds(F.max("hi")) - F.unix_seconds(F.min("lo"))) / 3600 + 1
    return by_group.agg(
        F.sum("nulls").alias("core_nulls"),
        F.sum(F.col("n") - F.col("k")).alias("duplicates"),
        F.greatest((hours * F.count(F.lit(1))).cast("long") - F.sum("n"), F.lit(0)).alias("missing_dates"),
    )


def completeness(
    df: DataFrame, keys: Sequence[str] = ("metric",), min_share: float = 0.99, value: str = "value", ts: str = "ts"
) -> DataFrame:
    """Share of non-null rows and of expected hours per series."""
    by_key = df.groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("v")
    )
    expected = (F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / 3600 + 1
    n = F.sum("n")
    return by_key.groupBy(*keys).agg(
        n.alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        (F.sum("v") / n).alias("completeness"),
        (n / expected).alias("coverage"),
        (n / expected >= min_share).alias("passed"),
    )


def validate_predictions(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fails at once on missing columns, at run time on null keys."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return df.where(F.assert_true(ok, F.lit("null in a required column")).isNull())
