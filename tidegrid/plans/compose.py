"""Datasets as selections of feature sets over one joined table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.checks import validate_merge
from tidegrid.operators.joins import add_features
from tidegrid.plans.loaders import residual_and_other


def joined(base: DataFrame, feature_sets: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Base table with every feature set, each joined once, and the derived columns."""
    out = base
    for features in feature_sets.values():
        out = add_features(out, features, [k for k in keys if k in features.columns])
    return residual_and_other(out)


def combination(
    table: DataFrame, base: DataFrame, feature_sets: dict[str, DataFrame], names: Sequence[str], derived: Sequence[str] = ()
) -> DataFrame:
    """Columns of one combination; the scan reads no other column."""
    chosen = list(base.columns)
    for n in names:
        chosen += [c for c in feature_sets[n].columns if c in table.columns and c not in chosen]
    return table.select(*chosen, *[c for c in derived if c in table.columns])


def without_families(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop the columns of activity families by prefix."""
    return df.drop(*[c for c in df.columns if any(c.startswith(p) for p in prefixes)])


def summary(table: DataFrame, names: dict[str, Sequence[str]], keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per operator and combination: rows, columns, first and last hour."""
    sizes = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(len(cols)).alias("n_columns")) for n, cols in names.items()]
    )
    per = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    return per.select(*keys, "rows", "first", "last", F.explode(sizes).alias("c")).select(
        *keys, "c.name", "c.n_columns", "rows", "first", "last"
    )


__all__ = ["combination", "joined", "summary", "validate_merge", "without_families"]
