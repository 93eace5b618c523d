"""Joins with the checks the pipelines rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: Sequence[str], what: str = "feature table") -> DataFrame:
    """Same rows; the job fails when a key occurs twice.

    The check is an aggregation on the join key, so the following join reuses
    its partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest]
    )
    ok = F.assert_true(F.col("_n") == 1, F.lit(f"{what}: duplicate key"))
    return grouped.where(ok.isNull()).drop("_n")


def add_features(base: DataFrame, features: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left many-to-one join of the columns the base does not have yet."""
    new = [c for c in features.columns if c not in base.columns]
    right = features.select(*keys, *new)
    return base.join(unique_on(right, keys) if check else right, list(keys), "left")


def merge_log(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """One row: rows, new columns and the mean share of nulls in them."""
    nulls = reduce(lambda a, b: a + b, [F.avg(F.col(c).isNull().cast("int")) for c in cols])
    return df.agg(
        F.lit(name).alias("feature_set"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(cols)).alias("new_columns"),
        F.round(nulls / len(cols) * 100, 2).alias("null_pct"),
    )


def merge_wide(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of wide tables with one exchange: union, then one row per key."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[F.first(c, True).alias(c) for c in values])


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide with the column list given, so no extra job looks for it."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, True))


def to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([*keys], list(values), name, value)


def common_rows(frames: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Each long frame cut to the row keys present in all of them."""
    shared = reduce(
        lambda a, b: a.join(b, list(keys), "left_semi"),
        [f.select(*keys) for f in frames[1:]],
        frames[0].select(*keys),
    ).distinct()
    return [f.join(shared, list(keys), "left_semi") for f in frames]


def common_models(frames: Sequence[DataFrame], model: str = "model") -> list[DataFrame]:
    shared = reduce(lambda a, b: a.intersect(b), [f.select(model).distinct() for f in frames])
    return [f.join(shared, model, "left_semi") for f in frames]


def attach_to_windows(
    predictions: DataFrame, benchmarks: DataFrame, keys: Sequence[str], window: str = "window_index"
) -> DataFrame:
    """Benchmark rows repeated for every window that holds their key; a window without any fails."""
    slots = predictions.select(*keys, window).distinct()
    out = slots.join(benchmarks, list(keys), "left")
    seen = out.groupBy(window).agg(F.max(F.col("y_pred").isNotNull().cast("int")).alias("_any"))
    ok = F.assert_true(F.col("_any") == 1, F.lit("a window has no benchmark values"))
    return out.join(seen.where(ok.isNull()), window).drop("_any")


def compare_snapshots(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of both tables with the side they are on; null equals null."""
    left = a.select(*cols).withColumn("_side", F.lit(1))
    right = b.select(*cols).withColumn("_side", F.lit(2))
    both = left.unionByName(right).groupBy(*cols).agg(F.bit_or("_side").alias("_sides"))
    return both.withColumn(
        "side",
        F.when(F.col("_sides") == 3, "both").when(F.col("_sides") == 1, "left_only").otherwise("right_only"),
    ).drop("_sides")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Inner join of two sources: ``abs_diff`` and ``mismatch`` per row."""
    j = a.select(*keys, F.col("value").alias("left_value")).join(
        b.select(*keys, F.col("value").alias("right_value")), list(keys)
    )
    d = F.abs(F.col("left_value") - F.col("right_value"))
    return j.withColumn("abs_diff", d).withColumn(
        "mismatch", (d > F.lit(atol) + F.lit(rtol) * F.abs("right_value")).cast("int")
    )


def fail_on_conflict(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key; two different values under a key fail the job."""
    rest = [c for c in df.columns if c not in keys and c != value]
    g = df.groupBy(*keys).agg(
        F.min(value).alias(value), F.max(value).alias("_hi"), *[F.first(c).alias(c) for c in rest]
    )
    ok = F.assert_true(F.col(value).eqNullSafe(F.col("_hi")), F.lit("conflicting values under one key"))
    return g.where(ok.isNull()).drop("_hi")


def in_windows(
    df: DataFrame, windows: DataFrame, ts: str, lo: str, hi: str, closed: bool = False
) -> DataFrame:
    """Rows fanned out to the windows that hold them; windows may overlap.

    The range join becomes an equi-join on the month: each window lists its
    months, so a row meets only the windows of its month. Spark broadcasts the
    window table when its size allows.
    """
    upper = F.col(ts) <= F.col(hi) if closed else F.col(ts) < F.col(hi)
    months = F.sequence(F.date_trunc("month", lo), F.date_trunc("month", hi), F.expr("INTERVAL 1 MONTH"))
    listed = windows.withColumn("_month", F.explode(months))
    rows = df.withColumn("_month", F.date_trunc("month", ts))
    return rows.join(listed, "_month").where((F.col(ts) >= F.col(lo)) & upper).drop("_month")


def append_renumbered(old: DataFrame, new: DataFrame, index: str) -> DataFrame:
    """Append rows with their index continued after the old maximum."""
    top = old.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("_off"))
    moved = new.crossJoin(F.broadcast(top)).withColumn(index, F.col(index) + F.col("_off")).drop("_off")
    return old.unionByName(moved)
