"""Lag, rolling and selection operators over long series (keys, ts, value)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.chunked import (
    CHUNK,
    HOME,
    POS,
    carry_last,
    chunk_window,
    day_index,
    home_rows,
    hour_index,
    row_position,
    with_halo,
)


def rolling_same_hour(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    days: int = 7,
    backfill: bool = True,
    spread: bool = False,
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Mean of the same hour on the previous ``days`` days, today left out.

    Needs a complete hourly grid. ``spread`` adds the standard deviation and
    the mean absolute value. ``backfill`` copies the first result into the
    warm-up, which looks ahead; switch it off for leakage-free features.
    """
    ks = [*keys, "_hour"]
    least = max(1, days // 2)
    rows = with_halo(df.withColumn("_hour", F.hour(ts)), day_index(ts), before=days, size=1024)
    w = chunk_window(ks).rowsBetween(-days, -1)
    enough = F.count(value).over(w) >= least
    cols = {f"rollingmean_{days}d": F.avg(value).over(w)}
    if spread:
        cols[f"rollingstd_{days}d"] = F.stddev_samp(value).over(w)
        cols[f"rolling_absdev_{days}d"] = F.avg(F.abs(value)).over(w)
    rows = rows.select("*", *[F.when(enough, c).alias(n) for n, c in cols.items()])
    out = home_rows(rows)
    if backfill:
        out = _back_filled(out, ks, list(cols), ts)
    return out.drop("_hour")


def lags(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    hours: Sequence[int] = (1,),
    backfill: bool = True,
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Value n rows ago on a complete hourly grid."""
    rows = with_halo(df, hour_index(ts), before=max(hours))
    w = chunk_window(keys)
    names = [f"lag_{n}h" for n in hours]
    rows = rows.select("*", *[F.lag(value, n).over(w).alias(a) for n, a in zip(hours, names)])
    out = home_rows(rows)
    return _back_filled(out, keys, names, ts) if backfill else out


def _back_filled(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str) -> DataFrame:
    out = carry_last(
        df, keys, ts, F.date_trunc("quarter", ts), {f"_n_{c}": F.col(c) for c in cols}, following=True
    )
    for c in cols:
        out = out.withColumn(c, F.col(f"_n_{c}"))
    return out.drop(*[f"_n_{c}" for c in cols])


def lag_and_rolling(
    df: DataFrame, keys: Sequence[str] = ("metric",), days: int = 7, hours: Sequence[int] = (1,),
    backfill: bool = True, value: str = "value", ts: str = "ts",
) -> DataFrame:
    rolled = rolling_same_hour(df, keys, days, backfill, False, value, ts)
    return lags(rolled, keys, hours, backfill, value, ts)


def nonzero_runs(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Adds ``run_start``: 1 where a run of non-zero values begins."""
    rows = with_halo(df, hour_index(ts), before=1)
    on = F.coalesce(F.col(value) != 0, F.lit(False))
    before = F.coalesce(F.lag(on).over(chunk_window(keys)), F.lit(False))
    return home_rows(rows.withColumn("run_start", (on & ~before).cast("int")))


def column_activity(df: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value", ts: str = "ts") -> DataFrame:
    """Share of non-zero rows, spread of the non-zero values, number of non-zero runs."""
    nz = F.when(F.col(value) != 0, F.col(value))
    return nonzero_runs(df, keys, value, ts).groupBy(*keys).agg(
        F.avg(F.when(F.col(value).isNotNull(), (F.col(value) != 0).cast("int"))).alias("activity"),
        F.stddev_samp(nz).alias("magnitude"),
        F.sum("run_start").alias("runs"),
    )


def select_active(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    activity: float = 0.3,
    magnitude: float = 100.0,
    runs: int = 1,
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Rows of the series that are active, varied and spread enough."""
    kept = column_activity(df, keys, value, ts).where(
        (F.col("activity") >= activity) & (F.col("magnitude") >= magnitude) & (F.col("runs") >= runs)
    )
    return df.join(kept.select(*keys), list(keys), "left_semi")


def drop_sparse(
    df: DataFrame,
    keys: Sequence[str] = ("metric",),
    max_missing: float = 0.70,
    keep: Column | None = None,
    value: str = "value",
) -> DataFrame:
    """Drop series with more than ``max_missing`` nulls unless ``keep`` holds."""
    share = df.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("int")).alias("_missing"))
    ok = F.col("_missing") <= max_missing
    return df.join(share.where(ok if keep is None else ok | keep).select(*keys), list(keys), "left_semi")


def row_difference(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: str = "value", n: int = 1
) -> DataFrame:
    """Adds ``change``: value minus the value n rows before, whatever the time between."""
    rows = row_position(df, keys, [order], bucket)
    rows = with_halo(rows, F.col(POS), before=n)
    w = chunk_window(keys)
    return home_rows(rows.withColumn("change", F.col(value) - F.lag(value, n).over(w)))


def _sliding(at: np.ndarray, value: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and median of the known values with ``at`` in (t - span, t] for every t of ``at``, which ascends.

    One sorted run holds the window: a value is inserted when it comes and removed when it expires. Means are differences of
    running sums in extended precision.
    """
    known = ~np.isnan(value)
    ends, starts = np.searchsorted(at, at, side="right"), np.searchsorted(at, at - span, side="right")
    sums = np.concatenate([[0], np.cumsum(np.where(known, value, 0.0).astype(np.longdouble))])
    counts = np.concatenate([[0], np.cumsum(known)])
    n = counts[ends] - counts[starts]
    mean = np.where(n > 0, (sums[ends] - sums[starts]) / np.maximum(n, 1), np.nan).astype(float)
    median = np.full(len(at), np.nan)
    run: list[float] = []
    lo = hi = 0
    inside, values = known.tolist(), value.tolist()
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        while hi < end:
            if inside[hi]:
                insort(run, values[hi])
            hi += 1
        while lo < start:
            if inside[lo]:
                del run[bisect_left(run, values[lo])]
            lo += 1
        if run:
            half = len(run) // 2
            median[i] = run[half] if len(run) % 2 else run[half - 1] + (run[half] - run[half - 1]) * 0.5
    return mean, median


def rolling_time(
    df: DataFrame, keys: Sequence[str], days: int = 7, value: str = "value", ts: str = "ts"
) -> DataFrame:
    """Mean and median over the last ``days`` days, open on the left; nulls don't count.

    A task holds one series and chunk with the rows before it that the first windows reach.
    """
    span = days * 24
    rows = with_halo(df, hour_index(ts), before=span).withColumns({"_micros": F.unix_micros(ts), "_v": F.col(value).cast("double")})
    columns = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_micros")
        mean, median = _sliding(group["_micros"].to_numpy(), group["_v"].to_numpy().astype(float), span * 3_600_000_000)
        out = group.select(columns)
        for name, new in (("rolling_mean", mean), ("rolling_median", median)):
            out = out.append_column(name, pa.array(new, from_pandas=True))
        return out.filter(group[HOME])

    more = [T.StructField(c, T.DoubleType()) for c in ("rolling_mean", "rolling_median")]
    return rows.groupBy(*keys, CHUNK).applyInArrow(run, T.StructType([*df.schema.fields, *more]))


def naive_forecast(
    df: DataFrame, keys: Sequence[str], horizon: int = 24, y: str = "y", ts: str = "ds"
) -> DataFrame:
    """Value ``horizon`` rows ago on the complete grid."""
    rows = with_halo(df, hour_index(ts), before=horizon)
    return home_rows(rows.withColumn("naive", F.lag(y, horizon).over(chunk_window(keys))))


def kind_of_covariate(name: Column) -> Column:
    return F.when(name.contains("forecast") | name.startswith("day_ahead_price"), "future").otherwise(
        "historical"
    )


# Efficiencies, emission factors, coal tonnes to MWh.
GAS_EFFICIENCY, COAL_EFFICIENCY = 0.55, 0.40
GAS_EMISSIONS, COAL_EMISSIONS = 0.35, 0.95
COAL_TONNE_TO_MWH = 3.6 / 25.12


def spark_spread(power: Column, gas: Column, carbon: Column) -> Column:
    return power - gas / F.lit(GAS_EFFICIENCY) - carbon * F.lit(GAS_EMISSIONS) / F.lit(GAS_EFFICIENCY)


def dark_spread(power: Column, coal: Column, carbon: Column) -> Column:
    return (
        power
        - coal * F.lit(COAL_TONNE_TO_MWH) / F.lit(COAL_EFFICIENCY)
        - carbon * F.lit(COAL_EMISSIONS) / F.lit(COAL_EFFICIENCY)
    )


def net_flow(df: DataFrame, keys: Sequence[str], home: str, one_sided: bool = False) -> DataFrame:
    """Export minus import of ``home`` with each neighbour, from (from_area, to_area, value) rows.

    Both directions meet in one aggregation. A neighbour with only one
    direction in the whole table is null, or that side if ``one_sided``.
    """
    out_side = F.col("from_area") == home
    rows = df.where(out_side | (F.col("to_area") == home)).withColumn(
        "neighbour", F.when(out_side, F.col("to_area")).otherwise(F.col("from_area"))
    )
    cells = rows.groupBy("neighbour", *keys).agg(
        F.sum(F.when(out_side, F.col("value"))).alias("export"),
        F.sum(F.when(~out_side, F.col("value"))).alias("import"),
    )
    if not one_sided:
        return cells.withColumn("net", F.col("export") - F.col("import"))
    present = rows.groupBy("neighbour").agg(
        F.max(out_side.cast("int")).alias("_x"), F.min(out_side.cast("int")).alias("_n")
    )
    net = (
        F.when((F.col("_x") == 1) & (F.col("_n") == 0), F.col("export") - F.col("import"))
        .when(F.col("_x") == 1, F.col("export"))
        .otherwise(-F.col("import"))
    )
    return cells.join(present, "neighbour").withColumn("net", net).drop("_x", "_n")


def residual_load(load: Column, wind: Column | None = None, solar: Column | None = None) -> Column:
    """Load minus the renewable forecasts that exist; a null term makes a null."""
    for term in (wind, solar):
        if term is not None:
            load = load - term
    return load


def sum_skip_null(*cols: Column) -> Column:
    """Row sum where nulls count 0, all nulls give 0."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def group_sums(df: DataFrame, keys: Sequence[str], group: Column, value: str = "value") -> DataFrame:
    """Sum by group with nulls as 0; rows without a group are left out."""
    return (
        df.withColumn("group", group)
        .where(F.col("group").isNotNull())
        .groupBy(*keys, "group")
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias(value))
    )
