"""Gap imputation of long hourly series, driven by a rule per metric.

All metrics run in one plan. Frames are bounded by the gap threshold and the
residual horizon, so a series is cut into chunks with a halo; the seasonal
medians of a metric travel as three small arrays (288 + 168 + 24 cells).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.chunked import (
    carry_last,
    chunk_window,
    home_rows,
    hour_index,
    join_null_safe,
    with_halo,
)

HOUR_WEEKDAY = ("hour", "weekday")
HOUR_MONTH = ("hour", "month")
HOUR = ("hour",)

_PARTS = {
    "hour": lambda ts: F.hour(ts),
    "weekday": lambda ts: F.weekday(ts),
    "month": lambda ts: F.month(ts),
    "dayofyear": lambda ts: F.dayofyear(ts),
}


@dataclass(frozen=True)
class Rule:
    """How one family of metrics is filled."""

    match: str  # regular expression on the metric name
    kind: str = "seasonal"  # seasonal | forward | zero | keep
    gap: int = 6
    tiers: Sequence[tuple[str, ...]] = field(default=(HOUR_WEEKDAY, HOUR))
    min_count: int = 1
    shrink_k: float = 0.0
    shrink_to: str = "next_tier"  # next_tier | global
    global_fallback: bool = True
    level: bool = False
    level_gap: int = 168
    night_zero: bool = False


_WIND_TIERS = (HOUR_MONTH, HOUR_WEEKDAY, HOUR)


def _actual_fuel(match: str, gap: int, min_count: int) -> Rule:
    return Rule(rf"^(?!.*forecast)(production_|generation_).*({match})", gap=gap, min_count=min_count)


# Thresholds in hours and minimum counts per family; first match wins.
RULES: tuple[Rule, ...] = (
    Rule(r"indicator", kind="keep"),
    Rule(r"^(data_driven_|runlength_|run_len_|run_)", kind="zero"),
    Rule(r"^(day_ahead_price_|price_)", gap=6),
    Rule(r"^bloomberg_", kind="forward"),
    Rule(r"^(production_forecast_|generation_forecast_|forecast_generation_)", gap=6, min_count=8),
    _actual_fuel("nuclear|lignite|brown_coal", 12, 12),
    _actual_fuel("coal|gas", 6, 12),
    _actual_fuel("hydro|water_reservoir|run-of-river|pumped_storage|oil|geothermal", 3, 8),
    _actual_fuel("", 6, 8),
    Rule(r"^consumption_forecast_", gap=6, min_count=8),
    Rule(r"^consumption_load_actual_", gap=3, min_count=8),
    Rule(r"^wind_forecast_", gap=6, tiers=_WIND_TIERS, min_count=24, shrink_k=12.0, shrink_to="global"),
    Rule(r"^wind_actual_", gap=3, tiers=_WIND_TIERS, min_count=24, shrink_k=12.0, shrink_to="global"),
    Rule(
        r"^pv_forecast_", gap=6, tiers=_WIND_TIERS, min_count=24, shrink_k=12.0,
        shrink_to="global", night_zero=True,
    ),
    Rule(
        r"^pv_actual_", gap=3, tiers=_WIND_TIERS, min_count=24, shrink_k=12.0,
        shrink_to="global", level=True, night_zero=True,
    ),
    Rule(r"^sce_forecast_", gap=3, min_count=8),
    Rule(r"^cross_border_", gap=10, min_count=8),
    Rule(r"", kind="keep"),
)

def rule_of(name: str) -> Rule:
    """The rule of a metric family, for tables that hold only that family."""
    return next(r for r in RULES if re.search(r.match, name))


# Hours without sun.
NIGHT_HOURS = (21, 22, 23, 0, 1)


def gap_position(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Adds ``gap_position``: 1, 2, … inside a run of nulls, 0 on observed rows."""
    pos = hour_index(ts)
    seen = carry_last(
        df, keys, ts, F.date_trunc("quarter", ts),
        {"_seen": F.when(F.col(value).isNotNull(), pos)},
    )
    first = df.groupBy(*keys).agg(F.min(pos).alias("_first"))
    return (
        join_null_safe(seen, first, keys)
        .withColumn(
            "gap_position",
            F.when(F.col(value).isNotNull(), 0)
            .otherwise(pos - F.coalesce(F.col("_seen"), F.col("_first") - 1))
            .cast("int"),
        )
        .drop("_seen", "_first")
    )


def seasonal_stats(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], fit: Column | None = None,
    value: str = "value", ts: str = "ts",
) -> DataFrame:
    """Median and count of the fitted rows by calendar parts.

    A cell holds at most one value per series and hour of the calendar, so the
    exact percentile works on a bounded group.
    """
    parts = [(_PARTS[g](ts) if g in _PARTS else F.col(g)).alias(g) for g in groups]
    v = F.col(value) if fit is None else F.when(fit, F.col(value))
    return df.groupBy(*keys, *parts).agg(
        F.percentile(v, F.lit(0.5)).alias("median"), F.count(v).alias("n")
    )


def seasonal_fill(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], fit: Column | None = None,
    value: str = "value", ts: str = "ts",
) -> DataFrame:
    """Adds ``seasonal_median`` and ``seasonal_count`` of the row's calendar cell."""
    stats = seasonal_stats(df, keys, groups, fit, value, ts)
    part = {f"_p_{g}": (_PARTS[g](ts) if g in _PARTS else F.col(g)) for g in groups}
    stats = stats.select(
        *keys, *[F.col(g).alias(f"_p_{g}") for g in groups],
        F.col("median").alias("seasonal_median"), F.col("n").alias("seasonal_count"),
    )
    return join_null_safe(df.withColumns(part), stats, [*keys, *part], "left").drop(*part)


def _medians(index: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Median (NaN without values) and number of values for each index from 0 to ``size`` - 1."""
    counts = np.bincount(index, minlength=size)
    ordered = np.append(value[np.lexsort((value, index))], np.nan)
    first = np.cumsum(counts) - counts
    low, high = (np.where(counts > 0, first + at, len(value)) for at in ((counts - 1) // 2, counts // 2))
    return 0.5 * ordered[low] + 0.5 * ordered[high], counts


def _cells(
    df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], fit: Column | None, value: str, ts: str, metric: str
) -> DataFrame:
    """One row per series: its rule, arrays of (median, n) by hour×month, hour×weekday, hour, the global median.

    A task sorts one series' values once for each tier; a series is an hourly grid, so the calendar bounds it. A series without any fitted
    value falls back to the median of all its values. Name patterns are matched once per series here, not once per row.
    """
    ks = list(keys)
    rows = df.select(
        *ks, F.col(value).cast("double").alias("_v"), (F.lit(True) if fit is None else F.coalesce(fit, F.lit(False))).alias("_fit"),
        F.col(metric).cast("string").alias("_series_name"), F.hour(ts).alias("_hour"), F.weekday(ts).alias("_weekday"), F.month(ts).alias("_month"),
    )
    cell = pa.struct([("med", pa.float64()), ("n", pa.int64())])
    limited = fit is not None

    def run(group: pa.Table) -> pa.Table:
        every = group["_v"].to_numpy().astype(float)
        kept = ~np.isnan(every) & group["_fit"].to_numpy()
        value = every[kept]
        hour, weekday, month = (group[c].to_numpy()[kept].astype(int) for c in ("_hour", "_weekday", "_month"))
        out = {k: group[k].slice(0, 1) for k in ks}
        out["_name"] = pa.array([max((n for n in group["_series_name"].unique().to_pylist() if n is not None), default=None)], pa.string())
        for name, index, size in (("_hm", hour * 12 + month - 1, 288), ("_hw", hour * 7 + weekday, 168), ("_h", hour, 24)):
            med, n = _medians(index, value, size)
            cells = pa.StructArray.from_arrays([pa.array(med, from_pandas=True), pa.array(n, pa.int64())], fields=list(cell))
            out[name] = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), cells)
        known = every[~np.isnan(every)]
        overall = np.median(value) if len(value) else np.median(known) if limited and len(known) else None
        out["_global"] = pa.array([overall], pa.float64())
        return pa.table(out)

    fields = [f for k in ks for f in df.schema.fields if f.name == k]
    cells = T.ArrayType(T.StructType([T.StructField("med", T.DoubleType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([
        *fields, T.StructField("_name", T.StringType()), *[T.StructField(c, cells) for c in ("_hm", "_hw", "_h")], T.StructField("_global", T.DoubleType()),
    ])
    return rows.groupBy(*ks).applyInArrow(run, schema).withColumn("_rule", _rule_index(rules, "_name")).drop("_name")


def tiered_fill(
    df: DataFrame,
    keys: Sequence[str],
    rules: Sequence[Rule],
    fit: Column | None = None,
    value: str = "value",
    ts: str = "ts",
    metric: str = "metric",
) -> DataFrame:
    """Adds ``fill``: first tier with enough values, else first with any, shrunk, else global."""
    return _tiered(df, keys, rules, fit, value, ts, metric).drop("_r")


def _tiered(
    df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], fit: Column | None, value: str, ts: str, metric: str
) -> DataFrame:
    """Adds ``fill`` and the attributes of the series' rule as ``_r``.

    One formula serves every rule: its parameters are columns of the one-row-per-series table.
    """
    cells = _cells(df, keys, rules, fit, value, ts, metric).withColumn("_r", F.get(_rule_table(rules), "_rule"))
    joined = join_null_safe(df, cells.drop("_rule"), keys, "left")
    joined = joined.withColumns(
        {
            "_t1": F.when(F.col("_r.hm"), F.get("_hm", F.hour(ts) * 12 + F.month(ts) - 1)),
            "_t2": F.when(F.col("_r.hw"), F.get("_hw", F.hour(ts) * 7 + F.weekday(ts))),
            "_t3": F.when(F.col("_r.h"), F.get("_h", F.hour(ts))),
        }
    )
    tiers = ("_t1", "_t2", "_t3")
    tier = F.lit(0)
    for least in (F.lit(1), F.col("_r.min_count")):
        for i in (3, 2, 1):
            has = F.col(f"_t{i}.med").isNotNull() & (F.col(f"_t{i}.n") >= least)
            tier = F.when(has, F.lit(i)).otherwise(tier)
    joined = joined.withColumn("_tier", tier)

    def of(field: str) -> Column:
        out = F.when(F.col("_tier") == 1, F.col(f"{tiers[0]}.{field}"))
        for i in (2, 3):
            out = out.when(F.col("_tier") == i, F.col(f"_t{i}.{field}"))
        return out

    coarser = (
        F.when(F.col("_r.to_global"), F.col("_global"))
        .when(F.col("_tier") == 1, F.coalesce("_t2.med", "_t3.med", "_global"))
        .when(F.col("_tier") == 2, F.coalesce("_t3.med", "_global"))
        .otherwise(F.col("_global"))
    )
    joined = joined.withColumns({"_med": of("med"), "_cnt": of("n"), "_parent": coarser})
    weight = F.col("_cnt") / (F.col("_cnt") + F.col("_r.shrink_k"))
    shrunk = F.when(
        (F.col("_r.shrink_k") > 0) & F.col("_parent").isNotNull(),
        weight * F.col("_med") + (F.lit(1.0) - weight) * F.col("_parent"),
    ).otherwise(F.col("_med"))
    fill = F.coalesce(shrunk, F.when(F.col("_r.fallback"), F.col("_global")))
    return joined.withColumn("fill", F.when(F.col("_r.kind") == "seasonal", fill)).drop(
        "_hm", "_hw", "_h", "_global", "_t1", "_t2", "_t3", "_tier", "_med", "_cnt", "_parent"
    )


def _rule_table(rules: Sequence[Rule]) -> Column:
    """Rule attributes as an array of structs."""
    order = [HOUR_MONTH, HOUR_WEEKDAY, HOUR]

    def one(r: Rule) -> Column:
        tiers = [tuple(t) for t in r.tiers]
        if tiers != [t for t in order if t in tiers]:
            raise ValueError("tiers are a selection of hour×month, hour×weekday, hour in this order")
        fields = {
            "kind": r.kind, "gap": r.gap, "hm": HOUR_MONTH in tiers, "hw": HOUR_WEEKDAY in tiers, "h": HOUR in tiers,
            "min_count": max(r.min_count, 1), "shrink_k": float(r.shrink_k), "to_global": r.shrink_to == "global",
            "fallback": r.global_fallback, "level": r.level, "level_gap": r.level_gap, "night": r.night_zero,
        }
        return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])

    return F.array(*[one(r) for r in rules])


def _rule_index(rules: Sequence[Rule], metric: str) -> Column:
    """Position of the first rule that matches the metric name."""
    out = F.lit(len(rules) - 1)
    for i, r in reversed(list(enumerate(rules))):
        hit = F.lower(metric).rlike(r.match) if r.match else F.lit(True)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def impute(
    df: DataFrame,
    rules: Sequence[Rule] = RULES,
    fit: Column | None = None,
    keys: Sequence[str] = ("metric",),
    metric: str = "metric",
    value: str = "value",
    ts: str = "ts",
) -> DataFrame:
    """Adds ``imputed``. The input must be a complete hourly grid per series."""
    seasonal = [r for r in rules if r.kind == "seasonal"]
    reach = max([r.gap for r in seasonal], default=0) + 1
    back = max([reach] + [r.level_gap for r in seasonal if r.level])
    filled = _tiered(df, keys, rules, fit, value, ts, metric)
    rows = with_halo(filled, hour_index(ts), before=back, after=reach)
    w = chunk_window(keys)
    # everything back to the chunk start: at least ``back`` rows, in one running pass
    ahead, behind = w.rowsBetween(0, reach), w.rowsBetween(Window.unboundedPreceding, 0)
    observed = F.col(value).isNotNull()
    seen = F.last(F.when(observed, F.col("_pos")), True).over(behind)
    prev_pos = F.coalesce(seen, F.first("_pos").over(behind) - 1)
    next_pos = F.coalesce(F.min(F.when(observed, F.col("_pos"))).over(ahead), F.max("_pos").over(ahead) + 1)
    rows = rows.withColumns(
        {
            "_gap": next_pos - prev_pos - 1,
            "_near": F.last(value, True).over(behind),
            "_since": F.col("_pos") - seen,
            "_res": F.last(F.col(value) - F.col("fill"), True).over(behind),
        }
    )
    rows = home_rows(rows)

    decay = F.greatest(1 - F.col("_since") / F.col("_r.level_gap"), F.lit(0.0))
    long_fill = F.col("fill") + F.when(
        F.col("_r.level"), F.coalesce(F.col("_res") * decay, F.lit(0.0))
    ).otherwise(F.lit(0.0))
    kind = F.col("_r.kind")
    out = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(kind == "seasonal", F.coalesce(F.when(F.col("_gap") <= F.col("_r.gap"), F.col("_near")), long_fill))
        .when(kind == "zero", F.lit(0.0))
    )
    dark = F.col("_r.night") & F.hour(ts).isin(*NIGHT_HOURS)
    rows = rows.withColumn("imputed", F.when(dark, F.lit(0.0)).otherwise(out))
    if any(r.kind == "forward" for r in rules):
        rows = carry_last(rows, keys, ts, F.date_trunc("quarter", ts), {"_carried": F.col(value)}, source=df).withColumn(
            "imputed", F.when(kind == "forward", F.col("_carried")).otherwise(F.col("imputed"))
        ).drop("_carried")
    return rows.drop("fill", "_r", "_gap", "_near", "_res", "_since")


def level_adjusted(
    df: DataFrame, keys: Sequence[str], max_gap: int | None = None,
    value: str = "value", fill: str = "fill", ts: str = "ts",
) -> DataFrame:
    """Adds ``adjusted``: seasonal value plus the last residual, faded out over ``max_gap`` rows."""
    rows = gap_position(df, keys, value, ts)
    rows = carry_last(
        rows, keys, ts, F.date_trunc("quarter", ts), {"_res": F.col(value) - F.col(fill)}
    )
    res = F.coalesce(F.col("_res"), F.lit(0.0))
    if max_gap is not None:
        fade = F.greatest(1 - F.col("gap_position") / F.lit(max_gap), F.lit(0.0))
        res = res * F.when(F.col(value).isNull(), fade).otherwise(F.lit(1.0))
    return rows.withColumn("adjusted", F.col(fill) + res).drop("_res", "gap_position")


def forward_fill(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    return carry_last(df, keys, ts, F.date_trunc("quarter", ts), {"imputed": F.col(value)})


def zero_fill(df: DataFrame, cols: Sequence[str], skip: str = "indicator") -> DataFrame:
    return df.fillna(0, [c for c in cols if skip not in c.lower()])


def night_zero(df: DataFrame, value: str = "value", ts: str = "ts", hours: Sequence[int] = NIGHT_HOURS) -> DataFrame:
    """Observed values of dark hours are overwritten too."""
    return df.withColumn(value, F.when(F.hour(ts).isin(*hours), F.lit(0.0)).otherwise(F.col(value)))


def imputation_stats(df: DataFrame, keys: Sequence[str] = ("metric",), before: str = "value", after: str = "imputed") -> DataFrame:
    b = F.sum(F.col(before).isNull().cast("long"))
    a = F.sum(F.col(after).isNull().cast("long"))
    return df.groupBy(*keys).agg(
        b.alias("missing_before"),
        a.alias("missing_after"),
        (b - a).alias("imputed_count"),
        ((b - a) / F.count(F.lit(1)) * 100).alias("imputed_pct"),
    )


def require_complete(df: DataFrame, value: str = "imputed", metric: str = "metric") -> DataFrame:
    """Fails the job on the first null."""
    ok = F.assert_true(F.col(value).isNotNull(), F.concat(F.lit("missing values in "), F.col(metric)))
    return df.where(ok.isNull())
