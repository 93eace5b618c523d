"""From interventions to the target dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.lookups import OPERATORS, STATE_OPERATOR, split_method
from tidegrid.operators.chunked import chunk_window, home_rows, hour_index, with_halo
from tidegrid.operators.densify import complete_grid, fixed_bounds
from tidegrid.operators.intervals import hourly_activity, split_hourly, with_rows


def until_last_full_month(df: DataFrame, start: Column | None = None) -> DataFrame:
    """Rows that end before the day after the last month end present in the data."""
    last = df.where("to_date(begin_date) = last_day(begin_date)").agg(
        F.max(F.to_date("begin_date")).alias("_last")
    )
    out = df.crossJoin(F.broadcast(last)).where(
        F.col("end_date") < F.date_add("_last", 1).cast("timestamp")
    )
    if start is not None:
        out = out.where(F.col("begin_date") >= start)
    return out.drop("_last")


def within_dates(df: DataFrame, start: Column | None, end: Column) -> DataFrame:
    out = df.where(F.col("end_date") < end)
    return out if start is None else out.where(F.col("begin_date") >= start)


def with_load_and_unit(df: DataFrame) -> DataFrame:
    """A null load stays, a zero load goes; the unit must be known."""
    return df.where("(total_load IS NULL OR total_load <> 0) AND affected_unit IS NOT NULL")


def split_requesters(df: DataFrame, col: str = "requesting_operator") -> DataFrame:
    return df.withColumn(col, F.split(col, "\\s*&\\s*"))


def domestic_only(
    df: DataFrame, carrier: str, unit: str, state: str, countertrade: bool = True
) -> DataFrame:
    """Domestic interventions; a null carrier, unit or state is kept."""
    blocked = ["Vorarlberger Ilwerke"] + ([] if countertrade else ["Börse", "B¿rse"])
    return df.where(
        ~F.col(carrier).eqNullSafe("outside_germany")
        & ~F.coalesce(F.col(unit).isin(blocked), F.lit(False))
        & (F.col(state).isNull() | F.col(state).isin(list(STATE_OPERATOR)))
        & F.col("primary_energy_type").isNotNull()
    )


def relevant_interventions(
    df: DataFrame,
    reasons: Sequence[str],
    min_gap_ratio: float = -0.1,
    operators: Sequence[str] = tuple(OPERATORS),
) -> DataFrame:
    """Reason in class, active time not longer than the event by the given ratio.

    A zero mean load gives an infinite active time: dropped for positive energy,
    kept for negative or zero energy.
    """
    gap = (
        "1 - try_divide(total_load, nullif(mean_load, 0D)) / "
        "((unix_micros(end_date) - unix_micros(begin_date)) / 3600000000D)"
    )
    known = F.when(
        F.col("operator").contains("&"), F.raise_error(F.lit("more than one directing operator")).cast("boolean")
    ).otherwise(F.col("operator").isin(list(operators)))
    return (
        df.where(F.col("reason").isin(list(reasons)))
        .where(F.expr(f"NOT coalesce({gap} < {min_gap_ratio}D, false)"))
        .where("NOT coalesce(mean_load = 0 AND total_load > 0, false)")
        .where(known & F.col("primary_energy_type").isNotNull())
    )


def dense_exposure(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    return complete_grid(
        df, keys, fixed_bounds(df, keys, lo, hi), {"union_exposure": 0.0}
    )


def run_features(
    df: DataFrame,
    keys: Sequence[str],
    window: int = 24,
    state: str = "exposure",
    y: str = "total_load",
    y_eps: float = 0.0,
    exposure_eps: float = 1e-12,
    ts: str = "ts",
) -> DataFrame:
    """Indicator of this hour, hours since activity and switches of the past hours.

    Run lengths are capped at ``window``, so every frame is bounded and the
    series can be cut into chunks. Needs a complete hourly grid.
    """
    by_y = F.col(y) > y_eps if y in df.columns else F.lit(False)
    by_exposure = F.col("union_exposure") > exposure_eps
    indicator = {"y": by_y, "exposure": by_exposure, "either": by_y | by_exposure}[state]
    rows = with_halo(df, hour_index(ts), before=window + 2)
    w = chunk_window(keys)
    frame = w.rowsBetween(-(window - 1), 0)
    rows = (
        rows.withColumn("runlength_indicator", F.coalesce(indicator, F.lit(False)).cast("int"))
        .withColumn("_s", F.coalesce(F.lag("runlength_indicator").over(w), F.lit(0)))
        .withColumn("_sw", F.coalesce(F.abs(F.col("_s") - F.lag("_s").over(w)), F.lit(0)))
        .withColumn("_hit", F.max(F.when(F.col("_s") == 1, F.col("_pos"))).over(frame))
        .withColumn("_first", F.min("_pos").over(frame))
        .withColumn(
            "runlength_zero",
            F.when(F.col("_s") == 1, 0)
            .otherwise(F.col("_pos") - F.coalesce(F.col("_hit"), F.col("_first") - 1))
            .cast("int"),
        )
        .withColumn("runlength_switches", F.sum("_sw").over(frame).cast("int"))
    )
    return home_rows(rows).drop("_s", "_sw", "_hit", "_first")


def target_dataset(
    df: DataFrame,
    reasons: Sequence[str],
    lo: Column,
    hi: Column,
    min_gap_ratio: float = -0.1,
    eps: float = 0.3,
    keys: Sequence[str] = ("operator", "direction"),
) -> DataFrame:
    """Dense hourly target with activity and run features per series.

    One exchange builds every hourly aggregate, one more places the rows of a
    series chunk together for the run features.
    """
    keys = list(keys)
    events = relevant_interventions(df, reasons, min_gap_ratio)
    rows = split_hourly(events, split_method(F.col("operator")))
    # the series of the grid come from the events: no second split, a tiny exchange
    bounds = fixed_bounds(with_rows(events), keys, lo, hi)
    dense = hourly_activity(rows, keys, eps, bounds)
    return run_features(dense, keys).select(
        *keys,
        "ts",
        "total_load",
        F.col("total_active_duration").alias("data_driven_total_active_duration"),
        F.col("n_interventions").alias("data_driven_n_interventions"),
        F.col("max_load_weighted").alias("data_driven_max_load_weighted_proxy"),
        "runlength_indicator",
        "runlength_zero",
        "runlength_switches",
    )


def target_by_reason_class(
    df: DataFrame, classes: dict[str, Sequence[str]], lo: Column, hi: Column
) -> DataFrame:
    """All reason classes in one plan: the class is one more series key."""
    pairs = [F.struct(F.lit(c).alias("cls"), F.lit(r).alias("r")) for c, rs in classes.items() for r in rs]
    fanned = (
        df.withColumn(
            "reason_class",
            F.explode(
                F.transform(
                    F.filter(F.array(*pairs), lambda p: p["r"] == F.col("reason")),
                    lambda p: p["cls"],
                )
            ),
        )
    )
    reasons = sorted({r for rs in classes.values() for r in rs})
    return target_dataset(
        fanned, reasons, lo, hi, keys=("reason_class", "operator", "direction")
    )
