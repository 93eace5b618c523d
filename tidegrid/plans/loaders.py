"""Covariate loaders: long source tables to long feature tables for all operators at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.lookups import OPERATORS, fuel_group, neighbours
from tidegrid.operators import features as ft
from tidegrid.operators.densify import daily_to_hourly
from tidegrid.operators.impute import Rule, impute, rule_of

# Neighbours with a price or a flow worth a feature.
KEY_NEIGHBOURS = ["AT", "CH", "CZ", "DK_1", "DK_2", "FR", "NL", "PL"]
HOME = "DE_LU"


def _operator_neighbours(df: DataFrame, area: str, key_only: bool) -> DataFrame:
    """Rows of an area once per operator that has it as neighbour; DK stands for both zones."""
    pairs = F.array(
        *[
            F.struct(F.lit(o).alias("operator"), neighbours(F.lit(o)).alias("areas"))
            for o in OPERATORS
        ]
    )
    hit = F.filter(
        pairs,
        lambda p: F.array_contains(p["areas"], F.col(area))
        | (F.array_contains(p["areas"], F.lit("DK")) & F.col(area).isin("DK_1", "DK_2")),
    )
    rows = df.where(F.col(area).isin(KEY_NEIGHBOURS)) if key_only else df
    return rows.withColumn("operator", F.explode(F.transform(hit, lambda p: p["operator"])))


def day_ahead_prices(prices: DataFrame, fit: Column | None = None) -> DataFrame:
    """(area, ts, value) → home price and spread to each key neighbour, per operator."""
    named = prices.withColumn("metric", F.lit("price_"))
    filled = impute(named, [rule_of("price_")], fit, keys=["area"]).select("area", "ts", F.col("imputed").alias("value"))
    home = filled.where(F.col("area") == HOME).select("ts", F.col("value").alias("home"))
    spread = _operator_neighbours(filled, "area", True).join(home, "ts", "left").select(
        "operator",
        "ts",
        F.concat(F.lit("day_ahead_price_spread_de_vs_"), F.lower("area")).alias("metric"),
        (F.col("home") - F.col("value")).alias("value"),
    )
    own = home.select(
        F.explode(F.array(*[F.lit(o) for o in OPERATORS])).alias("operator"),
        "ts",
        F.lit("day_ahead_price_de_lu").alias("metric"),
        F.col("home").alias("value"),
    )
    return own.unionByName(spread)


def production_actuals(actual: DataFrame, days: int = 7, fit: Column | None = None, backfill: bool = True) -> DataFrame:
    """(operator, fuel, ts, value) → lag and rolling mean per fuel group.

    Every generation column is filled by the forecast rule before the groups
    are summed.
    """
    rule = Rule("", gap=6, min_count=8)
    named = actual.withColumn("metric", F.lit("generation_"))
    filled = impute(named, [rule], fit, keys=["operator", "fuel"]).select(
        "operator", "fuel", "ts", F.col("imputed").alias("value")
    )
    grouped = ft.group_sums(filled, ["operator", "ts"], fuel_group(F.col("fuel")))
    return ft.lag_and_rolling(grouped, ["operator", "group"], days, (1,), backfill)


def consumption(actual: DataFrame, days: int = 7, fit: Column | None = None, backfill: bool = True, minimal: bool = True) -> DataFrame:
    """(area, ts, value) → lags and rolling statistics of the load."""
    named = actual.withColumn("metric", F.lit("consumption_load_actual_"))
    filled = impute(named, [rule_of("consumption_load_actual_")], fit, keys=["area"]).select(
        "area", "ts", F.col("imputed").alias("value")
    )
    rolled = ft.rolling_same_hour(filled, ["area"], days, backfill, not minimal)
    return ft.lags(rolled, ["area"], (1,) if minimal else (1, 48), backfill)


def consumption_forecasts(forecast: DataFrame, fit: Column | None = None) -> DataFrame:
    named = forecast.withColumn("metric", F.lit("consumption_forecast_"))
    return impute(named, [rule_of("consumption_forecast_")], fit, keys=["area"]).select("area", "ts", F.col("imputed").alias("value"))


def wind_pv(actual: DataFrame, days: int = 7, fit: Column | None = None, backfill: bool = True) -> DataFrame:
    """(operator, kind, ts, value), kind like ``wind_onshore`` or ``pv`` → totals with lag and rolling."""
    named = actual.withColumn(
        "metric",
        F.when(F.col("kind").startswith("wind"), F.lit("wind_actual_")).otherwise(F.lit("pv_actual_")),
    )
    filled = impute(named, [rule_of("wind_actual_"), rule_of("pv_actual_")], fit, keys=["operator", "kind"]).select(
        "operator", "kind", "ts", F.col("imputed").alias("value")
    )
    group = F.when(F.col("kind").startswith("wind"), F.lit("wind_actual_total")).otherwise(F.lit("pv_actual"))
    totals = ft.group_sums(filled, ["operator", "ts"], group)
    return ft.lag_and_rolling(totals, ["operator", "group"], days, (1,), backfill)


def cross_border(
    flows: DataFrame, days: int = 7, fit: Column | None = None, activity: float = 0.3,
    magnitude: float = 100.0, max_missing: float = 0.70, force_keep: Column | None = None, backfill: bool = True,
) -> DataFrame:
    """(from_area, to_area, ts, value) → lag and rolling mean of the kept net flows."""
    named = flows.withColumn("metric", F.lit("cross_border_"))
    filled = impute(named, [rule_of("cross_border_")], fit, keys=["from_area", "to_area"]).select(
        "from_area", "to_area", "ts", F.col("imputed").alias("value")
    )
    net = ft.net_flow(filled, ["ts"], HOME).select("neighbour", "ts", F.col("net").alias("value"))
    net = ft.drop_sparse(net, ["neighbour"], max_missing, force_keep)
    net = ft.select_active(net, ["neighbour"], activity, magnitude)
    return ft.lag_and_rolling(net, ["neighbour"], days, (1,), backfill)


def scheduled_exchanges(flows: DataFrame, activity: float = 0.3, magnitude: float = 100.0) -> DataFrame:
    """Net scheduled exchange per neighbour; nulls stay, one-sided borders count."""
    net = ft.net_flow(flows, ["ts"], HOME, one_sided=True).select(
        "neighbour", "ts", F.col("net").alias("value")
    )
    return ft.select_active(net, ["neighbour"], activity, magnitude)


def futures(daily: DataFrame, changes: Sequence[str] = ("gas", "carbon")) -> DataFrame:
    """(day, power, gas, coal, carbon, ...) → hourly spreads, and changes of the prices in ``changes``, of the following day.

    Prices are carried forward over days without trade, the change is against
    the row before, and a price counts from the next day on.
    """
    from tidegrid.operators.chunked import carry_last

    names = list(dict.fromkeys(["power", "gas", "coal", "carbon", *changes]))
    one = daily.withColumn("_k", F.lit(1))
    filled = carry_last(one, ["_k"], "day", F.year("day"), {f"_f_{n}": F.col(n) for n in names})
    filled = filled.select("_k", "day", *[F.col(f"_f_{n}").alias(n) for n in names])
    for n in changes:
        filled = ft.row_difference(filled, ["_k"], "day", F.year("day"), n).withColumnRenamed(
            "change", f"{n}_change_24h"
        )
    shifted = filled.withColumn("day", F.date_add("day", 1))
    spreads = shifted.select(
        "day",
        ft.spark_spread(F.col("power"), F.col("gas"), F.col("carbon")).alias("clean_spark_spread"),
        ft.dark_spread(F.col("power"), F.col("coal"), F.col("carbon")).alias("clean_dark_spread"),
        *[f"{n}_change_24h" for n in changes],
    )
    return daily_to_hourly(spreads).drop("day")


def residual_and_other(wide: DataFrame) -> DataFrame:
    """Residual load, and production forecast without wind and solar (replaces the total).

    Terms that the table does not have are left out.
    """
    def opt(c: str) -> Column | None:
        return F.col(c) if c in wide.columns else None

    wind, solar = opt("wind_forecast_total"), opt("pv_forecast")
    out = wide
    if wind is None and solar is None:
        return out
    if "production_forecast" in wide.columns:
        out = out.withColumn(
            "production_forecast_other", ft.residual_load(F.col("production_forecast"), wind, solar)
        ).drop("production_forecast")
    if "consumption_forecast_load" in wide.columns:
        out = out.withColumn(
            "residual_load_forecast", ft.residual_load(F.col("consumption_forecast_load"), wind, solar)
        )
    return out
