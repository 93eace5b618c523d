"""Queries of dataset composition and of the remaining report helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import checks, metrics as me
from tidegrid.plans import compose, derive
from tidegrid.plans.derive import PN, PR, with_cte
from tidegrid.plans.q_eval import _COLS, _M, KEYS, SERIES, _r
from tidegrid.plans.q_features import _WIDE, _wide
from tidegrid.plans.registry import query


def _sets(spark, d):
    w = _wide(spark, d).withColumn("tso", F.concat(F.lit("T"), F.col("series"))).withColumnRenamed("ts", "ds").drop("series")
    return {
        "production_consumption": w.select("tso", "ds", "production_forecast", "consumption_forecast_load", "load_actual"),
        "wind_pv": w.select("tso", "ds", "wind_forecast_total", "pv_forecast"),
    }


@query(
    "cmp1_feature_set_composition",
    with_cte(PN, _WIDE)
    + """SELECT tso, unique_id, ds, y, wind_forecast_total, pv_forecast, consumption_forecast_load, load_actual,
 round(consumption_forecast_load - wind_forecast_total - pv_forecast, 8) AS residual_load_forecast,
 round(production_forecast - wind_forecast_total - pv_forecast, 8) AS production_forecast_other
FROM pn LEFT JOIN wd ON concat('T', wd.series) = pn.tso AND wd.ts = pn.ds""",
)
def cmp1(spark, d):
    base, sets = derive.panel(spark, d), _sets(spark, d)
    table = compose.joined(base, sets, ["tso", "ds"])
    out = compose.combination(
        table, base, sets, ["production_consumption", "wind_pv"], ["residual_load_forecast", "production_forecast_other"]
    )
    return _r(out, "residual_load_forecast", "production_forecast_other")


@query(
    "cmp1_summary",
    with_cte(PN)
    + """SELECT tso, name, CAST(n_columns AS INT) AS n_columns, count(*) AS rows, min(ds) AS first, max(ds) AS last
FROM pn, (VALUES ('basic', 4), ('wind', 6)) c(name, n_columns) GROUP BY ALL""",
)
def cmp1_summary(spark, d):
    base, sets = derive.panel(spark, d), _sets(spark, d)
    wind = compose.combination(compose.joined(base, {"wind_pv": sets["wind_pv"]}, ["tso", "ds"]), base, sets, ["wind_pv"])
    return compose.summary(wind, {"basic": base.columns, "wind": wind.columns}, ["tso"], "ds")


@query(
    "flt8_validated_predictions",
    with_cte(PN, PR) + "SELECT model, count(*) AS n FROM pr GROUP BY model",
)
def flt8(spark, d):
    p = checks.validate_predictions(derive.predictions(spark, d), ["tso", "unique_id", "ds", "horizon", "y"])
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon5_benchmarks_with_target",
    with_cte(PN, PR) + "SELECT tso, unique_id, ds, horizon, model, y_pred, y FROM pr WHERE model IN ('naive', 'seasonal') AND window_index < 2",
)
def jon5(spark, d):
    p = derive.predictions(spark, d)
    bench = p.where(F.col("model").isin("naive", "seasonal")).drop("window_index")
    anchor = p.where("window_index < 2")
    return me.with_anchor_target(bench, anchor, [*SERIES, "ds", "horizon"], "blend").select(
        *SERIES, "ds", "horizon", "model", "y_pred", "y"
    )


@query(
    "agg32_metrics_of_one_model",
    with_cte(PN, PR)
    + f"SELECT unique_id, {_COLS} FROM pr WHERE model = 'blend' GROUP BY ALL",
)
def agg32(spark, d):
    p = derive.predictions(spark, d).where("model = 'blend'").drop("y")
    rows = p.join(derive.panel(spark, d), [*SERIES, "ds"])
    return _r(me.point_metrics(rows, ["unique_id"]).drop("sparsity", "volume"), *_M)


@query(
    "srt2_ordered_report",
    with_cte(PN, PR)
    + """, a AS (SELECT model, avg(abs(y_pred - y)) AS mae, sqrt(avg((y_pred - y) * (y_pred - y))) AS rmse FROM pr GROUP BY model)
SELECT model, metric, CAST(CASE metric WHEN 'rmse' THEN 0 ELSE 1 END AS INT) AS metric_order, format('{:.3f}', value) AS text FROM (UNPIVOT a ON mae, rmse INTO NAME metric VALUE value)""",
)
def srt2(spark, d):
    long = me.evaluate(derive.predictions(spark, d), ["model"]).where(F.col("metric").isin("mae", "rmse"))
    return long.select(
        "model", "metric", me.metric_order(F.col("metric"), ["rmse", "mae"]).alias("metric_order"),
        F.format_number("value", 3).alias("text"),
    ).orderBy("metric_order", "model")


@query(
    "snk5_dm_cells",
    with_cte(PN, PR)
    + """, t AS (SELECT tso, model, avg(y_pred - y) AS s, avg(CASE WHEN y_pred > y THEN 1 ELSE 0 END) AS p FROM pr GROUP BY ALL)
SELECT tso, model, format('{:.2f}', s) || CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS cell, format('{:.2f}', p * 100) || '%' AS share FROM t""",
)
def snk5(spark, d):
    t = derive.predictions(spark, d).groupBy("tso", "model").agg(
        F.avg(F.col("y_pred") - F.col("y")).alias("s"), F.avg((F.col("y_pred") > F.col("y")).cast("int")).alias("p")
    )
    return t.select(
        "tso", "model", me.dm_cell(F.col("s"), F.col("p")).alias("cell"), me.percent_text(F.col("p")).alias("share")
    )
