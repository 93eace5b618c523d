"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import joins, metrics as me
from tidegrid.operators.chunked import exact_quantiles
from tidegrid.plans import derive
from tidegrid.plans.derive import HS, PN, PR, with_cte
from tidegrid.plans.registry import query

SERIES = ["tso", "unique_id"]
KEYS = [*SERIES, "model"]

_M = {
    "mae": "avg(abs(y_pred - y))",
    "rmse": "sqrt(avg((y_pred - y) * (y_pred - y)))",
    "mae_conditional": "avg(abs(y_pred - y)) FILTER (WHERE y > 0)",
    "fbeta_2.0": "coalesce(5.0 * sum(CASE WHEN y > 0 AND y_pred > 0 THEN 1 ELSE 0 END) / nullif(5.0 * sum(CASE WHEN y > 0 AND y_pred > 0 THEN 1 ELSE 0 END)"
    " + 4.0 * sum(CASE WHEN y > 0 AND y_pred <= 0 THEN 1 ELSE 0 END) + sum(CASE WHEN y <= 0 AND y_pred > 0 THEN 1 ELSE 0 END), 0), 0)",
    "r2_score": "CASE WHEN max(y) = min(y) THEN CASE WHEN sum((y_pred - y) * (y_pred - y)) = 0 THEN 1.0 ELSE 0.0 END"
    " ELSE 1 - sum((y_pred - y) * (y_pred - y)) / (count(*) * var_pop(y)) END",
}
_COLS = ", ".join(f'round({e}, 8) AS "{n}"' for n, e in _M.items())


def _r(df, *cols, n=8):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(f"`{c}`"), n))
    return df


@query(
    "agg5_agg6_agg7_metrics",
    with_cte(PN, PR)
    + f"SELECT tso, unique_id, model, {_COLS}, round(avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 8) AS sparsity, round(sum(y), 4) AS volume FROM pr GROUP BY ALL",
)
def agg7(spark, d):
    out = me.point_metrics(derive.predictions(spark, d), KEYS)
    return _r(_r(out, *_M, "sparsity"), "volume", n=4)


_EVAL = f"""
pm AS (SELECT tso, unique_id, model, {', '.join(f'{e} AS "{n}"' for n, e in _M.items())}, avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS sparsity, sum(y) AS volume
       FROM pr WHERE {{where}} GROUP BY ALL),
ev AS (SELECT tso, unique_id, model, sparsity, volume, metric, value FROM
       (UNPIVOT pm ON {', '.join(f'"{n}"' for n in _M)} INTO NAME metric VALUE value))
"""


@query(
    "agg8_evaluation_in_dates",
    with_cte(PN, PR, _EVAL.format(where="ds >= TIMESTAMP '2024-01-09' AND ds <= TIMESTAMP '2024-01-25'"))
    + "SELECT tso, unique_id, model, metric, round(value, 8) AS value, round(sparsity, 8) AS sparsity, round(volume, 4) AS volume FROM ev",
)
def agg8(spark, d):
    out = me.evaluate(
        derive.predictions(spark, d), KEYS, 2.0,
        F.lit("2024-01-09").cast("timestamp"), F.lit("2024-01-25").cast("timestamp"),
    ).where("value IS NOT NULL")
    return _r(_r(out, "value", "sparsity"), "volume", n=4)


@query(
    "agg9_all_levels",
    with_cte(PN, PR)
    + f"""SELECT model, CASE WHEN horizon IS NOT NULL THEN 'horizon' WHEN window_index IS NOT NULL THEN 'window_index' ELSE 'overall' END AS level, horizon, window_index, {_COLS}
FROM pr GROUP BY GROUPING SETS ((model), (model, horizon), (model, window_index))""",
)
def agg9(spark, d):
    out = me.evaluate_levels(derive.predictions(spark, d), ["model"], ["horizon", "window_index"])
    return _r(out, *_M)


REGIMES = [
    ("calm", "2024-01-02", "2024-01-10"),
    ("windy", "2024-01-08", "2024-01-20"),
    ("late", "2024-01-20", "2024-02-01"),
]
_RG = "rg(regime, lo, hi) AS (VALUES " + ", ".join(
    f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in REGIMES
) + ")"


def regimes(spark):
    return spark.createDataFrame(REGIMES, "regime string, lo string, hi string").select(
        "regime", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi")
    )


@query(
    "agg9_jon11_per_regime",
    with_cte(PN, PR, _RG)
    + f"SELECT regime, tso, unique_id, model, {_COLS} FROM pr JOIN rg ON ds >= lo AND ds < hi GROUP BY ALL",
)
def jon11(spark, d):
    rows = joins.in_windows(derive.predictions(spark, d), regimes(spark), "ds", "lo", "hi")
    return _r(me.point_metrics(rows, ["regime", *KEYS]).drop("sparsity", "volume"), *_M)


@query(
    "agg10_by_sparsity_class",
    with_cte(PN, PR, _EVAL.format(where="TRUE"))
    + """SELECT metric, model, CASE WHEN sparsity >= 0.7 THEN 'Sparse' ELSE 'Dense' END AS sparsity_class,
 round(CASE WHEN any_value(metric) = 'mae' THEN sum(value * volume) / sum(volume) ELSE avg(value) END, 8) AS value FROM ev GROUP BY metric, model, 3""",
)
def agg10(spark, d):
    return _r(me.by_class(me.evaluate(derive.predictions(spark, d), KEYS)), "value")


_MAEH = "mh AS (SELECT tso, unique_id, model, horizon, avg(abs(y_pred - y)) AS mae FROM pr GROUP BY ALL)"


@query(
    "agg11_horizon_difference",
    with_cte(PN, PR)
    + """, a AS (SELECT model, horizon, avg(abs(y_pred - y)) AS mae FROM pr WHERE unique_id = 'up' GROUP BY ALL),
b AS (SELECT model, horizon, avg(abs(y_pred - y)) AS mae FROM pr WHERE unique_id = 'down' GROUP BY ALL)
SELECT model, horizon, round(a.mae - b.mae, 8) AS difference FROM a JOIN b USING (model, horizon)""",
)
def agg11(spark, d):
    p = derive.predictions(spark, d)
    h = p.groupBy("model", "horizon", "unique_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y"))).alias("value"))
    out = me.metric_difference(
        h.where("unique_id = 'up'").drop("unique_id"), h.where("unique_id = 'down'").drop("unique_id"), ["model", "horizon"]
    )
    return _r(out, "difference")


@query(
    "agg11_horizon_boxplot",
    with_cte(PN, PR, _MAEH)
    + """SELECT model, CASE WHEN horizon <= 9 THEN '1-9' WHEN horizon <= 16 THEN '10-16' ELSE '17+' END AS block, round(min(mae), 8) AS low,
 round(quantile_cont(mae, 0.25), 8) AS q1, round(quantile_cont(mae, 0.5), 8) AS median, round(quantile_cont(mae, 0.75), 8) AS q3, round(max(mae), 8) AS high FROM mh GROUP BY ALL""",
)
def agg11_box(spark, d):
    h = derive.predictions(spark, d).groupBy(*KEYS, "horizon").agg(
        F.avg(F.abs(F.col("y_pred") - F.col("y"))).alias("mae")
    ).withColumn("block", me.horizon_bin(F.col("horizon"), [9, 16]))
    return _r(me.five_numbers(h, ["model", "block"], "mae"), "low", "q1", "median", "q3", "high")


@query(
    "agg4_describe_series",
    with_cte(PN)
    + """SELECT tso, unique_id, round(avg(y), 8) AS mean, round(quantile_cont(y, 0.5), 8) AS median, round(quantile_cont(y, 0.75), 8) AS q75,
 round(quantile_cont(y, 0.9), 8) AS q90, round(quantile_cont(y, 0.99), 8) AS q99, round(avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 8) AS zero_share FROM pn GROUP BY ALL""",
)
def agg4(spark, d):
    out = me.describe_series(derive.panel(spark, d), SERIES)
    return _r(out, "mean", "median", "q75", "q90", "q99", "zero_share")


_COST = """
cost AS (SELECT date_trunc('month', o_orderdate) AS begin_date, round(sum(o_totalprice) FILTER (WHERE r_name = 'AFRICA'), 2) AS AFRICA,
 round(sum(o_totalprice) FILTER (WHERE r_name = 'AMERICA'), 2) AS AMERICA, round(sum(o_totalprice) FILTER (WHERE r_name = 'ASIA'), 2) AS ASIA,
 round(sum(o_totalprice) FILTER (WHERE r_name = 'EUROPE'), 2) AS EUROPE,
 round(sum(o_totalprice) FILTER (WHERE r_name = 'MIDDLE EAST'), 2) AS MIDDLE_EAST
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
"""
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST"]


def _cost(spark, d):
    t = {n: derive.table(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    place = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = (
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return rows.groupBy(F.date_trunc("month", "o_orderdate").alias("begin_date")).agg(
        *[F.round(F.sum(F.when(F.translate("r_name", " ", "_") == r, F.col("o_totalprice"))), 2).alias(r) for r in _REGIONS]
    )


@query(
    "agg20_yearly_cost",
    with_cte(_COST)
    + """, y AS (SELECT CAST(year(begin_date) AS INT) AS year, sum(AFRICA)/1e6 AS AFRICA, sum(AMERICA)/1e6 AS AMERICA, sum(ASIA)/1e6 AS ASIA, sum(EUROPE)/1e6 AS EUROPE, sum(MIDDLE_EAST)/1e6 AS MIDDLE_EAST
 FROM (SELECT DISTINCT ON (AFRICA, AMERICA, ASIA, EUROPE, MIDDLE_EAST) * FROM cost) GROUP BY 1)
SELECT year, operator, round(cost_million, 5) AS cost_million FROM (UNPIVOT y ON AFRICA, AMERICA, ASIA, EUROPE, MIDDLE_EAST INTO NAME operator VALUE cost_million)""",
)
def agg20(spark, d):
    return _r(me.yearly_cost(_cost(spark, d), _REGIONS), "cost_million", n=5)


@query(
    "agg20_covered_period",
    with_cte(_COST) + "SELECT strftime(min(begin_date), '%Y-%m') AS first_month, strftime(max(begin_date), '%Y-%m') AS last_month FROM cost",
)
def agg20_period(spark, d):
    return me.covered_period(_cost(spark, d))


@query(
    "agg21_hurdle_stats",
    with_cte(PN)
    + """SELECT tso, unique_id, round(CASE WHEN count(*) FILTER (WHERE y >= 20) = 0 THEN 0.01 ELSE count(*) FILTER (WHERE y >= 20) / count(*)::DOUBLE END, 8) AS base_rate,
 round(CASE WHEN count(*) FILTER (WHERE y >= 20) = 0 THEN 0 ELSE quantile_cont(y, 0.5) FILTER (WHERE y >= 20) END, 8) AS median,
 round(CASE WHEN count(*) FILTER (WHERE y >= 20) = 0 THEN count(*) ELSE (count(*) - count(*) FILTER (WHERE y >= 20)) / nullif(count(*) FILTER (WHERE y >= 20), 0)::DOUBLE END, 8) AS pos_weight,
 round(CASE WHEN count(*) FILTER (WHERE y >= 20) = 0 THEN 1 ELSE quantile_cont(y, 0.9) FILTER (WHERE y >= 20) END, 8) AS delta FROM pn GROUP BY ALL""",
)
def agg21(spark, d):
    out = me.hurdle_stats(derive.panel(spark, d), SERIES, eps=20.0)
    return _r(out, "base_rate", "median", "pos_weight", "delta")


_HU = """
hu AS (SELECT b.tso, b.unique_id, b.ds, b.window_index, b.y, (b.y_pred - 15) / 25.0 AS logit, n.y_pred - 3 AS magnitude
 FROM pr b JOIN pr n USING (tso, unique_id, ds) WHERE b.model = 'blend' AND n.model = 'seasonal'),
pp AS (SELECT *, CASE WHEN logit >= 0 THEN 1 / (1 + exp(-logit)) ELSE exp(logit) / (1 + exp(logit)) END AS p FROM hu)
"""


def _hurdle(spark, d):
    p = derive.predictions(spark, d).where(F.col("model").isin("blend", "seasonal"))
    return p.groupBy(*SERIES, "ds", "window_index").agg(
        F.max("y").alias("y"),
        ((F.max(F.when(F.col("model") == "blend", F.col("y_pred"))) - 15) / 25.0).alias("logit"),
        (F.max(F.when(F.col("model") == "seasonal", F.col("y_pred"))) - 3).alias("magnitude"),
    )


@query(
    "prj12_hurdle_forecast",
    with_cte(PN, PR, _HU)
    + """SELECT tso, unique_id, ds, round(p * greatest(magnitude, 0), 8) AS point, round(CASE WHEN p >= 0.45 THEN greatest(magnitude, 0) ELSE 0 END, 8) AS gated FROM pp""",
)
def prj12(spark, d):
    h = _hurdle(spark, d)
    out = h.select(
        *SERIES, "ds",
        me.hurdle_point(F.col("logit"), F.col("magnitude")).alias("point"),
        me.hurdle_gate(F.col("logit"), F.col("magnitude"), F.lit(0.45)).alias("gated"),
    )
    return _r(out, "point", "gated")


_THETA = """
th AS (SELECT i / 51.0 AS theta FROM range(1, 51) t(i)),
pd AS (SELECT {k}, unique_id, theta, sum(abs(CASE WHEN p >= theta THEN greatest(magnitude, 0) ELSE 0 END - y)) AS ae, count(*) AS n,
  sum(CASE WHEN y > 0 AND p >= theta THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y <= 0 AND p >= theta THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y > 0 AND p < theta THEN 1 ELSE 0 END) AS fn FROM pp, th GROUP BY ALL),
tt AS (SELECT {k}, theta, sum(ae) / sum(n) AS mae, avg(coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * fn + fp, 0), 0)) AS fbeta_mean FROM pd GROUP BY ALL),
sc AS (SELECT *, mae + 30 * greatest(0.8 - fbeta_mean, 0) AS combined FROM tt),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY combined, theta) AS rn FROM sc)
SELECT {k}, round(theta, 8) AS theta, round(combined, 8) AS combined, round(mae, 8) AS mae, round(fbeta_mean, 8) AS fbeta_mean FROM rk WHERE rn = 1"""


@query("agg22_threshold_search", with_cte(PN, PR, _HU, _THETA.format(k="tso")))
def agg22(spark, d):
    h = _hurdle(spark, d).withColumn("p", me.sigmoid(F.col("logit")))
    out = me.threshold_search(h, ["tso"], target=0.8, weight=30.0, n_grid=50)
    return _r(out, "theta", "combined", "mae", "fbeta_mean")


@query("agg22_threshold_per_window", with_cte(PN, PR, _HU, _THETA.format(k="tso, window_index")))
def agg22_window(spark, d):
    h = _hurdle(spark, d).withColumn("p", me.sigmoid(F.col("logit")))
    out = me.threshold_search(h, ["tso", "window_index"], target=0.8, weight=30.0, n_grid=50)
    return _r(out, "theta", "combined", "mae", "fbeta_mean")


@query(
    "agg23_run_memory",
    """SELECT o_orderpriority AS run, round(max(o_totalprice * 1e5) / pow(1024, 3), 8) AS max, round(quantile_cont(o_totalprice * 1e5, 0.5) / pow(1024, 3), 8) AS median,
 round(quantile_cont(o_totalprice * 1e5, 0.9) / pow(1024, 3), 8) AS q90, round(quantile_cont(o_totalprice * 1e5, 0.95) / pow(1024, 3), 8) AS q95 FROM orders GROUP BY 1""",
)
def agg23(spark, d):
    o = derive.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("run"), (F.col("o_totalprice") * 1e5).alias("bytes")
    )
    return _r(me.run_memory(o, ["run"], "bytes"), "max", "median", "q90", "q95")


@query(
    "agg26_outage_lead_time",
    """WITH l AS (SELECT r_name, date_diff('microsecond', o_orderdate, l_shipdate) / 3600000000.0 AS hours
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
 WHERE l_linenumber = 1)
SELECT r_name, prob, round(CASE prob WHEN 0.25 THEN quantile_cont(hours, 0.25) WHEN 0.5 THEN quantile_cont(hours, 0.5) ELSE quantile_cont(hours, 0.9) END, 8) AS quantile
FROM l, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) p(prob) GROUP BY r_name, prob""",
)
def agg26(spark, d):
    t = {n: derive.table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    place = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("r_name", F.col("l_linenumber").alias("version"), F.col("o_orderdate").alias("published"), F.col("l_shipdate").alias("start"))
    )
    return _r(me.lead_time(rows, ["r_name"], [0.25, 0.5, 0.9]), "quantile")


@query(
    "agg27_collapse_overlaps",
    """SELECT l_suppkey, l_shipdate, round(avg(l_extendedprice), 4) AS y_pred FROM lineitem GROUP BY ALL""",
)
def agg27(spark, d):
    li = derive.table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "y_pred")
    return _r(me.collapse_overlaps(li, ["l_suppkey", "l_shipdate"]), "y_pred", n=4)


@query(
    "agg28_series_class",
    with_cte(PN)
    + "SELECT tso, unique_id, round(avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 8) AS sparsity, CASE WHEN avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) >= 0.7 THEN 'Sparse' ELSE 'Dense' END AS sparsity_class FROM pn GROUP BY ALL",
)
def agg28(spark, d):
    return _r(me.series_class(derive.panel(spark, d), SERIES), "sparsity")


_ALIAS_SQL = "concat('elasticnet_alpha_', c_nationkey // 5, 'p', c_nationkey % 5, '_l1r0p', c_custkey % 9 + 1)"


@query(
    "prj14_alias_parameters",
    f"""WITH a AS (SELECT DISTINCT {_ALIAS_SQL} AS alias FROM customer)
SELECT alias, CAST(replace(regexp_extract(alias, 'elasticnet_alpha_([0-9mp]+)_l1r([0-9mp]+)', 1), 'p', '.') AS DOUBLE) AS alpha,
 CAST(replace(regexp_extract(alias, 'elasticnet_alpha_([0-9mp]+)_l1r([0-9mp]+)', 2), 'p', '.') AS DOUBLE) AS l1_ratio FROM a""",
)
def prj14(spark, d):
    a = derive.table(spark, d, "customer").selectExpr(
        "concat('elasticnet_alpha_', c_nationkey div 5, 'p', c_nationkey % 5, '_l1r0p', c_custkey % 9 + 1) AS alias"
    ).distinct()
    return a.select(
        "alias",
        me.number_in_alias(F.col("alias"), r"elasticnet_alpha_([\dmp]+)_l1r").alias("alpha"),
        me.number_in_alias(F.col("alias"), r"_l1r([\dmp]+)").alias("l1_ratio"),
    )


@query(
    "agg29_parameter_choice",
    """WITH s AS (SELECT c_mktsegment AS tso, c_nationkey AS alpha, avg(c_acctbal) AS mae, avg(c_acctbal * c_acctbal) / 1e4 AS guard FROM customer GROUP BY ALL),
a AS (SELECT *, min(mae) OVER (PARTITION BY tso) AS bp FROM s), b AS (SELECT * FROM a WHERE mae <= bp * 1.15),
c AS (SELECT *, max(guard) OVER (PARTITION BY tso) AS bg FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY tso ORDER BY guard >= bg * 0.9 DESC, alpha DESC) AS rn FROM c)
SELECT tso, alpha, round(mae, 5) AS mae, round(guard, 5) AS guard, round(bp, 5) AS best_primary, round(bg, 5) AS best_guardrail FROM r WHERE rn = 1""",
)
def agg29(spark, d):
    s = derive.table(spark, d, "customer").groupBy(
        F.col("c_mktsegment").alias("tso"), F.col("c_nationkey").alias("alpha")
    ).agg(F.avg("c_acctbal").alias("mae"), (F.avg(F.col("c_acctbal") * F.col("c_acctbal")) / 1e4).alias("guard"))
    out = me.choose_parameters(
        s, ["tso"], "mae", "guard", [F.col("alpha").desc()], guardrail_higher=True, primary_tol=0.15, guardrail_tol=0.1
    )
    return _r(out, "mae", "guard", "best_primary", "best_guardrail", n=5)


@query(
    "win11_mean_rank",
    with_cte(PN, PR)
    + """, s AS (SELECT tso, unique_id, model, round(avg(abs(y_pred - y)), 3) AS value FROM pr GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY tso, unique_id ORDER BY value) + (count(*) OVER (PARTITION BY tso, unique_id, value) - 1) / 2.0 AS rk FROM s)
SELECT model, round(avg(rk), 8) AS mean_rank FROM r GROUP BY model""",
)
def win11(spark, d):
    s = derive.predictions(spark, d).groupBy(*KEYS).agg(F.round(F.avg(F.abs(F.col("y_pred") - F.col("y"))), 3).alias("value"))
    return _r(me.mean_rank(s, SERIES, ["model"]), "mean_rank")


@query(
    "win13_snk5_report_table",
    with_cte(PN, PR)
    + """, s AS (SELECT tso, unique_id, model, avg(abs(y_pred - y)) AS value FROM pr GROUP BY ALL)
SELECT tso, unique_id, model, round(value, 2) = min(round(value, 2)) OVER (PARTITION BY tso, unique_id) AS is_best, format('{:.2f}', value) AS text FROM s""",
)
def win13(spark, d):
    s = derive.predictions(spark, d).groupBy(*KEYS).agg(F.avg(F.abs(F.col("y_pred") - F.col("y"))).alias("value"))
    return me.mark_best(s, SERIES, digits=2).drop("value")


@query(
    "prj11_prepare_predictions",
    with_cte(PN, PR)
    + """SELECT tso, unique_id, ds, CASE WHEN model = 'blend' THEN 'tft' ELSE model END AS model, CASE WHEN y_pred - 20 < 0 THEN 0 ELSE y_pred - 20 END AS y_pred, pn.y
FROM pr JOIN pn USING (tso, unique_id, ds) WHERE model <> 'damped'""",
)
def prj11(spark, d):
    raw = derive.predictions(spark, d).drop("y", "horizon", "window_index").withColumn(
        "model", F.expr("CASE model WHEN 'blend' THEN 'tft-median' WHEN 'damped' THEN 'tft-lo-90' ELSE model END")
    ).withColumn("y_pred", F.col("y_pred") - 20)
    return me.prepare_predictions(raw, derive.panel(spark, d), [*SERIES, "ds"])


@query(
    "prj13_cyclic_horizon",
    with_cte(PN)
    + "SELECT tso, unique_id, ds, CAST((date_diff('hour', TIMESTAMP '2024-01-01 05:00:00', ds) % 36 + 36) % 36 + 1 AS INT) AS horizon FROM pn",
)
def prj13(spark, d):
    return derive.panel(spark, d).select(
        *SERIES, "ds", me.cyclic_horizon(F.col("ds"), F.lit("2024-01-01 05:00:00").cast("timestamp"), 36).alias("horizon")
    )


_SEEDED = "CASE model WHEN 'naive' THEN 'tft_seed7' WHEN 'blend' THEN 'tft' WHEN 'seasonal' THEN 'tft_quantile' ELSE 'nhits_seed778' END"


@query(
    "prj15_select_models",
    with_cte(PN, PR)
    + f"""SELECT regexp_replace(m, '_seed[0-9]+', '') AS display, CAST(CASE WHEN m LIKE 'nhits%' THEN 0 ELSE 1 END AS INT) AS model_order, count(*) AS n
FROM (SELECT {_SEEDED} AS m FROM pr) WHERE m <> 'tft_quantile' GROUP BY ALL""",
)
def prj15(spark, d):
    p = derive.predictions(spark, d).withColumn("model", F.expr(_SEEDED))
    return me.select_models(p, ["nhits", "tft"]).groupBy(
        me.display_name(F.col("model")).alias("display"), "model_order"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt7_filter_predictions",
    with_cte(PN, PR)
    + "SELECT tso, unique_id, ds, model, y_pred FROM pr WHERE unique_id = 'up' AND window_index IN (0, 2) AND ds >= TIMESTAMP '2024-01-03' AND ds <= TIMESTAMP '2024-01-26'",
)
def flt7(spark, d):
    return me.filter_predictions(
        derive.predictions(spark, d), None, [0, 2], ["up"],
        F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-26").cast("timestamp"),
    ).select(*SERIES, "ds", "model", "y_pred")


@query(
    "jon4_jon7_common_rows",
    with_cte(PN, PR)
    + """SELECT p.tso, p.unique_id, p.ds, p.horizon, p.model, p.y_pred FROM pr p SEMI JOIN (SELECT * FROM pr WHERE model = 'naive' AND y > 0) k
 ON p.tso = k.tso AND p.unique_id = k.unique_id AND p.ds = k.ds WHERE p.ds >= TIMESTAMP '2024-01-05' AND p.ds < TIMESTAMP '2024-01-21'""",
)
def jon4(spark, d):
    p = derive.predictions(spark, d)
    a = p.where("ds >= '2024-01-05' AND model <> 'naive'")
    b = p.where("ds < '2024-01-21' AND model = 'naive' AND y > 0")
    a, b = joins.common_rows([a, b], [*SERIES, "ds", "horizon"])
    return a.unionByName(b).select(*SERIES, "ds", "horizon", "model", "y_pred")


@query(
    "jon7_set2_common_models",
    with_cte(PN, PR) + "SELECT model, window_index, count(*) AS n FROM pr WHERE model IN ('blend', 'naive') GROUP BY ALL",
)
def jon7(spark, d):
    p = derive.predictions(spark, d)
    a = p.where("window_index = 0 AND model <> 'seasonal' AND model <> 'damped'")
    b = p.where("window_index > 0 AND model <> 'seasonal'")
    a, b = joins.common_models([a, b])
    return a.unionByName(b).groupBy("model", "window_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon6_benchmarks_to_windows",
    with_cte(PN, PR)
    + """, k AS (SELECT DISTINCT tso, unique_id, ds, window_index FROM (SELECT * FROM pr UNION ALL SELECT * REPLACE (window_index + 1 AS window_index) FROM pr) WHERE model = 'blend')
SELECT window_index, tso, unique_id, ds, y_pred FROM k JOIN (SELECT tso, unique_id, ds, y_pred FROM pr WHERE model = 'naive') USING (tso, unique_id, ds)""",
)
def jon6(spark, d):
    p = derive.predictions(spark, d)
    blend = p.where("model = 'blend'")
    both = blend.unionByName(blend.withColumn("window_index", F.col("window_index") + 1))
    bench = p.where("model = 'naive'").select(*SERIES, "ds", "y_pred")
    return joins.attach_to_windows(both, bench, [*SERIES, "ds"])


@query(
    "jon8_piv1_piv2_wide_predictions",
    with_cte(PN, PR)
    + """SELECT tso, unique_id, ds, max(y_pred) FILTER (WHERE model = 'blend') AS blend, max(y_pred) FILTER (WHERE model = 'naive') AS naive,
 max(y_pred) FILTER (WHERE model = 'seasonal') AS seasonal, max(y_pred) FILTER (WHERE model = 'damped') AS damped FROM pr GROUP BY ALL""",
)
def jon8(spark, d):
    p = derive.predictions(spark, d)
    wide = joins.to_wide(p, [*SERIES, "ds"], "model", "y_pred", ["blend", "naive", "seasonal", "damped"])
    long = joins.to_long(wide, [*SERIES, "ds"], ["blend", "naive", "seasonal", "damped"], "model", "y_pred")
    return joins.to_wide(long, [*SERIES, "ds"], "model", "y_pred", ["blend", "naive", "seasonal", "damped"])


@query(
    "jon9_snapshot_comparison",
    """WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prio FROM orders WHERE year(o_orderdate) <= 1998),
b AS (SELECT DISTINCT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prio FROM orders WHERE year(o_orderdate) >= 1998)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(a.prio, b.prio) AS prio,
 CASE WHEN a.o_custkey IS NULL THEN 'right_only' WHEN b.o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.prio IS NOT DISTINCT FROM b.prio""",
)
def jon9(spark, d):
    o = derive.table(spark, d, "orders").withColumn(
        "prio", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END")
    )
    return joins.compare_snapshots(
        o.where("year(o_orderdate) <= 1998"), o.where("year(o_orderdate) >= 1998"), ["o_custkey", "o_orderstatus", "prio"]
    )


_REC = """
a AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL),
b AS (SELECT user_id, ts, value + CASE WHEN hour(ts) % 3 = 0 THEN 0.25 ELSE 0 END AS value FROM a),
j AS (SELECT user_id, ts, abs(a.value - b.value) AS abs_diff, CAST(abs(a.value - b.value) > 1e-8 + 1e-5 * abs(b.value) AS INT) AS mismatch FROM a JOIN b USING (user_id, ts))
"""


def _rec(spark, d):
    a = derive.table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.round(F.sum("value"), 2).alias("value")
    )
    b = a.withColumn("value", F.col("value") + F.when(F.hour("ts") % 3 == 0, 0.25).otherwise(0.0))
    return joins.reconcile(a, b, ["user_id", "ts"])


@query(
    "jon10_reconcile_sources",
    with_cte(_REC) + "SELECT user_id, count(*) AS n, round(avg(mismatch), 8) AS mismatch_share, round(max(abs_diff), 8) AS max_diff FROM j GROUP BY 1",
)
def jon10(spark, d):
    out = _rec(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mismatch").alias("mismatch_share"), F.max("abs_diff").alias("max_diff")
    )
    return _r(out, "mismatch_share", "max_diff")


@query(
    "jon10_difference_quantiles",
    with_cte(_REC)
    + """SELECT prob, round(CASE prob WHEN 0.5 THEN quantile_cont(abs_diff, 0.5) WHEN 0.7 THEN quantile_cont(abs_diff, 0.7) ELSE quantile_cont(abs_diff, 0.99) END, 8) AS quantile
FROM j, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.99::DOUBLE)) p(prob) GROUP BY prob""",
)
def jon10_q(spark, d):
    return _r(exact_quantiles(_rec(spark, d), [], "abs_diff", [0.5, 0.7, 0.99]), "quantile")


@query(
    "set5_conflict_free_rows",
    with_cte(PN, PR) + "SELECT tso, unique_id, ds, model, y_pred FROM pr",
)
def set5(spark, d):
    p = derive.predictions(spark, d).select(*SERIES, "ds", "model", "y_pred")
    return joins.fail_on_conflict(p.unionByName(p), [*SERIES, "ds", "model"], "y_pred")


@query(
    "set6_append_renumbered",
    """WITH a AS (SELECT event_id AS stride, value FROM events WHERE event_type IS DISTINCT FROM 'error'),
b AS (SELECT event_id AS stride, value FROM events WHERE event_type = 'error')
SELECT stride, value FROM a UNION ALL SELECT stride + (SELECT max(stride) + 1 FROM a), value FROM b""",
)
def set6(spark, d):
    e = derive.table(spark, d, "events").withColumnRenamed("event_id", "stride")
    error = F.col("event_type").eqNullSafe("error")
    return joins.append_renumbered(e.where(~error).select("stride", "value"), e.where(error).select("stride", "value"), "stride")


@query(
    "set3_missing_hours",
    """WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events),
g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY user_id)
SELECT user_id, ts FROM g ANTI JOIN h USING (user_id, ts)""",
)
def set3(spark, d):
    from tidegrid.operators import densify

    hours = derive.table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("ts"))
    return densify.missing_hours(hours, ["user_id"], densify.series_bounds(hours, ["user_id"]))


@query(
    "set4_keep_last",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def set4(spark, d):
    e = derive.table(spark, d, "events")
    # keep-last as a maximum: rows are combined before the exchange
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id", "m.value")


@query(
    "srt4_tail_per_series",
    with_cte(PN)
    + "SELECT tso, unique_id, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY tso, unique_id ORDER BY ds DESC) AS rn FROM pn) WHERE rn <= 48",
)
def srt4(spark, d):
    from tidegrid.operators import frames

    return frames.tail_rows(derive.panel(spark, d), SERIES, 48)


@query(
    "flt10_history_window",
    with_cte(PN, PR)
    + """, w AS (SELECT tso, unique_id, window_index, min(ds) AS lo, max(ds) AS hi FROM pr GROUP BY ALL)
SELECT w.window_index, pn.tso, pn.unique_id, pn.ds, pn.y FROM w JOIN pn ON pn.tso = w.tso AND pn.unique_id = w.unique_id AND pn.ds >= w.lo - INTERVAL 48 HOUR AND pn.ds <= w.hi""",
)
def flt10(spark, d):
    from tidegrid.operators import frames

    return frames.history_before(
        derive.predictions(spark, d), derive.panel(spark, d), SERIES, 48
    ).select("window_index", *SERIES, "ds", "y")


@query(
    "flt11_clip_interval",
    with_cte(PN)
    + """, b AS (SELECT tso, unique_id, min(ds) AS lo, max(ds) AS hi FROM pn GROUP BY ALL)
SELECT tso, unique_id, greatest(lo, TIMESTAMP '2023-12-30') AS start, least(hi, TIMESTAMP '2024-01-15') AS "end",
 date_diff('hour', greatest(lo, TIMESTAMP '2023-12-30'), least(hi, TIMESTAMP '2024-01-15')) AS n_points FROM b""",
)
def flt11(spark, d):
    from tidegrid.operators import frames

    return frames.clip_interval(
        derive.panel(spark, d), SERIES, F.lit("2023-12-30").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")
    )
