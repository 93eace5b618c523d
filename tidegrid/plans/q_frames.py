"""Queries of the frame and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import boosting as bo, features as ft, frames as fr, models as mo, sweeps as sw
from tidegrid.operators.joins import to_wide
from tidegrid.plans import derive
from tidegrid.plans.derive import HS, PN, PR, with_cte
from tidegrid.plans.q_eval import KEYS, SERIES, _r
from tidegrid.plans.q_features import _EASTER, _holidays
from tidegrid.plans.registry import query

# monthly windows over the dates of the orders
_WINSQL = """
bd AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
cd AS (SELECT i AS window_index, lo, hi, lo + to_months(CAST(i AS INT)) AS train_start, lo + to_months(CAST(i + 37 AS INT)) AS valid_start,
  lo + to_months(CAST(i + 39 AS INT)) AS test_start, lo + to_months(CAST(i + 40 AS INT)) AS test_end FROM bd, range(200) t(i)),
sp AS (SELECT min(window_index) AS stop FROM cd WHERE test_end > hi + INTERVAL 1 HOUR
  AND (epoch(hi) - epoch(test_start)) / (epoch(test_end) - epoch(test_start)) < 0.5),
win AS (SELECT CAST(window_index AS INT) AS window_index, train_start, valid_start, test_start, test_end FROM cd, sp WHERE window_index < stop)
"""


def _windows(spark, d):
    b = derive.table(spark, d, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return fr.rolling_windows(b)


@query("shf1_rolling_windows", with_cte(_WINSQL) + "SELECT * FROM win")
def shf1(spark, d):
    return _windows(spark, d)


@query(
    "shf1_rows_per_window_role",
    with_cte(_WINSQL)
    + """SELECT window_index, CASE WHEN o_orderdate < valid_start - INTERVAL 24 HOUR THEN 'train' WHEN o_orderdate < test_start - INTERVAL 24 HOUR THEN 'valid' ELSE 'test' END AS role,
 count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN win ON o_orderdate >= train_start - INTERVAL 24 HOUR AND o_orderdate < test_end - INTERVAL 24 HOUR GROUP BY ALL""",
)
def shf1_roles(spark, d):
    o = derive.table(spark, d, "orders").select(F.col("o_orderdate").alias("ds"), "o_totalprice")
    return fr.window_roles(o, _windows(spark, d), shift_hours=24).groupBy("window_index", "role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "flt9_first_training_slice",
    with_cte(_WINSQL)
    + "SELECT o_orderkey FROM orders, win WHERE window_index = 0 AND o_orderdate >= train_start AND o_orderdate < valid_start",
)
def flt9(spark, d):
    o = derive.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ds"))
    return fr.first_training_slice(o, _windows(spark, d)).select("o_orderkey")


@query(
    "shf13_stride_dates",
    with_cte(_WINSQL)
    + """, s AS (SELECT window_index, unnest(generate_series(test_start, test_end - INTERVAL 24 HOUR, INTERVAL 24 HOUR)) AS origin FROM win)
SELECT window_index, CAST(row_number() OVER (PARTITION BY window_index ORDER BY origin) - 1 AS INT) AS stride, origin FROM s""",
)
def shf13(spark, d):
    return fr.stride_dates(_windows(spark, d))


@query(
    "shf2_allowed_shift_days",
    """WITH b AS (SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) AS span FROM orders)
SELECT CAST(i AS INT) AS days FROM b, LATERAL (SELECT unnest(range(1, span + 1)) AS i) WHERE i % 7 <> 0 AND i % 30 <> 0""",
)
def shf2(spark, d):
    span = derive.table(spark, d, "orders").agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span")
    )
    days = span.select(F.explode(F.sequence(F.lit(1), F.col("span"))).alias("days"))
    return days.where(fr.is_allowed_shift(F.col("days"), [7, 30]))


_PANEL2 = """
p2 AS (SELECT tso, unique_id, ds, y, y * 2 + hour(ds) AS forecast_a, y + 3 AS hist_b FROM pn)
"""


def _panel2(spark, d):
    return derive.panel(spark, d).select(
        *SERIES, "ds", "y", (F.col("y") * 2 + F.hour("ds")).alias("forecast_a"), (F.col("y") + 3).alias("hist_b")
    )


@query(
    "win8_shifted_dataset",
    with_cte(PN, _PANEL2, _EASTER)
    + """, s AS (SELECT tso, unique_id, ds, lead(y, 14) OVER w AS y, lead(forecast_a, 14) OVER w AS forecast_a, hist_b, ds + INTERVAL 14 HOUR AS tt FROM p2
 WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds))
SELECT tso, unique_id, ds, y, forecast_a, hist_b, CAST(hour(tt) AS INT) AS hour, CAST(day(tt) AS INT) AS day, CAST(month(tt) AS INT) AS month,
 CAST(isodow(tt) >= 6 AS INT) AS is_weekend, 0 AS is_holiday, CAST(isodow(tt) < 6 AS INT) AS is_workday FROM s WHERE y IS NOT NULL""",
)
def win8(spark, d):
    return fr.shifted_dataset(_panel2(spark, d), SERIES, 14, ["forecast_a"])


_RN = """
rn AS (SELECT *, row_number() OVER (PARTITION BY tso, unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY tso, unique_id) AS n FROM p2)
"""


@query(
    "shf3_circular_shift",
    with_cte(PN, _PANEL2, _RN)
    + """SELECT a.tso, a.unique_id, a.ds, a.y, b.forecast_a, b.hist_b FROM rn a JOIN rn b ON a.tso = b.tso AND a.unique_id = b.unique_id AND b.i = (a.i + 240) % least(500, a.n)""",
)
def shf3(spark, d):
    return fr.circular_shift(_panel2(spark, d), SERIES, ["forecast_a", "hist_b"], 240, 500)


@query(
    "shf4_circular_shift_blocks",
    with_cte(PN, _PANEL2, _RN)
    + """, bk AS (SELECT *, CAST(i >= 500 AS INT) AS blk, CASE WHEN i >= 500 THEN i - 500 ELSE i END AS j FROM rn),
bc AS (SELECT *, count(*) OVER (PARTITION BY tso, unique_id, blk) AS t FROM bk)
SELECT a.tso, a.unique_id, a.ds, a.y, b.forecast_a, b.hist_b FROM bc a JOIN bc b ON a.tso = b.tso AND a.unique_id = b.unique_id AND a.blk = b.blk AND b.j = (a.j + 72) % a.t""",
)
def shf4(spark, d):
    return fr.circular_shift_blocks(_panel2(spark, d), SERIES, ["forecast_a", "hist_b"], 72, 500)


_BEFORE = "2024-01-21 00:00:00"
_SCALER = f"sc AS (SELECT tso, unique_id, avg(y) AS centre, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS s FROM pn WHERE ds < TIMESTAMP '{_BEFORE}' GROUP BY ALL)"


@query(
    "shf5_standard_scaler",
    with_cte(PN, _SCALER)
    + "SELECT tso, unique_id, ds, round((y - centre) / s, 8) AS scaled, y FROM pn JOIN sc USING (tso, unique_id)",
)
def shf5(spark, d):
    p = derive.panel(spark, d)
    sc = fr.standard_scaler(p, SERIES, F.col("ds") < F.lit(_BEFORE).cast("timestamp"), "y")
    out = fr.scale(p.withColumn("scaled", F.col("y")), sc, SERIES, "scaled")
    back = fr.scale(out.withColumn("y", F.col("scaled")), sc, SERIES, "y", inverse=True)
    return back.select(*SERIES, "ds", F.round("scaled", 8).alias("scaled"), F.round("y", 8).alias("y"))


@query(
    "shf6_lag_design",
    with_cte(PN, _PANEL2)
    + """SELECT tso, unique_id, ds, y, forecast_a, hist_b, lag(y, 1) OVER w AS "y_lag-1", lag(y, 24) OVER w AS "y_lag-24", lag(hist_b, 2) OVER w AS "hist_b_lag-2", lead(forecast_a, 3) OVER w AS "forecast_a_lead+3"
FROM p2 WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)""",
)
def shf6(spark, d):
    return fr.lag_design(_panel2(spark, d), SERIES, [1, 24], {"hist_b": [2]}, {"forecast_a": [3]})


@query(
    "shf12_alignment_check",
    with_cte(PN, PR)
    + """SELECT tso, unique_id, ds, 'missing' AS problem FROM pn WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.tso = pn.tso AND pr.unique_id = pn.unique_id AND pr.ds = pn.ds AND pr.model = 'naive' AND y_pred > 0)""",
)
def shf12(spark, d):
    got = derive.predictions(spark, d).where("model = 'naive' AND y_pred > 0")
    return fr.alignment_errors(got, derive.panel(spark, d), [*SERIES, "ds"])


@query(
    "shf14_inference_frames",
    with_cte(PN, _PANEL2)
    + """, og AS (SELECT unnest(generate_series(date_trunc('day', lo) + INTERVAL 48 HOUR, hi, INTERVAL 24 HOUR)) AS origin FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM p2)),
fu AS (SELECT origin, tso, unique_id, count(*) AS n FROM p2 JOIN og ON ds >= origin + INTERVAL 14 HOUR AND ds < origin + INTERVAL 38 HOUR GROUP BY ALL),
ct AS (SELECT min(origin) AS cut FROM fu WHERE n < 24)
SELECT tso, unique_id, origin, ds, 'history' AS part, NULL::INT AS horizon, forecast_a, y FROM p2 JOIN og ON ds >= origin - INTERVAL 48 HOUR AND ds < origin, ct WHERE cut IS NULL OR origin < cut
UNION ALL SELECT tso, unique_id, origin, ds, 'future', CAST(date_diff('hour', origin + INTERVAL 14 HOUR, ds) + 1 AS INT), forecast_a, y FROM p2 JOIN og ON ds >= origin + INTERVAL 14 HOUR AND ds < origin + INTERVAL 38 HOUR, ct WHERE cut IS NULL OR origin < cut""",
)
def shf14(spark, d):
    panel = _panel2(spark, d)
    bounds = panel.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    origins = bounds.select(F.explode(F.expr("sequence(date_trunc('day', lo) + INTERVAL 48 HOURS, hi, INTERVAL 24 HOURS)")).alias("origin"))
    return fr.inference_frames(panel, SERIES, origins, ["forecast_a"], 48, 24, 14)


@query(
    "shf15_dataset_compatibility",
    with_cte(PN)
    + """SELECT 'extended' AS status, min(ds) AS first_new FROM pn WHERE ds >= TIMESTAMP '2024-01-25 00:00:00'
UNION ALL SELECT 'compatible', NULL UNION ALL SELECT 'incompatible', NULL""",
)
def shf15(spark, d):
    p = derive.panel(spark, d)
    old = p.where("ds < '2024-01-25'")
    changed = p.withColumn("y", F.col("y") + 1)
    args = ([*SERIES, "ds"], ["y"])
    return (
        fr.dataset_compatibility(old, p, *args)
        .unionByName(fr.dataset_compatibility(p, p, *args))
        .unionByName(fr.dataset_compatibility(p, changed, *args))
    )


# ridge on one lag and the hour, in closed form; two slopes per series
_RIDGE = """
dz AS (SELECT tso, unique_id, ds, y AS t, lag(y, 24) OVER w AS a, CAST(hour(ds) AS DOUBLE) AS b FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
tr AS (SELECT tso, unique_id, avg(a) AS ma, avg(b) AS mb, avg(t) AS mt, covar_pop(a, a) * count(*) + {alpha} AS aa, covar_pop(b, b) * count(*) + {alpha} AS bb,
  covar_pop(a, b) * count(*) AS ab, covar_pop(a, t) * count(*) AS at_, covar_pop(b, t) * count(*) AS bt FROM dz WHERE a IS NOT NULL AND ds < TIMESTAMP '2024-01-21' GROUP BY ALL),
cf AS (SELECT *, (bb * at_ - ab * bt) / (aa * bb - ab * ab) AS wa, (aa * bt - ab * at_) / (aa * bb - ab * ab) AS wb FROM tr)
"""


def _design(spark, d):
    return (
        fr.lag_design(derive.panel(spark, d), SERIES, [24])
        .withColumn("h", F.hour("ds").cast("double"))
        .dropna(subset=["y_lag-24"])
    )


@query(
    "shf7_ridge",
    with_cte(PN, _RIDGE.format(alpha="500.0"))
    + "SELECT tso, unique_id, ds, 'ridge' AS model, 1 AS horizon, round(mt + wa * (a - ma) + wb * (b - mb), 6) AS y_pred FROM dz JOIN cf USING (tso, unique_id) WHERE a IS NOT NULL AND ds >= TIMESTAMP '2024-01-21'",
)
def shf7(spark, d):
    rows = _design(spark, d)
    x = ["y_lag-24", "h"]
    coef = mo.fit_linear(rows.where("ds < '2024-01-21'"), SERIES, x, ["y"], [("ridge", 500.0, 0.0)])
    return _r(mo.predict_linear(rows.where("ds >= '2024-01-21'"), coef, SERIES, x), "y_pred", n=6)


@query(
    "shf8_seasonal_least_squares",
    with_cte(PN, _RIDGE.format(alpha="0.0"))
    + "SELECT tso, unique_id, ds, 'seasonal' AS model, 1 AS horizon, round(mt + wa * (a - ma) + wb * (b - mb), 6) AS y_pred FROM dz JOIN cf USING (tso, unique_id) WHERE a IS NOT NULL AND ds >= TIMESTAMP '2024-01-21'",
)
def shf8(spark, d):
    rows = _design(spark, d)
    x = ["y_lag-24", "h"]
    coef = mo.fit_linear(rows.where("ds < '2024-01-21'"), SERIES, x, ["y"], [("seasonal", 0.0, 0.0)])
    return _r(mo.predict_linear(rows.where("ds >= '2024-01-21'"), coef, SERIES, x), "y_pred", n=6)


# LASSO with one feature has a closed form: soft threshold of the covariance
@query(
    "shf7_lasso_elastic_net",
    with_cte(PN)
    + """, dz AS (SELECT tso, unique_id, ds, y AS t, lag(y, 24) OVER w AS a FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
tr AS (SELECT tso, unique_id, avg(a) AS ma, avg(t) AS mt, covar_pop(a, a) AS aa, covar_pop(a, t) AS at_ FROM dz WHERE a IS NOT NULL AND ds < TIMESTAMP '2024-01-21' GROUP BY ALL),
md AS (SELECT *, unnest(['lasso', 'elasticnet']) AS model, unnest([20.0, 40.0]) AS alpha, unnest([1.0, 0.5]) AS ratio FROM tr),
cf AS (SELECT *, sign(at_) * greatest(abs(at_) - alpha * ratio, 0) / (aa + alpha * (1 - ratio)) AS w FROM md)
SELECT tso, unique_id, ds, model, 1 AS horizon, round(mt + w * (a - ma), 6) AS y_pred FROM dz JOIN cf USING (tso, unique_id) WHERE a IS NOT NULL AND ds >= TIMESTAMP '2024-01-21'""",
)
def shf7_lasso(spark, d):
    rows = _design(spark, d)
    x = ["y_lag-24"]
    coef = mo.fit_linear(
        rows.where("ds < '2024-01-21'"), SERIES, x, ["y"], [("lasso", 20.0, 1.0), ("elasticnet", 40.0, 0.5)]
    )
    return _r(mo.predict_linear(rows.where("ds >= '2024-01-21'"), coef, SERIES, x), "y_pred", n=6)


@query("shf7_direct_multi_horizon")
def shf7_direct(spark, d):
    p = derive.panel(spark, d)
    lags = [f"y_lag-{k}" for k in range(1, 25)]
    rows = mo.direct_targets(fr.lag_design(p, SERIES, list(range(1, 25))), SERIES, 24).dropna(subset=lags)
    targets = [f"y+{h}" for h in range(1, 25)]
    coef = mo.fit_linear(rows.where("ds < '2024-01-20'"), SERIES, lags, targets, [("ridge", 10.0, 0.0)])
    out = mo.predict_linear(rows.where("ds >= '2024-01-21' AND hour(ds) = 0"), coef, SERIES, lags)
    return _r(out, "y_pred", n=4)


@query("shf9_boosted_trees")
def shf9(spark, d):
    rows = _design(spark, d).withColumn("valid", F.col("ds") >= F.lit("2024-01-18").cast("timestamp"))
    x = ["y_lag-24", "h"]
    out = mo.boosted_trees(
        rows.where("ds < '2024-01-21'"), rows.where("ds >= '2024-01-21'"), x, "y", trees=5, depth=3, validation="valid"
    )
    return out.select(*SERIES, "ds", F.round("y_pred", 4).alias("y_pred"))


_SWEEPW = """
wn AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-25'),
 (1, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-29')) t(window_index, train_start, valid_start, test_start, test_end)),
"""

def _sweep_windows(spark):
    rows = [(0, "2024-01-01", "2024-01-15", "2024-01-18", "2024-01-25"), (1, "2024-01-05", "2024-01-19", "2024-01-22", "2024-01-29")]
    names = ("train_start", "valid_start", "test_start", "test_end")
    return spark.createDataFrame(rows, "window_index int, a string, b string, c string, d string").select(
        "window_index", *[F.col(s).cast("timestamp").alias(n) for s, n in zip("abcd", names)]
    )


def _horizon_rows(spark, d):
    """Origins with the lags before them as features; horizons 1 and 6 as keys."""
    rows = mo.direct_targets(fr.lag_design(derive.panel(spark, d), SERIES, [1, 24]), SERIES, 6)
    rows = rows.dropna(subset=["y_lag-24"]).withColumn("h", F.hour("ds").cast("double"))
    return bo.horizons(rows, {1: "y+1", 6: "y+6"})


@query(
    "shf9_boosted_stumps_by_window_and_horizon",
    with_cte(PN)
    + ","
    + _SWEEPW
    + """dz AS (SELECT tso, unique_id, ds, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b, hour(ds)::DOUBLE AS h, y AS y1, lead(y, 5) OVER w AS y6
  FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
hz AS (SELECT tso, unique_id, ds, a, b, h, 1 AS horizon, y1 AS y FROM dz WHERE b IS NOT NULL UNION ALL SELECT tso, unique_id, ds, a, b, h, 6, y6 FROM dz WHERE b IS NOT NULL),
rl AS (SELECT hz.*, window_index, CASE WHEN ds < valid_start THEN 'train' WHEN ds < test_start THEN 'valid' ELSE 'test' END AS role FROM hz JOIN wn ON ds >= train_start AND ds < test_end),
tr AS (SELECT * FROM rl WHERE role = 'train' AND y IS NOT NULL),
bs AS (SELECT window_index, tso, unique_id, horizon, quantile_disc(y, 0.5)::DOUBLE AS base FROM tr GROUP BY ALL),
xs AS (SELECT window_index, tso, unique_id, horizon, y, unnest([0, 1, 2]) AS f, unnest([a, b, h])::DOUBLE AS x FROM tr),
qs AS (SELECT window_index, tso, unique_id, horizon, f, quantile_disc(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM xs GROUP BY ALL),
ds_ AS (SELECT DISTINCT window_index, tso, unique_id, horizon, f, unnest(q) AS cut FROM qs),
st AS (SELECT e.window_index, e.tso, e.unique_id, e.horizon, e.f, e.cut, count(*) FILTER (x <= cut) AS nl, count(*) AS n, coalesce(sum(sign(y - base)) FILTER (x <= cut), 0) AS gl, sum(sign(y - base)) AS g
  FROM ds_ e JOIN xs USING (window_index, tso, unique_id, horizon, f) JOIN bs USING (window_index, tso, unique_id, horizon) GROUP BY ALL),
gn AS (SELECT *, gl::DOUBLE * gl / nl + (g - gl)::DOUBLE * (g - gl) / (n - nl) - g::DOUBLE * g / n AS gain FROM st WHERE nl >= 20 AND n - nl >= 20),
sp AS (SELECT window_index, tso, unique_id, horizon, f, cut FROM (SELECT *, row_number() OVER (PARTITION BY window_index, tso, unique_id, horizon ORDER BY gain DESC, f, cut) AS r FROM gn WHERE gain > 1e-9) WHERE r = 1),
nd AS (SELECT rl.*, base, coalesce(CASE f WHEN 0 THEN a WHEN 1 THEN b ELSE h END > cut, false) AS side FROM rl JOIN bs USING (window_index, tso, unique_id, horizon) LEFT JOIN sp USING (window_index, tso, unique_id, horizon)),
lf AS (SELECT window_index, tso, unique_id, horizon, side, quantile_disc(y - base, 0.5)::DOUBLE AS leaf FROM nd WHERE role = 'train' AND y IS NOT NULL GROUP BY ALL)
SELECT window_index, tso, unique_id, CAST(horizon AS INT) AS horizon, ds, round(base + coalesce(leaf, 0) * 0.5, 6) AS y_pred FROM nd LEFT JOIN lf USING (window_index, tso, unique_id, horizon, side) WHERE role = 'test'""",
)
def shf9_stumps(spark, d):
    out = bo.rolling_boosted(
        _horizon_rows(spark, d), _sweep_windows(spark), [*SERIES, "horizon"], ["y_lag-1", "y_lag-24", "h"], rounds=1, depth=1, bins=8, rate=0.5
    )
    return _r(out.select("window_index", *SERIES, "horizon", "ds", "y_pred"), "y_pred", n=6)


@query("shf9_boosted_trees_rolling")
def shf9_rolling(spark, d):
    """Several rounds have no SQL form; the operator is compared with a plain loop in the tests."""
    out = bo.rolling_boosted(
        _horizon_rows(spark, d), _sweep_windows(spark), [*SERIES, "horizon"], ["y_lag-1", "y_lag-24", "h"], rounds=4, depth=2, bins=16, rate=0.3, patience=2
    )
    return _r(out.select("window_index", *SERIES, "horizon", "ds", "y_pred"), "y_pred", n=6)


@query(
    "shf10_intermittent_demand",
    with_cte(PN)
    + """, og AS (SELECT DISTINCT tso, unique_id, date_trunc('day', ds) + INTERVAL 1 DAY AS origin FROM pn),
hs_ AS (SELECT og.tso, og.unique_id, origin, list(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ds) AS ps, list(y::DOUBLE ORDER BY ds) FILTER (WHERE y > 0) AS ys
 FROM og JOIN pn ON pn.tso = og.tso AND pn.unique_id = og.unique_id AND pn.ds < origin GROUP BY ALL)
SELECT tso, unique_id, origin, round(list_reduce(ps, lambda a, x: (0.9::DOUBLE * a + 0.1::DOUBLE * x)::DOUBLE) * coalesce(list_reduce(ys, lambda a, x: (0.8::DOUBLE * a + 0.2::DOUBLE * x)::DOUBLE), 0), 6) AS forecast FROM hs_""",
)
def shf10(spark, d):
    out = mo.intermittent_demand(derive.panel(spark, d), SERIES, alpha_d=0.2, alpha_p=0.1)
    return _r(out, "forecast", n=6)


@query(
    "shf11_latest_window_wins",
    with_cte(PN, PR)
    + """, o AS (SELECT tso, unique_id, model, ds, window_index, y_pred - 10 AS y_pred FROM pr UNION ALL SELECT tso, unique_id, model, ds, window_index + 1, y_pred - 12 FROM pr WHERE hour(ds) < 12)
SELECT tso, unique_id, model, ds, CAST(max(window_index) AS INT) AS window_index, greatest(arg_max(y_pred, window_index), 0) AS y_pred FROM o GROUP BY ALL""",
)
def shf11(spark, d):
    p = derive.predictions(spark, d).select(*KEYS, "ds", "window_index", "y_pred")
    a = p.withColumn("y_pred", F.col("y_pred") - 10)
    b = p.where("hour(ds) < 12").withColumns(
        {"window_index": F.col("window_index") + 1, "y_pred": F.col("y_pred") - 12}
    )
    return mo.finalize(a.unionByName(b), KEYS)




@query(
    "shf16_parameter_sweep",
    with_cte(PN)
    + ","
    + _SWEEPW
    + """dz AS (SELECT tso, unique_id, ds, y AS t, lag(y, 24) OVER w AS a FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
tr AS (SELECT window_index, tso, unique_id, avg(a) AS ma, avg(t) AS mt, covar_pop(a, a) * count(*) AS aa, covar_pop(a, t) * count(*) AS at_
  FROM dz JOIN wn ON ds >= train_start AND ds < valid_start WHERE a IS NOT NULL GROUP BY ALL),
md AS (SELECT *, unnest(['ridge_alpha_1p0', 'ridge_alpha_900p0']) AS model, unnest([1.0, 900.0]) AS alpha FROM tr)
SELECT md.window_index, md.tso, md.unique_id, ds, model, 1 AS horizon, round(mt + at_ / (aa + alpha) * (a - ma), 6) AS y_pred
FROM md JOIN wn USING (window_index) JOIN dz ON dz.tso = md.tso AND dz.unique_id = md.unique_id AND ds >= test_start AND ds < test_end""",
)
def shf16(spark, d):
    windows = _sweep_windows(spark)
    rows = fr.lag_design(derive.panel(spark, d), SERIES, [24])
    out = mo.sweep(
        rows, windows, SERIES, ["y_lag-24"], ["y"],
        [("ridge_alpha_1p0", 1.0, 0.0), ("ridge_alpha_900p0", 900.0, 0.0)],
    )
    return _r(out, "y_pred", n=6)


# ridge of up to three lags: cross products of the rows that have ``size`` lags inside the window, adjugate of the 3 x 3 matrix
_NESTED = """
og AS (SELECT tso, unique_id, ds, y AS t1, lead(y, 1) OVER w AS t2, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 3) OVER w AS c FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
sz AS (SELECT unnest([1, 2, 3]) AS size),
tr AS (SELECT window_index, size, tso, unique_id, a, CASE WHEN size > 1 THEN b ELSE 0 END AS b, CASE WHEN size > 2 THEN c ELSE 0 END AS c, unnest([1, 2]) AS horizon, unnest([t1, t2]) AS t
  FROM og JOIN wn ON ds < valid_start - INTERVAL 1 HOUR CROSS JOIN sz
  WHERE ds >= train_start + to_hours(CAST(size AS INT)) AND t2 IS NOT NULL AND (size > 2 OR a IS NOT NULL) AND (size < 2 OR b IS NOT NULL) AND (size < 3 OR c IS NOT NULL)),
mo AS (SELECT window_index, size, tso, unique_id, horizon, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(t) AS mt,
  covar_pop(a, a) * count(*) AS aa, covar_pop(a, b) * count(*) AS ab, covar_pop(a, c) * count(*) AS ac, covar_pop(b, b) * count(*) AS bb, covar_pop(b, c) * count(*) AS bc, covar_pop(c, c) * count(*) AS cc,
  covar_pop(a, t) * count(*) AS at_, covar_pop(b, t) * count(*) AS bt, covar_pop(c, t) * count(*) AS ct FROM tr GROUP BY ALL),
md AS (SELECT * REPLACE (aa + alpha AS aa, bb + alpha AS bb, cc + alpha AS cc) FROM (SELECT *, unnest(['ridge_alpha_5p0', 'ridge_alpha_900p0']) AS model, unnest([5.0, 900.0]) AS alpha FROM mo)),
aj AS (SELECT *, bb * cc - bc * bc AS p, ac * bc - ab * cc AS q, ab * bc - ac * bb AS r, aa * cc - ac * ac AS s, ab * ac - aa * bc AS u, aa * bb - ab * ab AS v FROM md),
dt AS (SELECT *, aa * p + ab * q + ac * r AS det FROM aj),
cf AS (SELECT window_index, size, tso, unique_id, horizon, model, ma, mb, mc, mt, (p * at_ + q * bt + r * ct) / det AS wa, (q * at_ + s * bt + u * ct) / det AS wb, (r * at_ + u * bt + v * ct) / det AS wc FROM dt)
SELECT window_index, tso, unique_id, og.ds + to_hours(CAST(horizon - 1 AS INT)) AS ds, model, CAST(size AS INT) AS input_size, CAST(horizon AS INT) AS horizon,
  round(mt + wa * (a - ma) + CASE WHEN size > 1 THEN wb * (b - mb) ELSE 0 END + CASE WHEN size > 2 THEN wc * (c - mc) ELSE 0 END, 5) AS y_pred
FROM cf JOIN wn USING (window_index) JOIN og USING (tso, unique_id)
WHERE og.ds >= test_start AND og.ds < test_end AND (epoch(og.ds) - epoch(test_start)) % 7200 = 0 AND og.ds + to_hours(CAST(horizon - 1 AS INT)) < test_end
"""


@query("shf16_nested_input_sizes", with_cte(PN) + "," + _SWEEPW + _NESTED)
def shf16_nested(spark, d):
    out = sw.linear_sweep(
        derive.panel(spark, d), _sweep_windows(spark), SERIES, sw.Design((1, 2, 3), horizon=2),
        [("ridge_alpha_5p0", 5.0, 0.0), ("ridge_alpha_900p0", 900.0, 0.0)],
    )
    return _r(out, "y_pred", n=5)


@query(
    "shf16_intermittent_sweep",
    with_cte(PN)
    + ","
    + _SWEEPW
    + """og AS (SELECT DISTINCT window_index, tso, unique_id, train_start, date_trunc('day', ds) AS origin FROM pn JOIN wn ON ds >= test_start AND ds < test_end),
hs_ AS (SELECT window_index, og.tso, og.unique_id, origin, list(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ds) AS ps, list(y::DOUBLE ORDER BY ds) FILTER (WHERE y > 0) AS ys
 FROM og JOIN pn ON pn.tso = og.tso AND pn.unique_id = og.unique_id AND pn.ds < origin AND pn.ds >= train_start GROUP BY ALL),
pr_ AS (SELECT * EXCLUDE (ps, ys), 'croston_tsb_ad0p1_ap0p3' AS model, list_reduce(ps, lambda a, x: (0.7::DOUBLE * a + 0.3::DOUBLE * x)::DOUBLE) * coalesce(list_reduce(ys, lambda a, x: (0.9::DOUBLE * a + 0.1::DOUBLE * x)::DOUBLE), 0) AS f FROM hs_
 UNION ALL SELECT * EXCLUDE (ps, ys), 'croston_tsb_ad0p2_ap0p1', list_reduce(ps, lambda a, x: (0.9::DOUBLE * a + 0.1::DOUBLE * x)::DOUBLE) * coalesce(list_reduce(ys, lambda a, x: (0.8::DOUBLE * a + 0.2::DOUBLE * x)::DOUBLE), 0) FROM hs_)
SELECT window_index, tso, unique_id, origin + to_hours(CAST(h AS INT)) AS ds, model, CAST(h + 1 AS INT) AS horizon, round(f, 6) AS y_pred
FROM pr_, range(24) t(h)""",
)
def shf16_intermittent(spark, d):
    out = sw.intermittent_sweep(derive.panel(spark, d), _sweep_windows(spark), SERIES, [(0.1, 0.3), (0.2, 0.1)])
    return _r(out.drop("input_size"), "y_pred", n=6)


@query("shf16_tree_sweep")
def shf16_trees(spark, d):
    """No SQL form; the tests compare one arm with the trees fitted alone."""
    out = sw.tree_sweep(
        derive.panel(spark, d), _sweep_windows(spark), SERIES, sw.Design((1, 24), horizon=2), [20], rounds=1, depth=2, bins=8, rate=0.5
    )
    return _r(out, "y_pred", n=6)
