"""Queries of the attribution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import attribution as at, clusters as cl
from tidegrid.plans import derive
from tidegrid.plans.derive import with_cte
from tidegrid.plans.q_eval import _r
from tidegrid.plans.registry import query

FEATURES = [
    "y_lag1", "y_lag2", "hist_exog_production_gas_lag-1", "hist_exog_production_gas_lag-2", "hist_exog_runlength_zero",
    "futr_exog_wind_forecast_total", "futr_exog_pv_forecast_de", "futr_exog_hour", "hist_exog_cross_border_pl",
    "futr_exog_day_ahead_price_de", "stat_exog_direction_0", "hist_exog_data_driven_n", "futr_exog_residual_load_forecast",
]
_GROUP_SQL = """CASE WHEN feature LIKE 'stat%' THEN 'static_covariates' WHEN feature LIKE 'y_lag%' THEN '{b}' WHEN feature LIKE '%_hour' THEN 'calendar'
 WHEN feature LIKE '%runlength%' THEN 'runlength' WHEN feature LIKE '%data_driven%' THEN 'data_driven' WHEN feature LIKE '%cross_border%' THEN '{cb}'
 WHEN feature LIKE '%day_ahead%' THEN 'day_ahead_price' WHEN feature LIKE '%wind%' OR feature LIKE '%pv%' THEN 'wind_pv' ELSE 'production_consumption' END"""
_FL = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
_AT = f"""
att AS (SELECT concat('T', l_suppkey % 4) AS tso, CASE l_linestatus WHEN 'F' THEN 'down' ELSE 'up' END AS direction, CAST(year(l_shipdate) - 1995 AS INT) AS win,
 CAST(dayofyear(l_shipdate) AS INT) AS stride, CAST(l_orderkey % 24 + 1 AS INT) AS horizon, {_FL}[l_partkey % 13 + 1] AS feature,
 CASE WHEN l_linenumber <= 3 THEN 'hist' ELSE 'futr' END AS part, round(sum(l_extendedprice * (l_discount - 0.045)) / 1000, 9) AS value FROM lineitem GROUP BY ALL),
atv AS (SELECT tso, direction, win, stride, horizon, feature, sum(value) AS value FROM att GROUP BY ALL)
"""
MODEL = ["tso"]
SAMPLE = ["tso", "direction", "win", "stride", "horizon"]


def attributions(spark, d):
    arr = "array(" + ", ".join(f"'{f}'" for f in FEATURES) + ")"
    li = derive.table(spark, d, "lineitem").selectExpr(
        "concat('T', l_suppkey % 4) AS tso",
        "CASE l_linestatus WHEN 'F' THEN 'down' ELSE 'up' END AS direction",
        "CAST(year(l_shipdate) - 1995 AS INT) AS win",
        "CAST(dayofyear(l_shipdate) AS INT) AS stride",
        "CAST(l_orderkey % 24 + 1 AS INT) AS horizon",
        f"element_at({arr}, CAST(l_partkey % 13 + 1 AS INT)) AS feature",
        "CASE WHEN l_linenumber <= 3 THEN 'hist' ELSE 'futr' END AS part",
        "l_extendedprice * (l_discount - 0.045D) AS v",
    )
    return li.groupBy(*SAMPLE, "feature", "part").agg(F.round(F.sum("v") / 1000, 9).alias("value"))


def _values(spark, d):
    return attributions(spark, d).groupBy(*SAMPLE, "feature").agg(F.sum("value").alias("value"))


_SHARE = """
lab AS (SELECT tso, direction, win, stride, horizon, {label} AS label, sum(abs(value)) AS a FROM atv GROUP BY ALL),
sh AS (SELECT *, coalesce(a / nullif(sum(a) OVER (PARTITION BY tso, direction, win, stride, horizon), 0), 0) AS s FROM lab),
ns AS (SELECT tso, direction, horizon, count(DISTINCT (win, stride)) AS n FROM atv GROUP BY ALL),
mean_ AS (SELECT sh.tso, sh.direction, sh.horizon, label, sum(s) / any_value(n) AS share, any_value(n) AS n_predictions FROM sh JOIN ns USING (tso, direction, horizon) GROUP BY ALL)
"""
_G = _GROUP_SQL.format(b="target_lags/basic", cb="cross_border")
_BLOCK = "CASE WHEN horizon <= 9 THEN 'early' WHEN horizon <= 17 THEN 'middle' ELSE 'late' END"


def _group_shares(spark, d):
    return at.shares(_values(spark, d), SAMPLE, at.feature_group(F.col("feature")), ["win", "stride"])


@query(
    "prj9_feature_groups",
    with_cte(_AT)
    + f"SELECT feature, {_G} AS feature_group, {_GROUP_SQL.format(b='basic', cb='basic')} AS feature_set, count(*) AS n FROM atv GROUP BY ALL",
)
def prj9(spark, d):
    known = ["basic", "day_ahead_price", "wind_pv", "production_consumption"]
    return _values(spark, d).groupBy(
        "feature", at.feature_group(F.col("feature")).alias("feature_group"), at.feature_set(F.col("feature"), known).alias("feature_set")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg12_group_shares",
    with_cte(_AT, _SHARE.format(label=_G)) + "SELECT tso, direction, horizon, label, round(share, 8) AS share, n_predictions FROM mean_",
)
def agg12(spark, d):
    return _r(_group_shares(spark, d), "share")


@query(
    "agg13_block_shares",
    with_cte(_AT, _SHARE.format(label=_G))
    + f"SELECT tso, direction, {_BLOCK} AS horizon_block, label, round(avg(share), 8) AS share, CAST(sum(n_predictions) AS BIGINT) AS n_predictions FROM mean_ GROUP BY ALL",
)
def agg13(spark, d):
    return _r(at.block_shares(_group_shares(spark, d), ["tso", "direction"]), "share")


@query(
    "win12_top_feature_shares",
    with_cte(_AT, _SHARE.format(label="feature"))
    + f""", bl AS (SELECT tso, direction, unnest(['overall', {_BLOCK}]) AS horizon_block, label, share, n_predictions FROM mean_),
m AS (SELECT tso, direction, horizon_block, label, avg(share) AS share, CAST(sum(n_predictions) AS BIGINT) AS n_predictions FROM bl GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tso, direction, horizon_block ORDER BY round(share, 10) DESC, label) AS INT) AS rank FROM m)
SELECT tso, direction, horizon_block, label, round(share, 8) AS share, n_predictions, rank FROM r WHERE rank <= 5""",
)
def win12(spark, d):
    s = at.shares(_values(spark, d), SAMPLE, F.col("feature"), ["win", "stride"])
    return _r(at.top_shares(s, ["tso", "direction"], 5), "share")


@query(
    "win14_leading_groups",
    with_cte(_AT, _SHARE.format(label=_G))
    + f""", b AS (SELECT tso, direction, {_BLOCK} AS hb, label, avg(share) AS share FROM mean_ GROUP BY ALL),
m AS (SELECT tso, direction, label, avg(share) AS share FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tso, direction ORDER BY share DESC, label) AS rk FROM m),
p AS (SELECT tso, direction, max(CASE WHEN rk = 1 THEN label || ' (' || CAST(round(share * 100) AS INT) || '%)' END) AS first, max(CASE WHEN rk = 2 THEN label || ' (' || CAST(round(share * 100) AS INT) || '%)' END) AS second,
 max(CASE WHEN rk = 3 THEN label || ' (' || CAST(round(share * 100) AS INT) || '%)' END) AS third,
 max(CASE WHEN rk <= 2 AND label IN ('production_consumption', 'target_lags/basic', 'runlength', 'data_driven') THEN 1 ELSE 0 END) AS st,
 max(CASE WHEN rk <= 2 AND label IN ('wind_pv', 'sce', 'day_ahead_price') THEN 1 ELSE 0 END) AS fc FROM r GROUP BY ALL)
SELECT tso, direction, first, second, third, CASE WHEN st = 1 AND fc = 1 THEN 'mixed state/forecast driven' WHEN st = 1 THEN 'system-state driven' WHEN fc = 1 THEN 'forecast driven' ELSE 'diffuse feature reliance' END AS interpretation FROM p""",
)
def win14(spark, d):
    return at.leading_groups(at.block_shares(_group_shares(spark, d), ["tso", "direction"]), ["tso", "direction"])


_STRIDE = """
hz AS (SELECT tso, direction, win, stride, horizon, feature, sum(value) AS v FROM att GROUP BY ALL),
sv AS (SELECT tso, direction, win, stride, feature, {agg} AS value FROM hz GROUP BY ALL)
"""
_IMP = """
av AS (SELECT tso, {slice} direction, feature, avg(value) AS v FROM sv GROUP BY ALL),
tt AS (SELECT tso, {slice} feature, sum(abs(v)) AS abs_combined, sum(v) AS signed_combined, sum(greatest(v, 0)) AS p, sum(greatest(-v, 0)) AS n FROM av GROUP BY ALL)
SELECT tso, {slice} feature, round(abs_combined, 9) AS abs_combined, round(abs_combined / sum(abs_combined) OVER (PARTITION BY tso {part}) * 100, 9) AS pct_of_total_abs, round(signed_combined, 9) AS signed_combined,
 round(signed_combined / abs_combined * 100, 9) AS net_ratio, round(p / abs_combined * 100, 9) AS pos_share, round(n / abs_combined * 100, 9) AS neg_share FROM tt"""
STRIDE = ["tso", "direction", "win", "stride"]
_IMPCOLS = ("abs_combined", "pct_of_total_abs", "signed_combined", "net_ratio", "pos_share", "neg_share")


@query("agg14_importance_overall", with_cte(_AT, _STRIDE.format(agg="sum(v)"), _IMP.format(slice="", part="").strip()))
def agg14(spark, d):
    s = at.stride_importance(attributions(spark, d), STRIDE, "signed")
    return _r(at.importance(s, MODEL), *_IMPCOLS, n=9)


@query(
    "agg14_agg31_importance_quarterly",
    with_cte(
        _AT, _STRIDE.format(agg="sum(abs(v))").replace("sv AS (SELECT tso, direction, win, stride", "sv AS (SELECT tso, CAST((stride - 1) // 92 + 1 AS INT) AS quarter, direction, win, stride"),
        _IMP.format(slice="quarter,", part=", quarter").strip(),
    ),
)
def agg14_q(spark, d):
    s = at.stride_importance(attributions(spark, d), STRIDE).withColumn("quarter", F.expr("CAST((stride - 1) div 92 + 1 AS INT)"))
    return _r(at.importance(s, MODEL, slices=["quarter"]), *_IMPCOLS, n=9)


_SC = "scl AS (SELECT feature, stddev_samp(value) AS std FROM atv GROUP BY feature)"


@query(
    "agg15_rescaled_strides",
    with_cte(_AT, _SC)
    + """, hz AS (SELECT tso, direction, win, stride, horizon, feature, sum(value) AS v FROM att WHERE part = 'futr' GROUP BY ALL)
SELECT tso, direction, win, stride, feature, round(sum(v) * greatest(any_value(std), 5), 9) AS value FROM hz JOIN scl USING (feature) GROUP BY ALL""",
)
def agg15(spark, d):
    a = attributions(spark, d)
    scaler = _values(spark, d).groupBy("feature").agg(F.stddev_samp("value").alias("std"))
    out = at.stride_importance(a, STRIDE, "signed", scaler, 5.0, parts=["futr"])
    return _r(out, "value", n=9)


@query(
    "agg16_horizon_stats",
    with_cte(_AT)
    + """SELECT tso, direction, horizon, feature, round(avg(value), 9) AS mean, round(avg(abs(value)), 9) AS mean_abs, round(avg(CASE WHEN value > 0 THEN 1 ELSE 0 END), 9) AS frac_pos, round(avg(CASE WHEN value < 0 THEN 1 ELSE 0 END), 9) AS frac_neg,
 round(quantile_cont(value, 0.1), 9) AS p10, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.75), 9) AS p75, round(quantile_cont(value, 0.9), 9) AS p90 FROM atv GROUP BY ALL""",
)
def agg16(spark, d):
    out = at.horizon_stats(_values(spark, d), ["tso", "direction"])
    return _r(out, "mean", "mean_abs", "frac_pos", "frac_neg", "p10", "p25", "p50", "p75", "p90", n=9)


@query(
    "agg16_agg31_top_per_horizon",
    with_cte(_AT)
    + """, st AS (SELECT tso, direction, horizon, feature, avg(abs(value)) AS mean_abs FROM atv GROUP BY ALL), sc_ AS (SELECT tso, horizon, feature, avg(mean_abs) AS s FROM st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tso, horizon ORDER BY s DESC, feature DESC) - 1 AS rank FROM sc_)
SELECT tso, direction, horizon, feature, round(mean_abs, 9) AS mean_abs, CAST(rank AS INT) AS rank FROM st JOIN r USING (tso, horizon, feature) WHERE rank < 3""",
)
def agg16_top(spark, d):
    s = at.horizon_stats(_values(spark, d), ["tso", "direction"])
    out = at.top_per_horizon(s, MODEL, "direction", 3)
    return _r(out.select("tso", "direction", "horizon", "feature", "mean_abs", "rank"), "mean_abs", n=9)


@query(
    "agg17_summary",
    with_cte(_AT, _SC)
    + """, pr_ AS (SELECT tso, win, stride, feature, sum(abs(value)) AS a FROM atv GROUP BY ALL)
SELECT tso, feature, round(avg(a), 9) AS mean_abs, round(quantile_cont(a, 0.5), 9) AS median_abs, round(avg(a) * any_value(std), 9) AS mean_abs_original, round(quantile_cont(a, 0.5) * any_value(std), 9) AS median_abs_original
FROM pr_ JOIN scl USING (feature) GROUP BY ALL""",
)
def agg17(spark, d):
    v = _values(spark, d)
    scaler = v.groupBy("feature").agg(F.stddev_samp("value").alias("std"))
    out = at.summary(v, MODEL, ["win", "stride"], scaler)
    return _r(_r(out, "mean_abs", "median_abs", n=9), "mean_abs_original", "median_abs_original", n=9)


@query(
    "agg18_average_over_windows",
    with_cte(_AT)
    + """, w AS (SELECT tso, feature, win, sum(abs(value)) AS weight FROM atv GROUP BY ALL) SELECT tso, feature, round(avg(weight), 9) AS weight FROM w GROUP BY ALL""",
)
def agg18(spark, d):
    w = _values(spark, d).groupBy("tso", "feature", "win").agg(F.sum(F.abs("value")).alias("weight"))
    return _r(at.average_tables(w, ["tso", "feature"], ["weight"]), "weight", n=9)


@query(
    "agg19_prj22_lag_importance",
    with_cte(_AT)
    + "SELECT tso, horizon, regexp_replace(feature, '_lag[+-]?[0-9]+$', '') AS feature, round(sum(abs(value)), 8) AS importance FROM atv GROUP BY ALL",
)
def agg19(spark, d):
    return _r(at.lag_importance(_values(spark, d), ["tso", "horizon"]), "importance", n=8)


@query(
    "agg30_set_importance",
    with_cte(_AT)
    + f""", c AS (SELECT tso, direction, horizon, feature, abs(avg(value)) AS m FROM atv GROUP BY ALL), p AS (SELECT tso, feature, avg(m) AS m FROM c GROUP BY ALL),
s AS (SELECT tso, {_GROUP_SQL.format(b='basic', cb='basic')} AS feature_set, count(*) AS n_features, sum(m) AS t FROM p GROUP BY ALL)
SELECT tso, feature_set, n_features, round(t, 9) AS mean_abs_total, round(t / sum(t) OVER (PARTITION BY tso) * 100, 9) AS pct_of_total FROM s""",
)
def agg30(spark, d):
    known = ["basic", "day_ahead_price", "wind_pv", "production_consumption"]
    out = at.set_importance(_values(spark, d), MODEL, ["direction", "horizon"], known)
    return _r(out, "mean_abs_total", "pct_of_total", n=9)


_CL = f"cl(feature, cluster) AS (SELECT unnest({_FL}), unnest([{', '.join(str(i % 3) for i in range(13))}]))"


@query(
    "sta21_profile_distance",
    with_cte(_AT)
    + """, c AS (SELECT tso, direction, horizon, feature, avg(value) AS v FROM atv GROUP BY ALL)
SELECT a.tso, a.feature, b.feature AS other, round(1 - corr(a.v, b.v), 9) AS distance FROM c a JOIN c b ON a.tso = b.tso AND a.direction = b.direction AND a.horizon = b.horizon AND a.feature < b.feature
GROUP BY ALL HAVING stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12""",
)
def sta21(spark, d):
    return _r(at.profile_distance(_values(spark, d), MODEL, ["direction", "horizon"]), "distance", n=9)


@query(
    "sta21_cluster_means",
    with_cte(_AT, _CL)
    + "SELECT tso, horizon, CAST(cluster AS INT) AS cluster, round(avg(value), 9) AS value, count(DISTINCT feature) AS n_features FROM atv JOIN cl USING (feature) GROUP BY ALL",
)
def sta21_means(spark, d):
    clusters = spark.createDataFrame([(f, i % 3) for i, f in enumerate(FEATURES)], "feature string, cluster int")
    return _r(at.cluster_means(_values(spark, d), clusters, ["tso", "horizon"]), "value", n=9)


def _groups_cte(n_clusters: int, cell: str) -> str:
    """The bisection step by step; a step splits the widest cluster of every model."""
    far = lambda rows, centre: f"SELECT m.tso, m.feature, round(sum((m.z - c.z) * (m.z - c.z)), 9) AS d FROM {rows} m JOIN {centre} c ON m.tso = c.tso AND m.cell = c.cell GROUP BY ALL"
    parts = [
        f"vm AS (SELECT tso, feature, {cell} AS cell, avg(value) AS v FROM atv GROUP BY ALL)",
        "vg AS (SELECT a.tso, a.feature, b.cell, coalesce(v, 0) AS v FROM (SELECT DISTINCT tso, feature FROM vm) a JOIN (SELECT DISTINCT tso, cell FROM vm) b USING (tso) LEFT JOIN vm USING (tso, feature, cell))",
        "vs AS (SELECT tso, feature, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM vg GROUP BY ALL HAVING stddev_pop(v) > 1e-12)",
        "z AS (SELECT tso, feature, cell, (v - mean) / (sd * sqrt(n)) AS z FROM vg JOIN vs USING (tso, feature))",
        "l0 AS (SELECT DISTINCT tso, feature, 0 AS cluster FROM z)",
    ]
    for i in range(1, n_clusters):
        parts += [
            f"r{i} AS (SELECT z.*, cluster FROM z JOIN l{i - 1} USING (tso, feature))",
            f"c{i} AS (SELECT tso, cluster, cell, avg(z) AS z FROM r{i} GROUP BY ALL)",
            f"f{i} AS (SELECT m.tso, m.feature, m.cluster, round(sum((m.z - c.z) * (m.z - c.z)), 9) AS d FROM r{i} m JOIN c{i} c ON m.tso = c.tso AND m.cell = c.cell AND m.cluster = c.cluster GROUP BY ALL)",
            f"e{i} AS (SELECT tso, cluster, round(sum(d), 9) AS sse FROM f{i} GROUP BY ALL)",
            f"w{i} AS (SELECT tso, cluster FROM (SELECT *, row_number() OVER (PARTITION BY tso ORDER BY sse DESC, cluster) AS k FROM e{i} WHERE sse > 0) WHERE k = 1)",
            f"m{i} AS (SELECT r{i}.* FROM r{i} JOIN w{i} USING (tso, cluster))",
            f"s{i} AS (SELECT tso, feature FROM (SELECT *, row_number() OVER (PARTITION BY tso ORDER BY d DESC, feature) AS k FROM f{i} JOIN w{i} USING (tso, cluster)) WHERE k = 1)",
            f"a{i} AS (SELECT m{i}.* FROM m{i} JOIN s{i} USING (tso, feature))",
            f"t{i} AS (SELECT tso, feature FROM (SELECT *, row_number() OVER (PARTITION BY tso ORDER BY d DESC, feature) AS k FROM ({far(f'm{i}', f'a{i}')})) WHERE k = 1)",
            f"b{i} AS (SELECT m{i}.* FROM m{i} JOIN t{i} USING (tso, feature))",
            f"n{i} AS (SELECT x.tso, x.feature, y.d < x.d AS far FROM ({far(f'm{i}', f'a{i}')}) x JOIN ({far(f'm{i}', f'b{i}')}) y USING (tso, feature))",
            f"g{i} AS (SELECT tso, cell, far, avg(z) AS z FROM m{i} JOIN n{i} USING (tso, feature) GROUP BY ALL)",
            f"h0_{i} AS (SELECT * FROM g{i} WHERE NOT far)",
            f"h1_{i} AS (SELECT * FROM g{i} WHERE far)",
            f"o{i} AS (SELECT x.tso, x.feature, y.d < x.d AS far FROM ({far(f'm{i}', f'h0_{i}')}) x JOIN ({far(f'm{i}', f'h1_{i}')}) y USING (tso, feature))",
            f"l{i} AS (SELECT tso, feature, CASE WHEN coalesce(far, false) THEN {i} ELSE cluster END AS cluster FROM l{i - 1} LEFT JOIN o{i} USING (tso, feature))",
        ]
    parts.append(f"grp AS (SELECT DISTINCT atv.tso, atv.feature, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM atv LEFT JOIN l{n_clusters - 1} USING (tso, feature))")
    return ",\n".join(parts)


_GRP = _groups_cte(4, "(direction, horizon)")


def _feature_groups(spark, d):
    return cl.feature_groups(_values(spark, d), MODEL, ["direction", "horizon"], 4)


@query("sta21_feature_groups", with_cte(_AT, _GRP) + "SELECT * FROM grp")
def sta21_groups(spark, d):
    return _feature_groups(spark, d)


@query(
    "sta21_group_means",
    with_cte(_AT, _GRP)
    + "SELECT tso, horizon, cluster, round(avg(value), 9) AS value, count(DISTINCT feature) AS n_features FROM atv JOIN grp USING (tso, feature) GROUP BY ALL",
)
def sta21_group_means(spark, d):
    out = at.cluster_means(_values(spark, d), _feature_groups(spark, d), ["tso", "horizon"], model=MODEL)
    return _r(out, "value", n=9)
