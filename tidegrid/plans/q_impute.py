"""Queries of the imputation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import impute as imp
from tidegrid.plans import derive
from tidegrid.plans.derive import HS, MT, with_cte
from tidegrid.plans.registry import query

OOS = "2024-01-20 00:00:00"


def _fit():
    return F.col("ts") < F.lit(OOS).cast("timestamp")


_GAP = """
ps AS (SELECT {k}, ts, value, row_number() OVER (PARTITION BY {k} ORDER BY ts) AS rn,
              count(value) OVER (PARTITION BY {k} ORDER BY ts) AS grp FROM {src}),
gp AS (SELECT *, CASE WHEN value IS NULL THEN
         sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, grp ORDER BY ts) ELSE 0 END AS gap_position,
         sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, grp) AS gap_total,
         last_value(value IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts) AS near FROM ps)
"""


@query(
    "imp1_gap_position",
    with_cte(HS, _GAP.format(k="series", src="hs"))
    + "SELECT series, ts, CAST(gap_position AS INT) AS gap_position FROM gp",
)
def imp1(spark, d):
    return imp.gap_position(derive.hourly(spark, d), ["series"]).select("series", "ts", "gap_position")


@query(
    "imp2_seasonal_median",
    with_cte(HS)
    + f"""SELECT h.series, h.ts, round(m.med, 8) AS seasonal_median, coalesce(m.n, 0) AS seasonal_count
FROM hs h LEFT JOIN (SELECT series, hour(ts) AS hh, isodow(ts) AS wd, quantile_cont(value, 0.5) FILTER (WHERE ts < TIMESTAMP '{OOS}') AS med,
   count(value) FILTER (WHERE ts < TIMESTAMP '{OOS}') AS n FROM hs GROUP BY ALL) m
 ON m.series = h.series AND m.hh = hour(h.ts) AND m.wd = isodow(h.ts)""",
)
def imp2(spark, d):
    out = imp.seasonal_fill(derive.hourly(spark, d), ["series"], ["hour", "weekday"], _fit())
    return out.select(
        "series", "ts", F.round("seasonal_median", 8).alias("seasonal_median"), "seasonal_count"
    )


_TIERS = f"""
fit AS (SELECT *, CASE WHEN ts < TIMESTAMP '{OOS}' THEN value END AS fv FROM {{src}}),
hm AS (SELECT {{k}}, hour(ts) AS hh, month(ts) AS mm, quantile_cont(fv, 0.5) AS m1, count(fv) AS n1 FROM fit GROUP BY ALL),
hw AS (SELECT {{k}}, hour(ts) AS hh, isodow(ts) AS wd, quantile_cont(fv, 0.5) AS m2, count(fv) AS n2 FROM fit GROUP BY ALL),
ho AS (SELECT {{k}}, hour(ts) AS hh, quantile_cont(fv, 0.5) AS m3, count(fv) AS n3 FROM fit GROUP BY ALL),
gl AS (SELECT {{k}}, coalesce(quantile_cont(fv, 0.5), quantile_cont(value, 0.5)) AS g FROM fit GROUP BY ALL),
tm AS (SELECT f.{{k}}, f.ts, f.value, m1, n1, m2, n2, m3, n3, g FROM fit f
   LEFT JOIN hm ON hm.{{k}} = f.{{k}} AND hm.hh = hour(f.ts) AND hm.mm = month(f.ts)
   LEFT JOIN hw ON hw.{{k}} = f.{{k}} AND hw.hh = hour(f.ts) AND hw.wd = isodow(f.ts)
   LEFT JOIN ho ON ho.{{k}} = f.{{k}} AND ho.hh = hour(f.ts)
   LEFT JOIN gl ON gl.{{k}} = f.{{k}})
"""


@query(
    "imp3_tiered_fill_next_tier",
    with_cte(HS, _TIERS.format(k="series", src="hs"))
    + """SELECT series, ts, round(CASE
 WHEN m2 IS NOT NULL AND n2 >= 3 THEN n2 / (n2 + 4.0) * m2 + (1 - n2 / (n2 + 4.0)) * coalesce(m3, g)
 WHEN m3 IS NOT NULL AND n3 >= 3 THEN n3 / (n3 + 4.0) * m3 + (1 - n3 / (n3 + 4.0)) * g
 WHEN m2 IS NOT NULL AND n2 > 0 THEN n2 / (n2 + 4.0) * m2 + (1 - n2 / (n2 + 4.0)) * coalesce(m3, g)
 WHEN m3 IS NOT NULL AND n3 > 0 THEN n3 / (n3 + 4.0) * m3 + (1 - n3 / (n3 + 4.0)) * g
 ELSE g END, 7) AS fill FROM tm""",
)
def imp3(spark, d):
    rule = imp.Rule("", gap=3, min_count=3, shrink_k=4.0)
    rows = derive.hourly(spark, d).withColumn("metric", F.lit("x"))
    out = imp.tiered_fill(rows, ["series"], [rule], _fit())
    return out.select("series", "ts", F.round("fill", 7).alias("fill"))


_HWFILL = """CASE WHEN m2 IS NOT NULL AND n2 >= {mc} THEN m2 WHEN m3 IS NOT NULL AND n3 >= {mc} THEN m3
 WHEN m2 IS NOT NULL AND n2 > 0 THEN m2 WHEN m3 IS NOT NULL AND n3 > 0 THEN m3 ELSE g END"""
_HMFILL = """CASE WHEN m1 IS NOT NULL AND n1 >= 24 THEN n1/(n1+12.0)*m1 + (1-n1/(n1+12.0))*g
 WHEN m2 IS NOT NULL AND n2 >= 24 THEN n2/(n2+12.0)*m2 + (1-n2/(n2+12.0))*g
 WHEN m3 IS NOT NULL AND n3 >= 24 THEN n3/(n3+12.0)*m3 + (1-n3/(n3+12.0))*g
 WHEN m1 IS NOT NULL AND n1 > 0 THEN n1/(n1+12.0)*m1 + (1-n1/(n1+12.0))*g
 WHEN m2 IS NOT NULL AND n2 > 0 THEN n2/(n2+12.0)*m2 + (1-n2/(n2+12.0))*g
 WHEN m3 IS NOT NULL AND n3 > 0 THEN n3/(n3+12.0)*m3 + (1-n3/(n3+12.0))*g ELSE g END"""


@query(
    "imp4_level_adjusted_fill",
    with_cte(HS, _TIERS.format(k="series", src="hs"), _GAP.format(k="series", src="hs"))
    + f""", f AS (SELECT tm.*, gp.gap_position, {_HWFILL.format(mc=3)} AS fill FROM tm JOIN gp USING (series, ts)),
r AS (SELECT *, coalesce(last_value(value - fill IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts), 0) AS res FROM f)
SELECT series, ts, round(fill + res * CASE WHEN value IS NULL THEN greatest(1 - gap_position / 5.0, 0) ELSE 1 END, 8) AS adjusted FROM r""",
)
def imp4(spark, d):
    rows = derive.hourly(spark, d).withColumn("metric", F.lit("x"))
    out = imp.tiered_fill(rows, ["series"], [imp.Rule("", min_count=3)], _fit())
    return imp.level_adjusted(out, ["series"], max_gap=5).select(
        "series", "ts", F.round("adjusted", 8).alias("adjusted")
    )


def _rule_query(name: str, rule: imp.Rule, sql_fill: str, level: bool = False, night: bool = False):
    fill = sql_fill
    long_fill = (
        f"({fill}) + coalesce(res * greatest(1 - gap_position / 168.0, 0), 0)" if level else fill
    )
    expr = f"coalesce(value, CASE WHEN gap_total <= {rule.gap} THEN near END, {long_fill})"
    if night:
        expr = f"CASE WHEN hour(ts) IN (21, 22, 23, 0, 1) THEN 0.0 ELSE {expr} END"
    sql = (
        with_cte(HS, _TIERS.format(k="series", src="hs"), _GAP.format(k="series", src="hs"))
        + f""", j AS (SELECT tm.*, gp.gap_position, gp.gap_total, gp.near FROM tm JOIN gp USING (series, ts)),
r AS (SELECT *, last_value(value - ({fill}) IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts) AS res FROM j)
SELECT series, ts, round({expr}, 8) AS imputed FROM r"""
    )

    @query(name, sql)
    def run(spark, d):
        rows = derive.hourly(spark, d).withColumn("metric", F.lit("x"))
        out = imp.impute(rows, [rule], _fit(), keys=["series"])
        return out.select("series", "ts", F.round("imputed", 8).alias("imputed"))

    return run


_rule_query("imp5_gap_rule", imp.Rule("", gap=3, min_count=2), _HWFILL.format(mc=2))
_rule_query(
    "imp6_imp12_sparse_level_night",
    imp.Rule(
        "", gap=3, tiers=(imp.HOUR_MONTH, imp.HOUR_WEEKDAY, imp.HOUR), min_count=24,
        shrink_k=12.0, shrink_to="global", level=True, night_zero=True,
    ),
    _HMFILL,
    level=True,
    night=True,
)
_rule_query("imp9_price_rule", imp.Rule("", gap=6), _HWFILL.format(mc=1))
_rule_query("imp11_consumption_rule", imp.Rule("", gap=3, min_count=8), _HWFILL.format(mc=8))
_rule_query("imp13_flow_rule", imp.Rule("", gap=10, min_count=8), _HWFILL.format(mc=8))


@query(
    "imp8_forward_and_zero_fill",
    with_cte(HS)
    + "SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts) AS forward, coalesce(value, 0) AS zero FROM hs",
)
def imp8(spark, d):
    out = imp.forward_fill(derive.hourly(spark, d), ["series"])
    return imp.zero_fill(out.withColumn("zero", F.col("value")), ["zero"]).select(
        "series", "ts", F.col("imputed").alias("forward"), "zero"
    )


@query(
    "prj21_pv_night_zero",
    with_cte(HS)
    + "SELECT series, ts, CASE WHEN hour(ts) IN (21, 22, 23, 0, 1) THEN 0.0 ELSE value END AS value FROM hs",
)
def prj21(spark, d):
    return imp.night_zero(derive.hourly(spark, d))


_ALL_GAP = (
    "CASE WHEN metric LIKE 'generation_Nuclear%' THEN 12 WHEN metric LIKE 'generation_Hydro%' "
    "OR metric LIKE 'consumption_load%' OR metric LIKE 'pv_%' THEN 3 "
    "WHEN metric LIKE 'cross_border%' THEN 10 ELSE 6 END"
)
_ALL_FILL = f"""CASE WHEN metric LIKE 'day_ahead%' THEN {_HWFILL.format(mc=1)}
 WHEN metric LIKE 'wind%' OR metric LIKE 'pv%' THEN {_HMFILL}
 WHEN metric LIKE 'generation_Nuclear%' OR metric LIKE 'generation_Fossil%' THEN {_HWFILL.format(mc=12)}
 ELSE {_HWFILL.format(mc=8)} END"""
_ALL_SQL = (
    with_cte(HS, MT, _TIERS.format(k="metric", src="mt"), _GAP.format(k="metric", src="mt"))
    + f""", j AS (SELECT tm.*, {_ALL_FILL} AS fill, gp.gap_position, gp.gap_total, gp.near FROM tm JOIN gp USING (metric, ts)),
r AS (SELECT *, last_value(value - fill IGNORE NULLS) OVER (PARTITION BY metric ORDER BY ts) AS res FROM j),
im AS (SELECT metric, ts, value, CASE WHEN metric LIKE 'bloomberg%' THEN near
 WHEN metric LIKE 'pv_%' AND hour(ts) IN (21, 22, 23, 0, 1) THEN 0.0
 ELSE coalesce(value, CASE WHEN gap_total <= {_ALL_GAP} THEN near END,
   CASE WHEN metric LIKE 'pv_actual%' THEN fill + coalesce(res * greatest(1 - gap_position / 168.0, 0), 0) ELSE fill END) END AS imputed FROM r)
"""
)


@query("imp15_all_rules", _ALL_SQL + "SELECT metric, ts, round(imputed, 8) AS imputed FROM im")
def imp15(spark, d):
    out = imp.impute(derive.metrics(spark, d), imp.RULES, _fit())
    return out.select("metric", "ts", F.round("imputed", 8).alias("imputed"))


@query(
    "imp15_imputation_stats",
    _ALL_SQL
    + """SELECT metric, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_before,
 CAST(sum(CASE WHEN imputed IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_after,
 CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) - sum(CASE WHEN imputed IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS imputed_count,
 round((sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) - sum(CASE WHEN imputed IS NULL THEN 1 ELSE 0 END)) / count(*)::DOUBLE * 100, 8) AS imputed_pct
FROM im GROUP BY metric""",
)
def imp15_stats(spark, d):
    out = imp.impute(derive.metrics(spark, d), imp.RULES, _fit())
    return imp.imputation_stats(out).withColumn("imputed_pct", F.round("imputed_pct", 8))
