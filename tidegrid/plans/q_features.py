"""Queries of the feature, join and loader operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import lookups, timeutil
from tidegrid.operators import checks, features as ft, joins
from tidegrid.plans import derive, loaders
from tidegrid.plans.derive import HS, IV, MT, PN, PR, with_cte
from tidegrid.plans.q_impute import _GAP, _HMFILL, _HWFILL, _TIERS, OOS, _fit
from tidegrid.plans.registry import query

_NEXT = "first_value({c} IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _rounded(df, *cols, n=8):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


@query(
    "win1_rolling_same_hour",
    with_cte(HS)
    + """, r AS (SELECT series, ts, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, avg(abs(value)) OVER w AS a
 FROM hs WINDOW w AS (PARTITION BY series, hour(ts) ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
e AS (SELECT series, ts, CASE WHEN n >= 3 THEN m END AS m, CASE WHEN n >= 3 THEN s END AS s, CASE WHEN n >= 3 THEN a END AS a FROM r)
SELECT series, ts, round("""
    + _NEXT.format(c="m", k="series, hour(ts)")
    + ", 8) AS rollingmean_7d, round("
    + _NEXT.format(c="s", k="series, hour(ts)")
    + ", 8) AS rollingstd_7d, round("
    + _NEXT.format(c="a", k="series, hour(ts)")
    + ", 8) AS rolling_absdev_7d FROM e",
)
def win1(spark, d):
    out = ft.rolling_same_hour(derive.hourly(spark, d), ["series"], 7, True, True).drop("value")
    return _rounded(out, "rollingmean_7d", "rollingstd_7d", "rolling_absdev_7d")


@query(
    "win2_lags",
    with_cte(HS)
    + """, l AS (SELECT series, ts, lag(value, 1) OVER w AS a, lag(value, 24) OVER w AS b FROM hs
 WINDOW w AS (PARTITION BY series ORDER BY ts)) SELECT series, ts, """
    + _NEXT.format(c="a", k="series") + " AS lag_1h, "
    + _NEXT.format(c="b", k="series") + " AS lag_24h FROM l",
)
def win2(spark, d):
    return ft.lags(derive.hourly(spark, d), ["series"], (1, 24)).drop("value")


@query(
    "win3_lag_and_rolling_no_backfill",
    with_cte(HS)
    + """SELECT series, ts, lag(value, 1) OVER (PARTITION BY series ORDER BY ts) AS lag_1h,
 CASE WHEN count(value) OVER w >= 7 THEN round(avg(value) OVER w, 8) END AS rollingmean_14d
FROM hs WINDOW w AS (PARTITION BY series, hour(ts) ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""",
)
def win3(spark, d):
    out = ft.lag_and_rolling(derive.hourly(spark, d), ["series"], 14, (1,), False).drop("value")
    return _rounded(out, "rollingmean_14d")


_ACTIVITY = """
z AS (SELECT *, coalesce(value <> 0, false) AS nz FROM hs),
rs AS (SELECT *, CAST(nz AND NOT coalesce(lag(nz) OVER (PARTITION BY series ORDER BY ts), false) AS INT) AS st FROM z),
ac AS (SELECT series, avg(CASE WHEN value IS NOT NULL THEN CAST(value <> 0 AS INT) END) AS activity,
        stddev_samp(value) FILTER (WHERE value <> 0) AS magnitude, CAST(sum(st) AS BIGINT) AS runs FROM rs GROUP BY series)
"""


@query(
    "win6_nonzero_runs",
    with_cte(HS, _ACTIVITY) + "SELECT series, round(activity, 8) AS activity, round(magnitude, 8) AS magnitude, runs FROM ac",
)
def win6(spark, d):
    return _rounded(ft.column_activity(derive.hourly(spark, d), ["series"]), "activity", "magnitude")


@query(
    "flt5_select_active_series",
    with_cte(HS, _ACTIVITY)
    + "SELECT hs.series, ts, value FROM hs WHERE series IN (SELECT series FROM ac WHERE activity >= 0.3 AND magnitude >= 40 AND runs >= 2)",
)
def flt5(spark, d):
    return ft.select_active(derive.hourly(spark, d), ["series"], 0.3, 40.0, 2)


@query(
    "flt6_drop_missing_series",
    with_cte(HS)
    + """SELECT series, ts, value FROM hs WHERE series IN
 (SELECT series FROM hs GROUP BY series HAVING avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) <= 0.4 OR series = 3)""",
)
def flt6(spark, d):
    return ft.drop_sparse(derive.hourly(spark, d), ["series"], 0.4, F.col("series") == 3)


_DAILY = """
dp AS (SELECT o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 1000, 7) AS value FROM orders GROUP BY ALL)
"""


def _daily(spark, d):
    return derive.table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("prio"), F.to_date("o_orderdate").alias("day")
    ).agg(F.round(F.avg("o_totalprice") / 1000, 7).alias("value"))


@query(
    "win7_row_difference",
    with_cte(_DAILY)
    + "SELECT prio, CAST(day AS TIMESTAMP) AS day, round(value - lag(value) OVER (PARTITION BY prio ORDER BY day), 8) AS change FROM dp",
)
def win7(spark, d):
    out = ft.row_difference(_daily(spark, d), ["prio"], "day", F.year("day"))
    return _rounded(out.drop("value").withColumn("day", F.col("day").cast("timestamp")), "change")


@query(
    "win9_rolling_week_mean_median",
    with_cte(PN)
    + """SELECT tso, unique_id, ds, round(avg(y) OVER w, 8) AS rolling_mean, round(quantile_cont(y, 0.5) OVER w, 8) AS rolling_median
FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds RANGE BETWEEN INTERVAL 604799999999 MICROSECOND PRECEDING AND CURRENT ROW)""",
)
def win9(spark, d):
    out = ft.rolling_time(derive.panel(spark, d), ["tso", "unique_id"], 7, "y", "ds").drop("y")
    return _rounded(out, "rolling_mean", "rolling_median", n=8)


@query(
    "win10_naive_forecast",
    with_cte(PN) + "SELECT tso, unique_id, ds, lag(y, 24) OVER (PARTITION BY tso, unique_id ORDER BY ds) AS naive FROM pn",
)
def win10(spark, d):
    return ft.naive_forecast(derive.panel(spark, d), ["tso", "unique_id"], 24).drop("y")


@query(
    "prj7_covariate_kind",
    with_cte(HS, MT)
    + """SELECT CASE WHEN metric LIKE '%forecast%' OR metric LIKE 'day_ahead_price%' THEN 'future' ELSE 'historical' END AS kind,
 metric, count(value) AS n FROM mt GROUP BY ALL""",
)
def prj7(spark, d):
    return (
        derive.metrics(spark, d)
        .groupBy(ft.kind_of_covariate(F.col("metric")).alias("kind"), "metric")
        .agg(F.count("value").alias("n"))
    )


_EASTER = """
yy AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yy),
e2 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
es AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM e4),
days AS (
  SELECT make_date(y, mo, dd) AS day, st FROM yy, (VALUES (1,1,'*'),(1,6,'TransnetBW,TenneT DE,50Hertz'),(5,1,'*'),(8,15,'TenneT DE,Amprion'),
   (10,3,'*'),(10,31,'50Hertz,TenneT DE'),(11,1,'TransnetBW,TenneT DE,Amprion'),(11,20,'50Hertz'),(12,25,'*'),(12,26,'*')) f(mo, dd, st)
  UNION ALL
  SELECT CAST(easter + CAST(o AS INT) AS DATE), st FROM es, (VALUES (-2,'*'),(1,'*'),(39,'*'),(50,'*'),(60,'TransnetBW,TenneT DE,Amprion')) f(o, st)),
hol AS (SELECT DISTINCT day, unnest(CASE st WHEN '*' THEN ['50Hertz','TenneT DE','Amprion','TransnetBW'] ELSE string_split(st, ',') END) AS operator FROM days)
"""


def _holidays(spark, d):
    years = derive.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return timeutil.holidays_of_years(years)


@query("src15_holiday_generator", with_cte(_EASTER) + "SELECT CAST(day AS TIMESTAMP) AS day, operator, 1 AS is_holiday FROM hol")
def src15(spark, d):
    return _holidays(spark, d).withColumn("day", F.col("day").cast("timestamp"))


@query(
    "prj8_src14_calendar_features",
    with_cte(_EASTER)
    + """, o AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS t_at,
 ['50Hertz','TenneT DE','Amprion','TransnetBW'][o_custkey % 4 + 1] AS operator FROM orders)
SELECT o_orderkey, CAST(hour(t_at) AS INT) AS hour, CAST(day(t_at) AS INT) AS day, CAST(month(t_at) AS INT) AS month,
 CAST(isodow(t_at) >= 6 AS INT) AS is_weekend, CAST(hol.day IS NOT NULL AS INT) AS is_holiday,
 CAST(isodow(t_at) < 6 AND hol.day IS NULL AS INT) AS is_workday
FROM o LEFT JOIN hol ON hol.day = CAST(t_at AS DATE) AND hol.operator = o.operator""",
)
def prj8(spark, d):
    orders = derive.table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "timestampadd(HOUR, CAST(o_orderkey % 24 AS INT), o_orderdate) AS at",
        "element_at(array('50Hertz','TenneT DE','Amprion','TransnetBW'), CAST(o_custkey % 4 + 1 AS INT)) AS operator",
    )
    return timeutil.add_calendar(orders, F.col("at"), _holidays(spark, d)).drop("at", "operator")


@query(
    "prj6_operator_lookups",
    with_cte(IV)
    + """, a AS (SELECT event_id, ['50HzT','TenneT','Amprion_DE','Transnet BW','Swissgrid'][user_id % 5 + 1] AS raw FROM iv)
SELECT event_id, ['50Hertz','TenneT DE','Amprion','TransnetBW','Swissgrid'][list_position(['50HzT','TenneT','Amprion_DE','Transnet BW','Swissgrid'], raw)] AS operator,
 CASE raw WHEN 'Amprion_DE' THEN 'split' ELSE 'equal' END AS split_method,
 CASE raw WHEN '50HzT' THEN 'CZ,DK,DK_2,PL' WHEN 'TenneT' THEN 'BE,DK,DK_1,NL' WHEN 'Amprion_DE' THEN 'BE,FR,LU,NL' WHEN 'Transnet BW' THEN 'AT,CH,FR' END AS neighbours,
 CAST(raw <> 'Swissgrid' AS INT) AS known FROM a""",
)
def prj6(spark, d):
    iv = derive.interventions(spark, d).withColumn(
        "raw",
        F.expr("element_at(array('50HzT','TenneT','Amprion_DE','Transnet BW','Swissgrid'), CAST(user_id % 5 + 1 AS INT))"),
    )
    return iv.select(
        "event_id",
        lookups.canonical_operator(F.col("raw")).alias("operator"),
        lookups.split_method(F.col("raw")).alias("split_method"),
        F.array_join(lookups.neighbours(F.col("raw")), ",").alias("neighbours"),
        lookups.is_known_operator(F.col("raw")).cast("int").alias("known"),
    )


AREAS = ["DE_LU", "PL", "CZ", "DK_1", "DK_2", "NL", "AT", "CH", "FR"]
_AREA_SQL = "CASE WHEN series < 9 THEN [" + ", ".join(f"'{a}'" for a in AREAS) + "][series + 1] ELSE concat('X', series) END"


def _areas(spark, d):
    arr = "array(" + ", ".join(f"'{a}'" for a in AREAS) + ")"
    return derive.hourly(spark, d).selectExpr(
        f"CASE WHEN series < 9 THEN element_at({arr}, CAST(series + 1 AS INT)) ELSE concat('X', series) END AS area",
        "ts",
        "value",
    )


def _imputed_cte(k: str, src: str, gap: int, fill: str, name: str = "im") -> str:
    """CTEs that impute ``src`` by one rule into (k, ts, value)."""
    return (
        _TIERS.format(k=k, src=src).strip() + "," + _GAP.format(k=k, src=src).strip()
        + f""",
{name} AS (SELECT tm.{k}, tm.ts, coalesce(tm.value, CASE WHEN gp.gap_total <= {gap} THEN gp.near END, {fill}) AS value
 FROM tm JOIN gp ON gp.{k} = tm.{k} AND gp.ts = tm.ts)"""
    )


_NB_SQL = """
nb(operator, area) AS (VALUES ('50Hertz','CZ'),('50Hertz','DK_1'),('50Hertz','DK_2'),('50Hertz','PL'),('TenneT DE','DK_1'),('TenneT DE','DK_2'),
 ('TenneT DE','NL'),('Amprion','FR'),('Amprion','NL'),('TransnetBW','AT'),('TransnetBW','CH'),('TransnetBW','FR'))
"""


@query(
    "cmp3_prj16_price_spreads",
    with_cte(HS, f"ar AS (SELECT {_AREA_SQL} AS area, ts, value FROM hs)", _imputed_cte("area", "ar", 6, _HWFILL.format(mc=1)), _NB_SQL)
    + """, home AS (SELECT ts, value FROM im WHERE area = 'DE_LU')
SELECT o.operator, ts, 'day_ahead_price_de_lu' AS metric, round(value, 8) AS value FROM home, (SELECT DISTINCT operator FROM nb) o
UNION ALL SELECT nb.operator, im.ts, 'day_ahead_price_spread_de_vs_' || lower(im.area), round(home.value - im.value, 8)
FROM im JOIN nb USING (area) LEFT JOIN home ON home.ts = im.ts""",
)
def cmp3_prices(spark, d):
    return _rounded(loaders.day_ahead_prices(_areas(spark, d), _fit()), "value")


_FUELS = [f for fs in lookups.FUEL_GROUPS.values() for f in fs]
_FUEL_GROUP_SQL = "CASE " + " ".join(
    f"WHEN fuel IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in lookups.FUEL_GROUPS.items()
) + " END"
_FU = f"""
fu_sum AS (SELECT concat('OP', user_id // 40) AS operator, [{', '.join(repr(f) for f in _FUELS)}, 'Marine'][event_id % 17 + 1] AS fuel,
  date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL),
fu AS (SELECT concat(k.operator, '|', k.fuel) AS k, h.ts, v.value FROM (SELECT DISTINCT operator, fuel FROM fu_sum) k
  CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM fu_sum)) h
  LEFT JOIN fu_sum v ON v.operator = k.operator AND v.fuel = k.fuel AND v.ts = h.ts)
"""


def _fuels(spark, d):
    arr = "array(" + ", ".join(f"'{f}'" for f in [*_FUELS, "Marine"]) + ")"
    sums = (
        derive.table(spark, d, "events")
        .groupBy(
            F.expr("concat('OP', user_id div 40)").alias("operator"),
            F.expr(f"element_at({arr}, CAST(event_id % 17 + 1 AS INT))").alias("fuel"),
            F.date_trunc("hour", "ts").alias("ts"),
        )
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )
    keys = ["operator", "fuel"]
    return derive.complete_grid(sums, keys, derive.common_bounds(sums, keys))


@query(
    "agg2_agg3_fuel_group_sums",
    with_cte(_FU)
    + f"""SELECT split_part(k, '|', 1) AS operator, ts, {_FUEL_GROUP_SQL} AS "group", round(sum(coalesce(value, 0)), 4) AS value
FROM (SELECT *, split_part(k, '|', 2) AS fuel FROM fu) WHERE fuel <> 'Marine' GROUP BY ALL""",
)
def agg2(spark, d):
    out = ft.group_sums(_fuels(spark, d), ["operator", "ts"], lookups.fuel_group(F.col("fuel")))
    return _rounded(out, "value", n=4)


_LAGROLL = """
lr AS (SELECT {k}, ts, lag(value, 1) OVER (PARTITION BY {k} ORDER BY ts) AS l1, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS rm
 FROM {src} WINDOW w AS (PARTITION BY {k}, hour(ts) ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
lb AS (SELECT {k}, ts, round(first_value(l1 IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 7) AS lag_1h,
 round(first_value(rm IGNORE NULLS) OVER (PARTITION BY {k}, hour(ts) ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 7) AS rollingmean_7d FROM lr)
"""


@query(
    "cmp3_production",
    with_cte(
        _FU,
        _imputed_cte("k", "fu", 6, _HWFILL.format(mc=8)),
        f"""gs AS (SELECT concat(split_part(k, '|', 1), '|', {_FUEL_GROUP_SQL}) AS g, ts, sum(coalesce(value, 0)) AS value
  FROM (SELECT *, split_part(k, '|', 2) AS fuel FROM im) WHERE fuel <> 'Marine' GROUP BY ALL)""",
        _LAGROLL.format(k="g", src="gs"),
    )
    + """SELECT split_part(g, '|', 1) AS operator, split_part(g, '|', 2) AS "group", ts, lag_1h, rollingmean_7d FROM lb""",
)
def cmp3_production(spark, d):
    out = loaders.production_actuals(_fuels(spark, d), 7, _fit()).drop("value")
    return _rounded(out, "lag_1h", "rollingmean_7d", n=7)


@query(
    "cmp3_consumption",
    with_cte(
        HS, f"ar AS (SELECT {_AREA_SQL} AS area, ts, value FROM hs)",
        _imputed_cte("area", "ar", 3, _HWFILL.format(mc=8)), _LAGROLL.format(k="area", src="im"),
    )
    + "SELECT area, ts, lag_1h, rollingmean_7d FROM lb",
)
def cmp3_consumption(spark, d):
    out = loaders.consumption(_areas(spark, d), 7, _fit()).drop("value")
    return _rounded(out, "lag_1h", "rollingmean_7d", n=7)


@query(
    "cmp3_consumption_forecast",
    with_cte(
        HS, f"ar AS (SELECT {_AREA_SQL} AS area, ts, value FROM hs)",
        _imputed_cte("area", "ar", 6, _HWFILL.format(mc=8)),
    )
    + "SELECT area, ts, round(value, 8) AS value FROM im",
)
def cmp3_consumption_forecast(spark, d):
    return _rounded(loaders.consumption_forecasts(_areas(spark, d), _fit()), "value")


_WP = """
wp_sum AS (SELECT concat('OP', user_id // 40) AS operator, ['wind_onshore','wind_offshore','pv'][event_id % 3 + 1] AS kind,
  date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL),
wp AS (SELECT concat(k.operator, '|', k.kind) AS k, h.ts, v.value FROM (SELECT DISTINCT operator, kind FROM wp_sum) k
  CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM wp_sum)) h
  LEFT JOIN wp_sum v ON v.operator = k.operator AND v.kind = k.kind AND v.ts = h.ts)
"""


@query(
    "cmp3_wind_pv",
    with_cte(
        _WP,
        _TIERS.format(k="k", src="wp"), _GAP.format(k="k", src="wp"),
        f"""j AS (SELECT tm.*, {_HMFILL} AS fill, gp.gap_position, gp.gap_total, gp.near FROM tm JOIN gp ON gp.k = tm.k AND gp.ts = tm.ts),
r AS (SELECT *, last_value(value - fill IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts) AS res FROM j),
im AS (SELECT k, ts, CASE WHEN k LIKE '%pv' AND hour(ts) IN (21, 22, 23, 0, 1) THEN 0.0 ELSE
   coalesce(value, CASE WHEN gap_total <= 3 THEN near END,
    CASE WHEN k LIKE '%pv' THEN fill + coalesce(res * greatest(1 - gap_position / 168.0, 0), 0) ELSE fill END) END AS value FROM r),
tot AS (SELECT concat(split_part(k, '|', 1), '|', CASE WHEN k LIKE '%pv' THEN 'pv_actual' ELSE 'wind_actual_total' END) AS g, ts,
   sum(coalesce(value, 0)) AS value FROM im GROUP BY ALL)""",
        _LAGROLL.format(k="g", src="tot"),
    )
    + """SELECT split_part(g, '|', 1) AS operator, split_part(g, '|', 2) AS "group", ts, lag_1h, rollingmean_7d FROM lb""",
)
def cmp3_wind_pv(spark, d):
    sums = (
        derive.table(spark, d, "events")
        .groupBy(
            F.expr("concat('OP', user_id div 40)").alias("operator"),
            F.expr("element_at(array('wind_onshore','wind_offshore','pv'), CAST(event_id % 3 + 1 AS INT))").alias("kind"),
            F.date_trunc("hour", "ts").alias("ts"),
        )
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )
    keys = ["operator", "kind"]
    dense = derive.complete_grid(sums, keys, derive.common_bounds(sums, keys))
    out = loaders.wind_pv(dense, 7, _fit()).drop("value")
    return _rounded(out, "lag_1h", "rollingmean_7d", n=7)


# flows between areas: event users give the partner, event ids the direction
_PARTNER = ["AT", "CH", "CZ", "DK_1", "DK_2", "FR", "NL", "PL", "SE"]
_FL = f"""
fl_sum AS (SELECT CASE WHEN out THEN 'DE_LU' ELSE p END AS from_area, CASE WHEN out THEN p ELSE 'DE_LU' END AS to_area, ts, round(sum(value), 2) AS value
  FROM (SELECT [{', '.join(repr(p) for p in _PARTNER)}][user_id % 9 + 1] AS p, event_id % 2 = 0 OR user_id % 9 = 8 AS out, date_trunc('hour', ts) AS ts, value FROM events)
  GROUP BY ALL),
fl AS (SELECT concat(k.from_area, '|', k.to_area) AS k, h.ts, v.value FROM (SELECT DISTINCT from_area, to_area FROM fl_sum) k
  CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM fl_sum)) h
  LEFT JOIN fl_sum v ON v.from_area = k.from_area AND v.to_area = k.to_area AND v.ts = h.ts)
"""


def _flows(spark, d):
    arr = "array(" + ", ".join(f"'{p}'" for p in _PARTNER) + ")"
    sums = (
        derive.table(spark, d, "events")
        .selectExpr(
            f"element_at({arr}, CAST(user_id % 9 + 1 AS INT)) AS p",
            "event_id % 2 = 0 OR user_id % 9 = 8 AS out",
            "date_trunc('hour', ts) AS ts",
            "value",
        )
        .groupBy(
            F.expr("CASE WHEN out THEN 'DE_LU' ELSE p END").alias("from_area"),
            F.expr("CASE WHEN out THEN p ELSE 'DE_LU' END").alias("to_area"),
            "ts",
        )
        .agg(F.round(F.sum("value"), 2).alias("value"))
    )
    keys = ["from_area", "to_area"]
    return derive.complete_grid(sums, keys, derive.common_bounds(sums, keys))


_NET = """
nf AS (SELECT CASE WHEN split_part(k, '|', 1) = 'DE_LU' THEN split_part(k, '|', 2) ELSE split_part(k, '|', 1) END AS nbr, ts,
  sum(value) FILTER (WHERE split_part(k, '|', 1) = 'DE_LU') AS ex, sum(value) FILTER (WHERE split_part(k, '|', 2) = 'DE_LU') AS im_
 FROM {src} GROUP BY ALL)
"""


@query("prj19_net_flow", with_cte(_FL, _NET.format(src="fl")) + "SELECT nbr AS neighbour, ts, round(ex - im_, 8) AS net FROM nf")
def prj19(spark, d):
    out = ft.net_flow(_flows(spark, d), ["ts"], "DE_LU")
    return _rounded(out.select("neighbour", "ts", "net"), "net")


_NET_ONE = """
n1 AS (SELECT nbr, ts, CASE WHEN nbr = 'SE' THEN ex ELSE ex - im_ END AS value FROM nf)
"""


def _active_cte(src: str, k: str, mag: float) -> str:
    return f"""z AS (SELECT *, coalesce(value <> 0, false) AS nz FROM {src}),
ac AS (SELECT {k}, avg(CASE WHEN value IS NOT NULL THEN CAST(value <> 0 AS INT) END) AS activity, stddev_samp(value) FILTER (WHERE value <> 0) AS magnitude,
  sum(st) AS runs FROM (SELECT *, CAST(nz AND NOT coalesce(lag(nz) OVER (PARTITION BY {k} ORDER BY ts), false) AS INT) AS st FROM z) GROUP BY {k}),
kept AS (SELECT s.* FROM {src} s WHERE {k} IN (SELECT {k} FROM ac WHERE activity >= 0.3 AND magnitude >= {mag} AND runs >= 1))"""


@query(
    "cmp3_scheduled_exchanges",
    with_cte(_FL, _NET.format(src="fl"), _NET_ONE, _active_cte("n1", "nbr", 40))
    + "SELECT nbr AS neighbour, ts, round(value, 8) AS value FROM kept",
)
def cmp3_sce(spark, d):
    return _rounded(loaders.scheduled_exchanges(_flows(spark, d), magnitude=40.0), "value")


@query(
    "cmp3_cross_border",
    with_cte(
        _FL, _imputed_cte("k", "fl", 10, _HWFILL.format(mc=8)), _NET.format(src="im"),
        "n2 AS (SELECT nbr, ts, ex - im_ AS value FROM nf WHERE nbr <> 'SE')",
        _active_cte("n2", "nbr", 30), _LAGROLL.format(k="nbr", src="kept"),
    )
    + "SELECT nbr AS neighbour, ts, lag_1h, rollingmean_7d FROM lb",
)
def cmp3_cross_border(spark, d):
    out = loaders.cross_border(_flows(spark, d), 7, _fit(), magnitude=30.0).drop("value")
    return _rounded(out, "lag_1h", "rollingmean_7d", n=7)


@query(
    "cmp3_prj18_futures_spreads",
    with_cte(_DAILY)
    + """, w AS (SELECT day, max(value) FILTER (WHERE prio = '1-URGENT') AS power, max(value) FILTER (WHERE prio = '2-HIGH') AS gas,
  max(value) FILTER (WHERE prio = '3-MEDIUM') AS coal, max(value) FILTER (WHERE prio = '4-NOT SPECIFIED') AS oil, max(value) FILTER (WHERE prio = '5-LOW') AS carbon FROM dp GROUP BY day),
f AS (SELECT day, last_value(power IGNORE NULLS) OVER o AS power, last_value(gas IGNORE NULLS) OVER o AS gas,
  last_value(coal IGNORE NULLS) OVER o AS coal, last_value(oil IGNORE NULLS) OVER o AS oil, last_value(carbon IGNORE NULLS) OVER o AS carbon FROM w WINDOW o AS (ORDER BY day)),
c AS (SELECT *, gas - lag(gas) OVER (ORDER BY day) AS gc, carbon - lag(carbon) OVER (ORDER BY day) AS cc, oil - lag(oil) OVER (ORDER BY day) AS oc FROM f)
SELECT CAST(day + 1 AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS ts,
 round(power - gas / 0.55::DOUBLE - carbon * 0.35::DOUBLE / 0.55::DOUBLE, 8) AS clean_spark_spread,
 round(power - coal * (3.6::DOUBLE / 25.12::DOUBLE) / 0.4::DOUBLE - carbon * 0.95::DOUBLE / 0.4::DOUBLE, 8) AS clean_dark_spread,
 round(gc, 8) AS gas_change_24h, round(cc, 8) AS carbon_change_24h, round(oc, 8) AS oil_change_24h FROM c, range(24) t(h)""",
)
def cmp3_futures(spark, d):
    prio = {"power": "1-URGENT", "gas": "2-HIGH", "coal": "3-MEDIUM", "oil": "4-NOT SPECIFIED", "carbon": "5-LOW"}
    wide = _daily(spark, d).groupBy("day").agg(
        *[F.max(F.when(F.col("prio") == p, F.col("value"))).alias(n) for n, p in prio.items()]
    )
    out = loaders.futures(wide, ("gas", "carbon", "oil"))
    return _rounded(out, "clean_spark_spread", "clean_dark_spread", "gas_change_24h", "carbon_change_24h", "oil_change_24h", n=8)


_WIDE = """
wd AS (SELECT user_id // 10 AS series, date_trunc('hour', ts) AS ts,
  round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS production_forecast, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS wind_forecast_total,
  round(sum(value) FILTER (WHERE event_type = 'error'), 2) AS pv_forecast, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS consumption_forecast_load, round(sum(value) FILTER (WHERE event_type = 'signup'), 2) AS load_actual
 FROM events GROUP BY ALL)
"""


_WIDE_COLUMNS = ["production_forecast", "wind_forecast_total", "pv_forecast", "consumption_forecast_load", "load_actual"]


def _wide(spark, d):
    names = {
        "production_forecast": "click", "wind_forecast_total": "view",
        "pv_forecast": "error", "consumption_forecast_load": "purchase", "load_actual": "signup",
    }
    return derive.table(spark, d, "events").groupBy(
        F.expr("user_id div 10").alias("series"), F.date_trunc("hour", "ts").alias("ts")
    ).agg(
        *[F.round(F.sum(F.when(F.col("event_type") == e, F.col("value"))), 2).alias(n) for n, e in names.items()]
    )


@query(
    "prj17_residual_load",
    with_cte(_WIDE)
    + """SELECT series, ts, round(consumption_forecast_load - wind_forecast_total - pv_forecast, 8) AS residual_load_forecast,
 round(production_forecast - wind_forecast_total - pv_forecast, 8) AS production_forecast_other,
 consumption_forecast_load, wind_forecast_total, pv_forecast, load_actual FROM wd""",
)
def prj17(spark, d):
    out = loaders.residual_and_other(_wide(spark, d))
    return _rounded(out, "residual_load_forecast", "production_forecast_other")


@query(
    "prj20_forecast_error",
    with_cte(PN, PR) + "SELECT tso, unique_id, ds, model, round(y_pred - y, 8) AS error FROM pr",
)
def prj20(spark, d):
    preds = derive.predictions(spark, d)
    actual = derive.panel(spark, d)
    return preds.drop("y").join(actual, ["tso", "unique_id", "ds"]).select(
        "tso", "unique_id", "ds", "model", F.round(F.col("y_pred") - F.col("y"), 8).alias("error")
    )


@query(
    "jon1_cmp1_feature_join",
    with_cte(PN, _WIDE)
    + """SELECT tso, unique_id, ds, y, production_forecast, wind_forecast_total, pv_forecast, consumption_forecast_load, load_actual FROM pn
LEFT JOIN wd ON concat('T', wd.series) = pn.tso AND wd.ts = pn.ds""",
)
def jon1(spark, d):
    feats = _wide(spark, d).select(
        F.expr("concat('T', series)").alias("tso"), F.col("ts").alias("ds"),
        *_WIDE_COLUMNS,
    )
    return joins.add_features(derive.panel(spark, d), feats, ["tso", "ds"])


@query(
    "jon1_merge_log",
    with_cte(PN, _WIDE)
    + f"""SELECT 'wide' AS feature_set, count(*) AS rows, 5 AS new_columns,
 round(({' + '.join(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in _WIDE_COLUMNS)}) / 5 * 100, 2) AS null_pct
FROM pn LEFT JOIN wd ON concat('T', wd.series) = pn.tso AND wd.ts = pn.ds""",
)
def jon1_log(spark, d):
    return joins.merge_log(jon1(spark, d), "wide", _WIDE_COLUMNS)


_KINDS = ["click", "view", "error", "purchase", "signup"]


@query(
    "jon2_jon3_outer_merge",
    "WITH "
    + ", ".join(
        f"{k}_ AS (SELECT user_id // 10 AS series, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS {k}s FROM events WHERE event_type = '{k}' GROUP BY ALL)"
        for k in _KINDS
    )
    + f" SELECT series, ts, {', '.join(f'{k}s' for k in _KINDS)} FROM {' FULL JOIN '.join(f'{k}_' + (' USING (series, ts)' if i else '') for i, k in enumerate(_KINDS))}",
)
def jon2(spark, d):
    e = derive.table(spark, d, "events")

    def part(kind, name):
        return e.where(F.col("event_type") == kind).groupBy(
            F.expr("user_id div 10").alias("series"), F.date_trunc("hour", "ts").alias("ts")
        ).agg(F.round(F.sum("value"), 2).alias(name))

    return joins.merge_wide([part(k, f"{k}s") for k in _KINDS], ["series", "ts"])


@query(
    "agg24_validate_merge",
    """WITH e AS (SELECT event_type AS operator, CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, date_trunc('hour', ts) AS ts,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS total_load FROM events)
SELECT CAST((SELECT sum(CASE WHEN total_load IS NULL THEN 1 ELSE 0 END) FROM e) AS BIGINT) AS core_nulls,
 (SELECT count(*) FROM e) - (SELECT count(*) FROM (SELECT DISTINCT operator, direction, ts FROM e)) AS duplicates,
 greatest((SELECT date_diff('hour', min(ts), max(ts)) + 1 FROM e) * (SELECT count(*) FROM (SELECT DISTINCT operator, direction FROM e)) - (SELECT count(*) FROM e), 0) AS missing_dates""",
)
def agg24(spark, d):
    e = derive.table(spark, d, "events").selectExpr(
        "event_type AS operator", "CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction",
        "date_trunc('hour', ts) AS ts", "CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS total_load",
    )
    return checks.validate_merge(e, ["operator", "direction", "ts", "total_load"])


@query(
    "agg25_completeness",
    with_cte(HS)
    + """SELECT series, count(*) AS rows, 0::BIGINT AS duplicates, round(count(value) / count(*)::DOUBLE, 8) AS completeness,
 round(count(*) / (date_diff('hour', min(ts), max(ts)) + 1)::DOUBLE, 8) AS coverage,
 count(*) / (date_diff('hour', min(ts), max(ts)) + 1)::DOUBLE >= 0.99 AS passed FROM hs GROUP BY series""",
)
def agg25(spark, d):
    return _rounded(checks.completeness(derive.hourly(spark, d), ["series"]), "completeness", "coverage")
