"""Queries of the interval, grid and target operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import lookups
from tidegrid.operators import densify, intervals
from tidegrid.plans import derive, target
from tidegrid.plans.derive import HS, IV, with_cte
from tidegrid.plans.registry import query

# hourly rows of one sub-interval list (event_id, lo, hi, den hours, total_load)
_SPLIT_SQL = """
one AS (
  SELECT *, date_diff('microsecond', begin_date, end_date) / 3600000000.0 AS dur,
         CASE WHEN mean_load > 0
              THEN least(total_load / mean_load, date_diff('microsecond', begin_date, end_date) / 3600000000.0)
              ELSE date_diff('microsecond', begin_date, end_date) / 3600000000.0 END AS act
  FROM src WHERE begin_date < end_date AND NOT (total_load IS NOT DISTINCT FROM 0)),
two AS (SELECT *, to_microseconds(CAST(round(act / 2 * 3600000000.0) AS BIGINT)) AS half FROM one),
parts AS (
  SELECT *, begin_date AS lo, end_date AS hi, dur AS den FROM two
  WHERE NOT coalesce(method = 'split' AND act > 0.25 AND total_load >= 1
                     AND begin_date + half < end_date - half, false)
  UNION ALL
  SELECT *, begin_date, begin_date + half, act FROM two
  WHERE method = 'split' AND act > 0.25 AND total_load >= 1 AND begin_date + half < end_date - half
  UNION ALL
  SELECT *, end_date - half, end_date, act FROM two
  WHERE method = 'split' AND act > 0.25 AND total_load >= 1 AND begin_date + half < end_date - half),
buckets AS (
  SELECT *, unnest(generate_series(date_trunc('hour', lo),
                                   date_trunc('hour', hi - INTERVAL 1 SECOND), INTERVAL 1 HOUR)) AS h
  FROM parts),
pieces AS (
  SELECT *, date_diff('microsecond', greatest(lo, h), least(hi, h + INTERVAL 1 HOUR))
            / 3600000000.0 AS ov FROM buckets),
hr AS (
  SELECT event_id, operator, direction, reason, begin_date, end_date, mean_load, max_load,
         total_load, dur, h AS ts, sum(total_load * (ov / den)) AS hour_load
  FROM pieces WHERE ov > 0 GROUP BY ALL)
"""

_METHOD = "CASE operator WHEN 'Amprion' THEN 'split' ELSE 'equal' END"


def _src(method: str) -> str:
    return f"src AS (SELECT *, {method} AS method FROM iv)"


_HOURLY_COLS = "SELECT event_id, ts, round(hour_load, 6) AS load FROM hr"


def _hourly_out(rows):
    return rows.select(
        "event_id", F.col("hour_begin").alias("ts"), F.round("hour_load", 6).alias("load")
    )


@query("int1_equal_split", with_cte(IV, _src("'equal'"), _SPLIT_SQL) + _HOURLY_COLS)
def int1(spark, d):
    return _hourly_out(intervals.split_hourly(derive.interventions(spark, d), "equal"))


@query("int2_front_back_split", with_cte(IV, _src("'split'"), _SPLIT_SQL) + _HOURLY_COLS)
def int2(spark, d):
    return _hourly_out(intervals.split_hourly(derive.interventions(spark, d), "split"))


@query("int3_split_by_operator", with_cte(IV, _src(_METHOD), _SPLIT_SQL) + _HOURLY_COLS)
def int3(spark, d):
    iv = derive.interventions(spark, d)
    return _hourly_out(intervals.split_hourly(iv, lookups.split_method(F.col("operator"))))


@query(
    "int4_isolated_intervals",
    with_cte(IV)
    + """, s AS (SELECT event_id, user_id, begin_date, end_date,
       max(end_date) OVER (PARTITION BY user_id ORDER BY begin_date, end_date, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
       lead(begin_date) OVER (PARTITION BY user_id ORDER BY begin_date, end_date, event_id) AS nb
  FROM iv)
SELECT event_id, user_id FROM s
WHERE (pe IS NULL OR pe < begin_date) AND (nb IS NULL OR nb > end_date)""",
)
def int4(spark, d):
    iv = derive.interventions(spark, d)
    return intervals.isolated_intervals(iv, ["user_id"]).select("event_id", "user_id")


_EXPO = """
SELECT event_id, ts, round(least(date_diff('microsecond', greatest(begin_date, ts),
       least(end_date, ts + INTERVAL 1 HOUR)) / 3600000000.0, 1), 6) AS exposure FROM hr"""


@query("int5_hour_exposure", with_cte(IV, _src(_METHOD), _SPLIT_SQL) + _EXPO)
def int5(spark, d):
    iv = derive.interventions(spark, d)
    rows = intervals.split_hourly(iv, lookups.split_method(F.col("operator")))
    return rows.select(
        "event_id", F.col("hour_begin").alias("ts"), F.round("exposure", 6).alias("exposure")
    )


_QUARTERS = """
q AS (SELECT operator, direction, ts,
       max(CAST(least(end_date, ts + INTERVAL 15 MINUTE) > greatest(begin_date, ts) AS INT)) AS q0,
       max(CAST(least(end_date, ts + INTERVAL 30 MINUTE) > greatest(begin_date, ts + INTERVAL 15 MINUTE) AS INT)) AS q1,
       max(CAST(least(end_date, ts + INTERVAL 45 MINUTE) > greatest(begin_date, ts + INTERVAL 30 MINUTE) AS INT)) AS q2,
       max(CAST(least(end_date, ts + INTERVAL 60 MINUTE) > greatest(begin_date, ts + INTERVAL 45 MINUTE) AS INT)) AS q3
      FROM hr GROUP BY ALL)
"""


@query(
    "int6_union_exposure",
    with_cte(IV, _src(_METHOD), _SPLIT_SQL, _QUARTERS)
    + "SELECT operator, direction, ts, (q0+q1+q2+q3) AS quarters, (q0+q1+q2+q3)/4.0 AS exposure FROM q",
)
def int6(spark, d):
    iv = derive.interventions(spark, d)
    rows = intervals.split_hourly(iv, lookups.split_method(F.col("operator")))
    return intervals.union_exposure(rows, ["operator", "direction"]).select(
        "operator",
        "direction",
        F.col("hour_begin").alias("ts"),
        F.col("quarters_active").alias("quarters"),
        F.col("union_exposure").alias("exposure"),
    )


# one period per (user, day): points at the hours with events
_CURVE_SQL = """
period AS (SELECT user_id, date_trunc('day', ts) AS day,
                  CASE user_id % 2 WHEN 0 THEN 'A03' ELSE 'A01' END AS curve FROM events GROUP BY ALL),
pt AS (SELECT user_id, date_trunc('day', ts) AS day, CAST(hour(ts) + 1 AS INT) AS position,
              round(sum(value), 2) AS q FROM events GROUP BY ALL),
steps AS (SELECT p.*, unnest(range(1, 25)) AS position FROM period p),
held AS (SELECT s.user_id, s.day, s.position,
                coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY s.user_id, s.day ORDER BY s.position), 0) AS value
         FROM steps s LEFT JOIN pt ON pt.user_id = s.user_id AND pt.day = s.day AND pt.position = s.position
         WHERE s.curve = 'A03')
SELECT user_id, day + to_hours(CAST(position - 1 AS INT)) AS begin_date,
       day + to_hours(CAST(position AS INT)) AS end_date, value FROM held
UNION ALL
SELECT pt.user_id, pt.day + to_hours(CAST(position - 1 AS INT)), pt.day + to_hours(CAST(position AS INT)), q
FROM pt JOIN period USING (user_id, day) WHERE curve = 'A01'"""


@query("int7_curve_expansion", "WITH " + _CURVE_SQL)
def int7(spark, d):
    pts = (
        derive.table(spark, d, "events")
        .groupBy("user_id", F.date_trunc("day", "ts").alias("day"), (F.hour("ts") + 1).alias("position"))
        .agg(F.round(F.sum("value"), 2).alias("quantity"))
    )
    # at most 24 points per period by construction
    periods = pts.groupBy("user_id", "day").agg(
        F.collect_list(F.struct("position", "quantity")).alias("points")
    )
    periods = periods.withColumns(
        {
            "period_start": F.col("day"),
            "step_minutes": F.lit(60),
            "step_months": F.lit(None).cast("int"),
            "n_steps": F.lit(24),
            "curve_type": F.expr("CASE user_id % 2 WHEN 0 THEN 'A03' ELSE 'A01' END"),
        }
    )
    return intervals.expand_curve(periods, ["user_id"]).drop("position")


_RSP_SQL = """
r AS (SELECT user_id // 10 AS series,
        CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts)
             ELSE date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 15 * 15 AS INT)) END AS begin_date,
        CASE WHEN event_id % 5 = 0 THEN 60 ELSE 15 END AS mins, max(value) AS value
      FROM events GROUP BY ALL),
whole AS (SELECT series, begin_date, value FROM r WHERE mins = 60),
parts AS (SELECT series, date_trunc('hour', begin_date) AS begin_date, {agg}(value) AS value
          FROM r WHERE mins = 15 GROUP BY ALL),
span AS (SELECT series, unnest(generate_series(min(begin_date), max(begin_date), INTERVAL 1 HOUR)) AS begin_date
         FROM parts GROUP BY series)
"""


def _mixed(spark, d):
    return (
        derive.table(spark, d, "events")
        .selectExpr(
            "user_id div 10 AS series",
            "CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) ELSE "
            "date_trunc('hour', ts) + make_dt_interval(0, 0, CAST(minute(ts) div 15 * 15 AS INT)) END AS begin_date",
            "CASE WHEN event_id % 5 = 0 THEN 60 ELSE 15 END AS mins",
            "value",
        )
        .groupBy("series", "begin_date", "mins")
        .agg(F.max("value").alias("value"))
        .withColumn("end_date", F.expr("timestampadd(MINUTE, mins, begin_date)"))
        .drop("mins")
    )


@query(
    "rsp1_resample_sum",
    "WITH "
    + _RSP_SQL.format(agg="sum")
    + """SELECT series, begin_date, round(coalesce(w.value, p.value, CASE WHEN s.series IS NULL THEN NULL ELSE 0 END), 4) AS value
FROM span s FULL JOIN parts p USING (series, begin_date) FULL JOIN whole w USING (series, begin_date)""",
)
def rsp1_sum(spark, d):
    out = densify.resample_hourly(_mixed(spark, d), ["series"], "sum")
    return out.select("series", "begin_date", F.round("value", 4).alias("value"))


@query(
    "rsp1_resample_mean",
    "WITH "
    + _RSP_SQL.format(agg="avg")
    + """SELECT series, begin_date, round(coalesce(w.value, p.value), 6) AS value
FROM parts p FULL JOIN whole w USING (series, begin_date)""",
)
def rsp1_mean(spark, d):
    out = densify.resample_hourly(_mixed(spark, d), ["series"], "mean")
    return out.select("series", "begin_date", F.round("value", 6).alias("value"))


@query(
    "rsp2_floor_mean",
    "SELECT event_type, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL",
)
def rsp2(spark, d):
    out = densify.floor_mean(derive.table(spark, d, "events"), ["event_type"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "rsp3_daily_to_hourly",
    """WITH p AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1)
SELECT price, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS ts FROM p, range(24) t(h)""",
)
def rsp3(spark, d):
    daily = derive.table(spark, d, "orders").groupBy(
        F.to_date("o_orderdate").alias("day")
    ).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))
    return densify.daily_to_hourly(daily).drop("day")


@query(
    "den1_grid_end_exclusive",
    """WITH g AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL),
grid AS (SELECT user_id, unnest(generate_series(min(ts), max(ts) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM g GROUP BY 1)
SELECT user_id, ts, value FROM grid LEFT JOIN g USING (user_id, ts)""",
)
def den1(spark, d):
    g = derive.table(spark, d, "events").groupBy(
        "user_id", F.date_trunc("hour", "ts").alias("ts")
    ).agg(F.round(F.sum("value"), 2).alias("value"))
    return densify.complete_grid(
        g, ["user_id"], densify.series_bounds(g, ["user_id"]), inclusive=False, keep_outside=False
    )


_LO, _HI = "2024-01-03 00:00:00", "2024-01-28 12:00:00"


def _grid_lit():
    return F.lit(_LO).cast("timestamp"), F.lit(_HI).cast("timestamp")


_DEN3 = f"""
agg AS (SELECT operator, direction, ts, sum(hour_load) AS total_load FROM hr GROUP BY ALL),
grid AS (SELECT operator, direction, unnest(generate_series(TIMESTAMP '{_LO}', TIMESTAMP '{_HI}', INTERVAL 1 HOUR)) AS ts
         FROM (SELECT DISTINCT operator, direction FROM agg)),
full_target AS (SELECT operator, direction, ts, coalesce(total_load, 0) AS total_load
                FROM grid FULL JOIN agg USING (operator, direction, ts))
"""


@query(
    "den2_den3_hourly_target",
    with_cte(IV, _src(_METHOD), _SPLIT_SQL, _DEN3)
    + "SELECT operator, direction, ts, round(total_load, 8) AS total_load FROM full_target",
)
def den3(spark, d):
    iv = derive.interventions(spark, d)
    rows = intervals.split_hourly(iv, lookups.split_method(F.col("operator"))).select(
        "operator", "direction", F.col("hour_begin").alias("ts"), F.col("hour_load").alias("total_load")
    )
    out = densify.target_series(rows, *_grid_lit(), series=intervals.with_rows(iv))
    return out.withColumn("total_load", F.round("total_load", 8))


@query(
    "den4_reindex_forward_fill",
    """WITH g AS (SELECT user_id, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value FROM events GROUP BY ALL),
grid AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM g GROUP BY 1)
SELECT user_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS value
FROM grid LEFT JOIN g USING (user_id, ts)""",
)
def den4(spark, d):
    g = derive.table(spark, d, "events").groupBy(
        "user_id", F.date_trunc("hour", "ts").alias("ts")
    ).agg(F.round(F.sum("value"), 2).alias("value"))
    return densify.reindex_forward_fill(g, ["user_id"], ["value"])


_ACT = """
act AS (SELECT *, CASE WHEN mean_load IS NULL OR mean_load = 0 THEN NULL ELSE total_load / mean_load END AS raw FROM hr),
ex AS (SELECT *, least(date_diff('microsecond', greatest(begin_date, ts), least(end_date, ts + INTERVAL 1 HOUR)) / 3600000000.0, 1) AS expo,
         coalesce(CASE WHEN abs(raw - dur) <= {eps} THEN dur WHEN raw IS NULL THEN NULL
                       ELSE least(greatest(raw, 0), dur) END, 0) AS active FROM act),
sh AS (SELECT *, expo / sum(expo) OVER (PARTITION BY event_id) AS share FROM ex),
af AS (SELECT operator, direction, ts, sum(hour_load) AS total_load, sum(active * share) AS total_active_duration,
         CAST(sum(CASE WHEN expo > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_interventions,
         max(coalesce(max_load, 0) * share) AS max_load_weighted FROM sh GROUP BY ALL)
"""


@query(
    "agg1_activity_features",
    with_cte(IV, _src(_METHOD), _SPLIT_SQL, _ACT.format(eps=0.3))
    + """SELECT operator, direction, ts, round(total_load, 7) AS total_load,
 round(total_active_duration, 7) AS total_active_duration, n_interventions,
 round(max_load_weighted, 7) AS max_load_weighted FROM af""",
)
def agg1(spark, d):
    iv = derive.interventions(spark, d)
    rows = intervals.split_hourly(iv, lookups.split_method(F.col("operator")))
    out = intervals.hourly_activity(rows, eps=0.3).drop("union_exposure")
    for c in ("total_load", "total_active_duration", "max_load_weighted"):
        out = out.withColumn(c, F.round(c, 7))
    return out


_REASONS = ["click", "error", "signup"]
_FLT4_WHERE = f"""reason IN ('click', 'error', 'signup')
 AND NOT coalesce(1 - (total_load / nullif(mean_load, 0)) / (date_diff('microsecond', begin_date, end_date) / 3600000000.0) < -0.1, false)
 AND NOT (mean_load = 0 AND total_load > 0) AND primary_energy_type IS NOT NULL
 AND operator IN ('50Hertz', 'TenneT DE', 'Amprion', 'TransnetBW')"""


@query("flt4_reason_gap_filter", with_cte(IV) + f"SELECT event_id, operator FROM iv WHERE {_FLT4_WHERE}")
def flt4(spark, d):
    return target.relevant_interventions(derive.interventions(spark, d), _REASONS).select(
        "event_id", "operator"
    )


@query(
    "flt1_flt2_load_unit_filter",
    """WITH li AS (SELECT l_orderkey, l_linenumber, l_shipdate AS begin_date, l_shipdate + to_hours(CAST(l_quantity AS INT)) AS end_date,
  l_extendedprice * l_discount AS total_load, CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_partkey END AS affected_unit FROM lineitem),
m AS (SELECT max(CAST(begin_date AS DATE)) AS d FROM li WHERE CAST(begin_date AS DATE) = last_day(begin_date))
SELECT l_orderkey, l_linenumber, end_date FROM li, m WHERE end_date < CAST(m.d AS TIMESTAMP) + INTERVAL 1 DAY
 AND (total_load IS NULL OR total_load <> 0) AND affected_unit IS NOT NULL""",
)
def flt1(spark, d):
    li = derive.table(spark, d, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate AS begin_date",
        "timestampadd(HOUR, CAST(l_quantity AS INT), l_shipdate) AS end_date",
        "l_extendedprice * l_discount AS total_load",
        "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_partkey END AS affected_unit",
    )
    return target.with_load_and_unit(target.until_last_full_month(li)).select(
        "l_orderkey", "l_linenumber", "end_date"
    )


@query(
    "flt3_domestic_filter",
    with_cte(IV)
    + """, s AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'outside_germany' WHEN event_id % 13 = 0 THEN NULL ELSE reason END AS carrier,
 ['Bayern', 'Hessen', 'Tirol', NULL][user_id % 4 + 1] AS state,
 CASE WHEN event_id % 19 = 0 THEN 'Börse' ELSE affected_unit END AS unit FROM iv)
SELECT event_id, state FROM s
WHERE carrier IS DISTINCT FROM 'outside_germany' AND (unit IS NULL OR unit NOT IN ('Vorarlberger Ilwerke', 'Börse', 'B¿rse'))
 AND (state IS NULL OR state IN ('Bayern', 'Hessen')) AND primary_energy_type IS NOT NULL""",
)
def flt3(spark, d):
    rows = derive.interventions(spark, d).withColumns(
        {
            "carrier": F.expr(
                "CASE WHEN event_id % 11 = 0 THEN 'outside_germany' "
                "WHEN event_id % 13 = 0 THEN NULL ELSE reason END"
            ),
            "state": F.expr(
                "CASE user_id % 4 WHEN 0 THEN 'Bayern' WHEN 1 THEN 'Hessen' WHEN 2 THEN 'Tirol' END"
            ),
            "unit": F.expr("CASE WHEN event_id % 19 = 0 THEN 'Börse' ELSE affected_unit END"),
        }
    )
    return target.domestic_only(rows, "carrier", "unit", "state", countertrade=False).select(
        "event_id", "state"
    )


_RUNS = """
cal AS (SELECT operator, direction, ts, coalesce(exposure, 0) AS exposure FROM
        (SELECT operator, direction, unnest(generate_series(TIMESTAMP '{lo}', TIMESTAMP '{hi}', INTERVAL 1 HOUR)) AS ts
         FROM (SELECT DISTINCT operator, direction FROM q))
        FULL JOIN (SELECT operator, direction, ts, (q0+q1+q2+q3)/4.0 AS exposure FROM q) USING (operator, direction, ts)),
ind AS (SELECT *, CAST(exposure > 1e-12 AS INT) AS ind FROM cal),
st AS (SELECT *, coalesce(lag(ind) OVER w, 0) AS s FROM ind WINDOW w AS (PARTITION BY operator, direction ORDER BY ts)),
dd AS (SELECT *, coalesce(abs(s - lag(s) OVER w), 0) AS sw, row_number() OVER w AS rn FROM st
       WINDOW w AS (PARTITION BY operator, direction ORDER BY ts)),
rid AS (SELECT *, sum(sw) OVER (PARTITION BY operator, direction ORDER BY ts) AS run FROM dd),
rl AS (SELECT operator, direction, ts, ind AS runlength_indicator,
        CAST(CASE WHEN s = 0 THEN least(row_number() OVER (PARTITION BY operator, direction, run ORDER BY ts), 24) ELSE 0 END AS INT) AS runlength_zero,
        CAST(sum(sw) OVER (PARTITION BY operator, direction ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS INT) AS runlength_switches
       FROM rid)
"""


@query(
    "win4_run_features",
    with_cte(IV, _src(_METHOD), _SPLIT_SQL, _QUARTERS, _RUNS.format(lo="2024-01-01 00:00:00", hi="2024-01-31 23:00:00"))
    + "SELECT * FROM rl",
)
def win4(spark, d):
    iv = derive.interventions(spark, d)
    rows = intervals.split_hourly(iv, lookups.split_method(F.col("operator")))
    expo = intervals.union_exposure(rows, ["operator", "direction"]).withColumnRenamed("hour_begin", "ts")
    lo = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hi = F.lit("2024-01-31 23:00:00").cast("timestamp")
    return target.run_features(
        target.dense_exposure(expo, ["operator", "direction"], lo, hi), ["operator", "direction"]
    ).select("operator", "direction", "ts", "runlength_indicator", "runlength_zero", "runlength_switches")


@query(
    "cmp2_target_pipeline",
    with_cte(
        IV,
        f"src AS (SELECT *, {_METHOD} AS method FROM iv WHERE {_FLT4_WHERE})",
        _SPLIT_SQL,
        _ACT.format(eps=0.3),
        _QUARTERS,
        _RUNS.format(lo="2024-01-01 00:00:00", hi="2024-01-31 23:00:00"),
    )
    + """SELECT operator, direction, rl.ts, round(coalesce(total_load, 0), 7) AS total_load,
 round(coalesce(total_active_duration, 0), 7) AS data_driven_total_active_duration,
 CAST(coalesce(n_interventions, 0) AS BIGINT) AS data_driven_n_interventions,
 round(coalesce(max_load_weighted, 0), 7) AS data_driven_max_load_weighted_proxy,
 runlength_indicator, runlength_zero, runlength_switches
FROM rl LEFT JOIN af USING (operator, direction, ts)""",
)
def cmp2(spark, d):
    lo = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hi = F.lit("2024-01-31 23:00:00").cast("timestamp")
    out = target.target_dataset(derive.interventions(spark, d), _REASONS, lo, hi)
    for c in ("total_load", "data_driven_total_active_duration", "data_driven_max_load_weighted_proxy"):
        out = out.withColumn(c, F.round(c, 7))
    return out


@query(
    "cmp2_reason_classes",
    with_cte(
        IV,
        f"src AS (SELECT iv.* REPLACE (concat(iv.operator, '|', c.cls) AS operator), CASE operator WHEN 'Amprion' THEN 'split' ELSE 'equal' END AS method"
        " FROM (SELECT * FROM iv WHERE " + _FLT4_WHERE.replace("reason IN ('click', 'error', 'signup')", "TRUE") + ") iv "
        "JOIN (VALUES ('domestic', 'click'), ('domestic', 'error'), ('trade', 'signup'), ('trade', 'click')) c(cls, r) ON c.r = iv.reason)",
        _SPLIT_SQL,
    )
    + """SELECT split_part(operator, '|', 2) AS reason_class, split_part(operator, '|', 1) AS operator, direction,
 round(sum(hour_load), 4) AS energy, count(DISTINCT ts) AS active_hours FROM hr GROUP BY ALL""",
)
def cmp2_classes(spark, d):
    classes = {"domestic": ["click", "error"], "trade": ["signup", "click"]}
    lo = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hi = F.lit("2024-01-31 23:00:00").cast("timestamp")
    out = target.target_by_reason_class(derive.interventions(spark, d), classes, lo, hi)
    return out.groupBy("reason_class", "operator", "direction").agg(
        F.round(F.sum("total_load"), 4).alias("energy"),
        F.sum((F.col("data_driven_n_interventions") > 0).cast("int")).alias("active_hours"),
    )
