"""Domain tables derived from the given tables, as DataFrames and as SQL.

Each function reads whole tables; the SQL twin is a list of CTEs under the same
name for the checking queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.chunked import chunk_window, home_rows, hour_index, with_halo
from tidegrid.operators.densify import aggregate_on_grid, common_bounds, complete_grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


OPERATOR = (
    "CASE user_id % 4 WHEN 0 THEN '50Hertz' WHEN 1 THEN 'TenneT DE' "
    "WHEN 2 THEN 'Amprion' ELSE 'TransnetBW' END"
)
MEAN_LOAD = "CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value / (0.25 + event_id % 8) END"


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "date_trunc('minute', ts) AS begin_date",
        "timestampadd(MINUTE, CAST(15 + event_id % 600 AS INT), date_trunc('minute', ts)) AS end_date",
        "event_type AS reason",
        "CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction",
        f"CAST({MEAN_LOAD} AS DOUBLE) AS mean_load",
        f"CAST(1.2D * ({MEAN_LOAD}) AS DOUBLE) AS max_load",
        "value AS total_load",
        f"{OPERATOR} AS operator",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('U', user_id % 50) END AS affected_unit",
        "CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS primary_energy_type",
        "user_id",
    )


IV = f"""
iv AS (
  SELECT event_id, date_trunc('minute', ts) AS begin_date,
         date_trunc('minute', ts) + to_minutes(CAST(15 + event_id % 600 AS INT)) AS end_date,
         event_type AS reason,
         CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
         CAST({MEAN_LOAD} AS DOUBLE) AS mean_load,
         CAST(1.2 * ({MEAN_LOAD}) AS DOUBLE) AS max_load,
         value AS total_load, {OPERATOR} AS operator,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('U', user_id % 50) END AS affected_unit,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS primary_energy_type,
         user_id
  FROM events)
"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of ten users per series on the complete grid, empty hours null."""
    rows = table(spark, sf_dir, "events").select(
        F.expr("user_id div 10").alias("series"), F.date_trunc("hour", "ts").alias("ts"), "value"
    )
    return aggregate_on_grid(
        rows, ["series"], common_bounds(rows, ["series"]), [F.round(F.sum("value"), 2).alias("value")]
    )


HS = """
hs_sum AS (SELECT user_id // 10 AS series, date_trunc('hour', ts) AS ts,
                  round(sum(value), 2) AS value FROM events GROUP BY ALL),
hs_grid AS (SELECT s.series, h.ts FROM (SELECT DISTINCT series FROM hs_sum) s
            CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM
                        (SELECT min(ts) AS lo, max(ts) AS hi FROM hs_sum)) h),
hs AS (SELECT g.series, g.ts, v.value FROM hs_grid g LEFT JOIN hs_sum v USING (series, ts))
"""

# Metric names of the hourly series, one family per rule of the imputation table.
METRIC = (
    "CASE series % 12 WHEN 0 THEN 'day_ahead_price_de_' WHEN 1 THEN 'generation_forecast_de_' "
    "WHEN 2 THEN 'generation_Nuclear_' WHEN 3 THEN 'generation_Fossil_Gas_' "
    "WHEN 4 THEN 'generation_Hydro_Pumped_Storage_' WHEN 5 THEN 'generation_Waste_' "
    "WHEN 6 THEN 'consumption_forecast_de_' WHEN 7 THEN 'consumption_load_actual_de_' "
    "WHEN 8 THEN 'wind_forecast_de_' WHEN 9 THEN 'pv_actual_de_' "
    "WHEN 10 THEN 'cross_border_de_' ELSE 'bloomberg_' END"
)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series under metric names: (metric, ts, value)."""
    return hourly(spark, sf_dir).selectExpr(
        f"concat({METRIC}, series) AS metric", "ts", "value"
    )


MT = f"mt AS (SELECT concat({METRIC}, series) AS metric, ts, value FROM hs)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target panel (tso, unique_id, ds, y), hours without events are 0."""
    rows = table(spark, sf_dir, "events").select(
        F.expr("concat('T', user_id div 10)").alias("tso"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END").alias("unique_id"),
        F.date_trunc("hour", "ts").alias("ds"),
        "value",
    )
    keys = ["tso", "unique_id"]
    y = F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("y")
    return aggregate_on_grid(rows, keys, common_bounds(rows, keys, "ds"), [y], ts="ds")


PN = """
pn_sum AS (SELECT concat('T', user_id // 10) AS tso,
                  CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS unique_id,
                  date_trunc('hour', ts) AS ds, round(sum(value), 2) AS y
           FROM events GROUP BY ALL),
pn AS (SELECT k.tso, k.unique_id, h.ds, coalesce(v.y, 0) AS y
       FROM (SELECT DISTINCT tso, unique_id FROM pn_sum) k
       CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds FROM
                   (SELECT min(ds) AS lo, max(ds) AS hi FROM pn_sum)) h
       LEFT JOIN pn_sum v USING (tso, unique_id, ds))
"""

DAMPED = "CASE WHEN hour(ds) % 5 = 0 THEN 0 ELSE 0.7 * y + hour(ds) % 7 END"
MODELS = ["blend", "damped", "naive", "seasonal"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions of four simple models over the panel."""
    rows = with_halo(panel(spark, sf_dir), hour_index("ds"), before=168)
    w = chunk_window(["tso", "unique_id"])
    rows = home_rows(
        rows.select(
            "*",
            *[F.coalesce(F.lag("y", k).over(w), F.lit(0.0)).alias(f"l{k}") for k in (24, 48, 168)],
        )
    )
    return rows.selectExpr(
        "tso",
        "unique_id",
        "ds",
        "hour(ds) + 1 AS horizon",
        "CAST((day(ds) - 1) div 10 AS INT) AS window_index",
        "y",
        "explode(map('naive', l24, 'blend', (l24 + l48) / 2, 'seasonal', l168, "
        f"'damped', CAST({DAMPED.replace('0.7', '0.7D')} AS DOUBLE))) AS (model, y_pred)",
    )


PR = f"""
pr_lag AS (SELECT *, coalesce(lag(y, 24) OVER w, 0) AS l24, coalesce(lag(y, 48) OVER w, 0) AS l48,
                  coalesce(lag(y, 168) OVER w, 0) AS l168
           FROM pn WINDOW w AS (PARTITION BY tso, unique_id ORDER BY ds)),
pr AS (SELECT tso, unique_id, ds, CAST(hour(ds) + 1 AS INT) AS horizon,
              CAST((day(ds) - 1) // 10 AS INT) AS window_index, y, m.model,
              CASE m.model WHEN 'naive' THEN l24 WHEN 'blend' THEN (l24 + l48) / 2
                           WHEN 'seasonal' THEN l168
                           ELSE CAST({DAMPED} AS DOUBLE) END AS y_pred
       FROM pr_lag CROSS JOIN (SELECT unnest(['blend', 'damped', 'naive', 'seasonal']) AS model) m)
"""


def with_cte(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
