"""Complete hourly grids and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.chunked import carry_last


def hour_grid(bounds: DataFrame, inclusive: bool, ts: str = "ts") -> DataFrame:
    """One row per hour of each bounds row (``lo``, ``hi`` on the hour).

    The bounds are few bytes and would come in one partition; they are dealt to all tasks before they become hours.
    """
    n = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hi = F.col("hi") if inclusive else F.expr("hi - INTERVAL 1 HOUR")
    lo_ok = F.expr("assert_true(lo = date_trunc('HOUR', lo), 'grid start must be on the hour')")
    return (
        bounds.where(lo_ok.isNull())
        .where(F.col("lo") <= hi)
        .repartition(n, *bounds.columns)
        .withColumn(ts, F.explode(F.sequence(F.col("lo"), hi, F.expr("INTERVAL 1 HOUR"))))
        .drop("lo", "hi")
    )


def series_bounds(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def fixed_bounds(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    return df.select(*keys).distinct().withColumn("lo", lo).withColumn("hi", hi)


def common_bounds(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Every series over the range of the whole table (one aggregate row is broadcast)."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return df.select(*keys).distinct().crossJoin(F.broadcast(span))


def complete_grid(
    df: DataFrame,
    keys: Sequence[str],
    bounds: DataFrame,
    fill: dict[str, float] | None = None,
    inclusive: bool = True,
    keep_outside: bool = True,
    ts: str = "ts",
) -> DataFrame:
    """Add the missing hours of every series; new cells are null or ``fill``."""
    grid = hour_grid(bounds, inclusive, ts)
    how = "full" if keep_outside else "left"
    out = grid.join(df, [*keys, ts], how)
    return out.fillna(fill) if fill else out


def aggregate_on_grid(
    rows: DataFrame, keys: Sequence[str], bounds: DataFrame, aggs: Sequence[Column], inclusive: bool = True, ts: str = "ts"
) -> DataFrame:
    """Hourly aggregates on the complete grid in one exchange.

    The grid rows join the data rows before the aggregation, with nulls in the
    value columns, so densifying needs no join and no sort of its own.
    """
    grid = hour_grid(bounds, inclusive, ts)
    return rows.unionByName(grid, allowMissingColumns=True).groupBy(*keys, ts).agg(*aggs)


def missing_hours(df: DataFrame, keys: Sequence[str], bounds: DataFrame, ts: str = "ts") -> DataFrame:
    return hour_grid(bounds, True, ts).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def reindex_forward_fill(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "ts"
) -> DataFrame:
    """Every hour between a series' first and last row, columns carried forward."""
    dense = complete_grid(df, keys, series_bounds(df, keys, ts), keep_outside=False, ts=ts)
    named = {f"_f_{c}": F.col(c) for c in cols}
    out = carry_last(dense, keys, ts, F.date_trunc("quarter", ts), named)
    for c in cols:
        out = out.withColumn(c, F.col(f"_f_{c}"))
    return out.drop(*named)


def target_series(
    hourly: DataFrame, lo: Column, hi: Column, keys: Sequence[str] = ("operator", "direction"),
    series: DataFrame | None = None,
) -> DataFrame:
    """Hourly sum per series on the complete grid, hours without events are 0.

    ``series`` names the series when a cheaper table than the hourly rows has them.
    """
    bounds = fixed_bounds(hourly if series is None else series, keys, lo, hi)
    total = F.coalesce(F.sum("total_load"), F.lit(0.0)).alias("total_load")
    return aggregate_on_grid(hourly.select(*keys, "ts", "total_load"), keys, bounds, [total])


def resample_hourly(
    df: DataFrame, keys: Sequence[str] = ("metric",), how: str = "sum"
) -> DataFrame:
    """Mixed resolutions to hourly: sub-hourly rows are aggregated, an hourly row wins.

    One exchange: both candidates of an hour are aggregates of the same group.
    With ``sum`` an hour between sub-hourly rows of a series that has none is 0.
    """
    short = F.expr("timestampdiff(SECOND, begin_date, end_date) < 3600")
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    rows = df.where(F.col("value").isNotNull())
    hours = rows.groupBy(
        *keys,
        F.when(short, F.date_trunc("hour", "begin_date"))
        .otherwise(F.col("begin_date"))
        .alias("begin_date"),
    ).agg(
        F.min_by(F.when(~short, F.col("value")), F.when(~short, F.col("end_date"))).alias("_whole"),
        agg(F.when(short, F.col("value"))).alias("_parts"),
        F.max(short.cast("int")).alias("_short"),
    )
    if how == "sum":
        span = (
            hours.where("_short = 1")
            .groupBy(*keys)
            .agg(F.min("begin_date").alias("lo"), F.max("begin_date").alias("hi"))
        )
        hours = hour_grid(span, True, "begin_date").withColumn("_zero", F.lit(0.0)).join(
            hours, [*keys, "begin_date"], "full"
        )
        value = F.coalesce("_whole", "_parts", "_zero")
    else:
        value = F.coalesce("_whole", "_parts")
    return hours.select(
        *keys,
        "begin_date",
        F.expr("begin_date + INTERVAL 1 HOUR").alias("end_date"),
        value.alias("value"),
    )


def floor_mean(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("ts")).agg(F.avg(value).alias(value))


def daily_to_hourly(df: DataFrame, day: str = "day", ts: str = "ts") -> DataFrame:
    return df.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn(
        ts, F.col(day).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("_h"))
    ).drop("_h")


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "last"
) -> DataFrame:
    """Union of two tables, one row per key: the newer (or older) batch wins.

    A maximum by batch, so rows are combined before the exchange.
    """
    both = old.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in keys and c != "_batch"]
    pick = F.max_by if keep == "last" else F.min_by
    return both.groupBy(*keys).agg(pick(F.struct(*rest), F.col("_batch")).alias("_r")).select(*keys, "_r.*")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in an explicit order: a minimum over ordered structs.

    ``order`` holds ascending columns; use a negated or inverted column to
    prefer large values.
    """
    rest = [c for c in df.columns if c not in keys]
    item = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min(item).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`") for c in rest])
