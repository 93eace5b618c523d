"""Event intervals to hourly rows.

The hour list of an event is built inside its row, so splitting, exposure and
the per-event totals need no shuffle; the only exchange is the final
aggregation by (operator, direction, hour).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunked import join_null_safe
from tidegrid.operators.densify import aggregate_on_grid

HOUR_US = 3_600_000_000


def _overlap_us(lo: str, hi: str, hour: str = "_hour") -> str:
    h = f"unix_micros({hour})"
    return f"greatest(least({hi}, {h} + {HOUR_US}) - greatest({lo}, {h}), 0)"


def _hours(lo_us: str, hi_us: str) -> str:
    first = f"date_trunc('hour', timestamp_micros({lo_us}))"
    final = f"date_trunc('hour', timestamp_micros({hi_us} - 1000000))"
    return (
        f"CASE WHEN {final} >= {first} THEN sequence({first}, {final}, INTERVAL 1 HOUR) "
        "ELSE CAST(array() AS array<timestamp>) END"
    )


def _in_part(hi_us: str) -> str:
    return f"_hour <= date_trunc('hour', timestamp_micros({hi_us} - 1000000))"


def split_hourly(df: DataFrame, method: Column | str = "equal") -> DataFrame:
    """Spread ``total_load`` of each event over the hours it overlaps.

    ``method`` is a literal or a column: ``equal`` shares by overlap, ``split``
    puts the active duration half at the front and half at the back. Adds
    ``hour_begin``, ``hour_end``, ``hour_load``, ``exposure`` (share of the hour
    the event covers) and ``exposure_total`` (its sum over the event's rows).
    """
    m = F.lit(method) if isinstance(method, str) else method
    base = (
        df.where("begin_date < end_date AND NOT (total_load <=> 0D)")
        .withColumn("_m", m)
        .withColumn("_b", F.expr("unix_micros(begin_date)"))
        .withColumn("_e", F.expr("unix_micros(end_date)"))
        .withColumn("_dur", F.expr(f"(_e - _b) / {HOUR_US}D"))
        .withColumn(
            "_act",
            F.expr(
                "CASE WHEN mean_load > 0 THEN least(try_divide(total_load, mean_load), _dur) "
                "ELSE _dur END"
            ),
        )
        .withColumn("_half", F.expr(f"CAST(round(_act / 2 * {HOUR_US}D) AS BIGINT)"))
        .withColumn(
            "_two",
            F.expr(
                "coalesce(_m = 'split' AND _act > 0.25 AND total_load >= 1 "
                "AND _b + _half < _e - _half, false)"
            ),
        )
        .withColumn(
            "_list",
            F.expr(
                f"CASE WHEN _two THEN array_distinct(concat({_hours('_b', '_b + _half')}, "
                f"{_hours('_e - _half', '_e')})) ELSE {_hours('_b', '_e')} END"
            ),
        )
        .withColumn(
            "exposure_total",
            F.expr(
                "aggregate(_list, 0D, (a, _hour) -> a + "
                f"{_overlap_us('_b', '_e')} / {HOUR_US}D)"
            ),
        )
        .withColumn("_hour", F.explode("_list"))
    )
    one = _overlap_us("_b", "_e")
    front = f"CASE WHEN {_in_part('_b + _half')} THEN {_overlap_us('_b', '_b + _half')} ELSE 0 END"
    back = _overlap_us("_e - _half", "_e")
    base = (
        base.withColumn("_ov", F.expr(f"CASE WHEN _two THEN {front} + {back} ELSE {one} END"))
        .where("_ov > 0")
        .withColumn("hour_begin", F.col("_hour"))
        .withColumn("hour_end", F.expr("_hour + INTERVAL 1 HOUR"))
        .withColumn(
            "hour_load",
            F.expr(
                f"total_load * (CASE WHEN _two THEN (_ov / {HOUR_US}D) / _act "
                f"ELSE (_ov / {HOUR_US}D) / _dur END)"
            ),
        )
        .withColumn("exposure", F.expr(f"least({one} / {HOUR_US}D, 1D)"))
    )
    return base.drop(
        "_m", "_b", "_e", "_dur", "_act", "_half", "_two", "_list", "_hour", "_ov"
    )


def with_rows(df: DataFrame) -> DataFrame:
    """Events that give at least one hourly row, without splitting them."""
    return df.where(
        "NOT (total_load <=> 0D) AND begin_date < end_date "
        "AND date_trunc('hour', end_date - INTERVAL 1 SECOND) >= date_trunc('hour', begin_date)"
    )


def quarter_flags(rows: DataFrame) -> DataFrame:
    """Columns ``q0`` … ``q3``: does the event overlap this quarter of the hour."""
    for i in range(4):
        lo = f"hour_begin + INTERVAL {15 * i} MINUTE"
        hi = f"hour_begin + INTERVAL {15 * (i + 1)} MINUTE"
        rows = rows.withColumn(
            f"q{i}",
            F.expr(f"CAST(least(end_date, {hi}) > greatest(begin_date, {lo}) AS INT)"),
        )
    return rows


def union_exposure(rows: DataFrame, keys: Sequence[str] = ("direction",)) -> DataFrame:
    """Share of the hour covered by the union of events, on 15-minute quarters."""
    flags = quarter_flags(rows).groupBy(*keys, "hour_begin").agg(
        *[F.max(f"q{i}").alias(f"q{i}") for i in range(4)]
    )
    n = F.col("q0") + F.col("q1") + F.col("q2") + F.col("q3")
    return flags.select(
        *keys, "hour_begin", n.alias("quarters_active"), (n / 4.0).alias("union_exposure")
    )


def active_duration(eps: float) -> Column:
    """Hours of full load of an event, snapped to its duration and bounded by it."""
    dur = f"((unix_micros(end_date) - unix_micros(begin_date)) / {HOUR_US}D)"
    raw = "try_divide(total_load, nullif(mean_load, 0D))"
    return F.expr(
        f"coalesce(CASE WHEN abs({raw} - {dur}) <= {eps}D THEN {dur} "
        f"WHEN {raw} IS NULL THEN NULL ELSE least(greatest({raw}, 0D), {dur}) END, 0D)"
    )


def hourly_activity(
    rows: DataFrame, keys: Sequence[str] = ("operator", "direction"), eps: float = 0.3, bounds: DataFrame | None = None
) -> DataFrame:
    """Energy, activity features and union exposure per hour, in one exchange.

    With ``bounds`` (keys, lo, hi) the result is the complete grid; its rows
    enter the same aggregation.
    """
    share = "CASE WHEN exposure_total > 0 THEN exposure / exposure_total ELSE 0D END"
    cells = quarter_flags(rows).select(
        *keys,
        F.col("hour_begin").alias("ts"),
        F.col("hour_load").alias("load"),
        (active_duration(eps) * F.expr(share)).alias("active"),
        F.expr("CAST(exposure > 0 AS INT)").alias("on"),
        F.expr(f"coalesce(max_load, 0D) * ({share})").alias("weighted"),
        "q0", "q1", "q2", "q3",
    )
    zero = F.lit(0.0)
    quarters = F.lit(0)
    for i in range(4):
        quarters = quarters + F.coalesce(F.max(f"q{i}"), F.lit(0))
    aggs = [
        F.coalesce(F.sum("load"), zero).alias("total_load"),
        F.coalesce(F.sum("active"), zero).alias("total_active_duration"),
        F.coalesce(F.sum("on"), F.lit(0)).alias("n_interventions"),
        F.coalesce(F.max("weighted"), zero).alias("max_load_weighted"),
        (quarters / 4.0).alias("union_exposure"),
    ]
    if bounds is None:
        return cells.groupBy(*keys, "ts").agg(*aggs)
    return aggregate_on_grid(cells, keys, bounds, aggs)


def isolated_intervals(
    df: DataFrame, keys: Sequence[str] = (), bucket: str = "HOUR"
) -> DataFrame:
    """Intervals (closed ends) that touch no other interval of their group.

    No self join on ranges. Intervals with the same begin touch each other, so
    they collapse to one row before the exchange. A begin is isolated when it
    lies after every earlier end and its end before the next begin; both come
    from two-level running values over (group, hour).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    begins = df.groupBy(*keys, F.col("begin_date").alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("end_date").alias("_end"),
        F.first(F.struct(*rest)).alias("_r"),
    ).withColumn("_b", F.date_trunc(bucket, "_at"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at")
    outer = Window.partitionBy(*keys).orderBy("_b")
    edges = df.groupBy(*keys, F.date_trunc(bucket, "begin_date").alias("_b")).agg(
        F.max("end_date").alias("_mx"), F.min("begin_date").alias("_mn")
    )
    edges = edges.select(
        *keys,
        "_b",
        F.max("_mx").over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_pe"),
        F.lead("_mn").over(outer).alias("_nb"),
    )
    earlier = F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        join_null_safe(begins.withColumn("_ie", earlier).withColumn("_ib", F.lead("_at").over(inside)), edges, [*keys, "_b"])
        .where(
            "_n = 1 AND coalesce(greatest(_ie, _pe) < _at, true) AND coalesce(coalesce(_ib, _nb) > _end, true)"
        )
        .select(*keys, *[F.col(f"_r.`{c}`") for c in rest])
    )


def expand_curve(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Published points to one row per step of a period.

    Input: one row per period with ``period_start``, ``step_minutes`` or
    ``step_months``, ``n_steps``, ``curve_type`` and ``points`` (array of
    position, quantity). ``A03`` holds the last value and starts at 0, ``A01``
    and ``A02`` keep the listed points, any other curve fails.
    """
    held = (
        "transform(sequence(1, n_steps), i -> named_struct('position', i, 'quantity', "
        "coalesce(element_at(map_from_arrays(_sp.position, _sp.quantity), "
        "array_max(filter(_sp.position, p -> p <= i))), 0D)))"
    )
    steps = F.expr(
        f"CASE WHEN curve_type = 'A03' THEN {held} "
        f"WHEN curve_type IN ('A01', 'A02') THEN points "
        "ELSE raise_error(concat('curve type not supported: ', curve_type)) END"
    )
    begin = (
        "CASE WHEN step_months IS NOT NULL THEN "
        "timestampadd(MONTH, CAST((p.position - 1) * step_months AS INT), period_start) "
        "ELSE timestampadd(MINUTE, CAST((p.position - 1) * step_minutes AS INT), period_start) END"
    )
    end = begin.replace("(p.position - 1)", "p.position")
    return (
        points.withColumn("_sp", F.expr("points"))
        .withColumn("p", F.explode(steps))
        .select(
            *keys,
            F.expr(begin).alias("begin_date"),
            F.expr(end).alias("end_date"),
            F.col("p.position").alias("position"),
            F.col("p.quantity").alias("value"),
        )
    )

