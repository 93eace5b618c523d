"""Frames for training and forecasting: windows, shifts, lags, strides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.timeutil import add_calendar
from tidegrid.operators.chunked import chunk_window, home_rows, hour_index, join_null_safe, row_position, with_halo

CALENDAR = ["hour", "day", "month", "is_weekend", "is_holiday", "is_workday"]


def rolling_windows(
    bounds: DataFrame, n_train: int = 37, n_valid: int = 2, n_test: int = 1, min_coverage: float = 0.5,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Monthly windows from (keys, lo, hi): stop at the first window with too little test data.

    A window starts a month after the one before, and its bounds follow each other: a start on the 31st moves to the 30th or 28th in
    a shorter month and stays there. The months of the data bound the candidates.
    """
    months = F.ceil(F.months_between("hi", "lo")).cast("int") + 2
    cand = bounds.withColumn(
        "window_index", F.explode(F.sequence(F.lit(0), F.greatest(months, F.lit(0))))
    )
    steps = "CASE WHEN window_index > 0 THEN sequence(1, window_index) ELSE array() END"
    cand = (
        cand.withColumn("train_start", F.expr(f"aggregate({steps}, lo, (a, _) -> timestampadd(MONTH, 1, a))"))
        .withColumn("valid_start", F.expr(f"timestampadd(MONTH, {n_train}, train_start)"))
        .withColumn("test_start", F.expr(f"timestampadd(MONTH, {n_valid}, valid_start)"))
        .withColumn("test_end", F.expr(f"timestampadd(MONTH, {n_test}, test_start)"))
    )
    seconds = lambda c: F.unix_seconds(c)
    coverage = (seconds("hi") - seconds("test_start")) / (seconds("test_end") - seconds("test_start"))
    ends = (F.col("test_end") > F.expr("hi + INTERVAL 1 HOUR")) & (coverage < min_coverage)
    stop = cand.where(ends).groupBy(*keys).agg(F.min("window_index").alias("_stop"))
    joined = cand.join(stop, list(keys), "left") if keys else cand.crossJoin(F.broadcast(stop))
    return joined.where(F.col("_stop").isNull() | (F.col("window_index") < F.col("_stop"))).select(
        *keys, "window_index", "train_start", "valid_start", "test_start", "test_end"
    )


def window_roles(df: DataFrame, windows: DataFrame, keys: Sequence[str] = (), ts: str = "ds", shift_hours: int = 0) -> DataFrame:
    """Rows of every window with their role: train, valid or test (bounds moved back by the shift)."""
    moved = windows
    for c in ("train_start", "valid_start", "test_start", "test_end"):
        moved = moved.withColumn(c, F.expr(f"{c} - make_dt_interval(0, {shift_hours})"))
    months = F.sequence(F.date_trunc("month", "train_start"), F.date_trunc("month", "test_end"), F.expr("INTERVAL 1 MONTH"))
    listed = moved.withColumn("_month", F.explode(months))
    if not keys:  # a parameter table: it goes to the rows, which else may all be sent to its one task
        listed = F.broadcast(listed)
    out = df.withColumn("_month", F.date_trunc("month", ts)).join(listed, [*keys, "_month"]).where(
        (F.col(ts) >= F.col("train_start")) & (F.col(ts) < F.col("test_end"))
    ).drop("_month")
    role = (
        F.when(F.col(ts) < F.col("valid_start"), "train")
        .when(F.col(ts) < F.col("test_start"), "valid")
        .otherwise("test")
    )
    return out.withColumn("role", role).drop("train_start", "valid_start", "test_start", "test_end")


def first_training_slice(df: DataFrame, windows: DataFrame, ts: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in the training span of window 0; of each series' own window if the windows have ``keys``."""
    first = windows.where("window_index = 0").select(
        *[F.col(k).alias(f"_w_{k}") for k in keys], F.col("train_start").alias("_from"), F.col("valid_start").alias("_to")
    ).distinct()
    cond = (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return df.join(first, cond).drop("_from", "_to", *[f"_w_{k}" for k in keys])


def stride_dates(windows: DataFrame, horizon: int = 24) -> DataFrame:
    """Forecast origins of each window's test span."""
    last = F.expr(f"test_end - make_dt_interval(0, {horizon})")
    return windows.where(F.col("test_start") <= last).select(
        "window_index",
        F.posexplode(F.sequence(F.col("test_start"), last, F.expr(f"make_dt_interval(0, {horizon})"))).alias(
            "stride", "origin"
        ),
    )


def shifted_dataset(
    df: DataFrame,
    keys: Sequence[str],
    shift_hours: int,
    future: Sequence[str] = (),
    y: str = "y",
    ts: str = "ds",
    operator: str | None = None,
    holidays: DataFrame | None = None,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Target and future covariates of ``shift_hours`` later, calendar of the target time."""
    moved = [y, *future]
    out = df
    if shift_hours > 0:
        rows = with_halo(df, hour_index(ts), after=shift_hours)
        w = chunk_window(keys)
        out = home_rows(rows.withColumns({c: F.lead(c, shift_hours).over(w) for c in moved}))
    at = F.expr(f"{ts} + make_dt_interval(0, {shift_hours})")
    out = add_calendar(out, at, holidays if operator else None, operator or "operator")
    return out.dropna(subset=moved) if drop_incomplete and shift_hours > 0 else out


def is_allowed_shift(days: Column, exclude_multiples: Sequence[int] = ()) -> Column:
    """Shifts that are no multiple of the given numbers."""
    out = F.lit(True)
    for m in exclude_multiples:
        if m > 0:
            out = out & (F.pmod(days, F.lit(m)) != 0)
    return out


def allowed_shifts(spark: SparkSession, low: int, high: int, exclude_multiples: Sequence[int] = ()) -> DataFrame:
    days = spark.range(low, high + 1).select(F.col("id").cast("int").alias("days"))
    return days.where(is_allowed_shift(F.col("days"), exclude_multiples))


def sample_shift(spark: SparkSession, low: int, high: int, exclude_multiples: Sequence[int] = (), seed: int = 0) -> DataFrame:
    """One allowed shift, chosen by a seeded hash."""
    days = allowed_shifts(spark, low, high, exclude_multiples)
    return days.agg(F.min_by("days", F.xxhash64(F.lit(seed), F.col("days"))).alias("days"))


def circular_shift(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    hours: int,
    period: int | None = None,
    ts: str = "ds",
) -> DataFrame:
    """Covariates of the row ``hours`` ahead, wrapped around the period; y and keys stay.

    A self join on the row number: both sides are spread over (series, row),
    so no task holds a whole series.
    """
    return _circular(row_position(df, keys, [ts], F.date_trunc("month", ts), "_rn"), keys, cols, hours, period)


def _circular(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], hours: int, period: int | None) -> DataFrame:
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.col("_n") if period is None else F.least(F.lit(period), F.col("_n"))
    moved = join_null_safe(rows, sizes, keys).withColumn("_t", size).withColumn(
        "_src",
        F.when(F.pmod(F.lit(hours), F.col("_t")) == 0, F.col("_rn")).otherwise(
            F.pmod(F.col("_rn") + F.lit(hours), F.col("_t"))
        ),
    )
    source = rows.select(*keys, F.col("_rn").alias("_src"), *[F.col(c).alias(f"_m_{c}") for c in cols])
    out = join_null_safe(moved.drop(*cols), source, [*keys, "_src"])
    return out.select(
        *[F.col(f"_m_{c}").alias(c) if c in cols else F.col(c) for c in rows.columns if c != "_rn"]
    )


def circular_shift_blocks(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], hours: int, train_rows: int, ts: str = "ds"
) -> DataFrame:
    """The same with training and validation rows wrapped apart."""
    rows = row_position(df, keys, [ts], F.date_trunc("month", ts), "_row")
    rows = rows.withColumn("_blk", (F.col("_row") >= train_rows).cast("int"))
    rows = rows.withColumn(
        "_rn", F.when(F.col("_blk") == 1, F.col("_row") - train_rows).otherwise(F.col("_row"))
    ).drop("_row")
    return _circular(rows, [*keys, "_blk"], cols, hours, None).drop("_blk")


def standard_scaler(
    df: DataFrame, keys: Sequence[str], before: Column, value: str = "value"
) -> DataFrame:
    """(keys, centre, scale) fitted on the rows where ``before`` holds; no spread gives scale 1."""
    v = F.when(before, F.col(value))
    sd = F.stddev_pop(v)
    return df.groupBy(*keys).agg(F.avg(v).alias("centre"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("scale"))


def scale(df: DataFrame, scaler: DataFrame, keys: Sequence[str], value: str = "value", inverse: bool = False) -> DataFrame:
    v = F.col(value)
    new = v * F.col("scale") + F.col("centre") if inverse else (v - F.col("centre")) / F.col("scale")
    return join_null_safe(df, scaler, keys).withColumn(value, new).drop("centre", "scale")


def lag_design(
    df: DataFrame,
    keys: Sequence[str],
    target_lags: Sequence[int],
    past: dict[str, Sequence[int]] | None = None,
    future: dict[str, Sequence[int]] | None = None,
    y: str = "y",
    ts: str = "ds",
) -> DataFrame:
    """Design matrix columns ``y_lag-k``, ``c_lag-k`` and ``c_lead+k`` on a complete hourly grid."""
    past, future = past or {}, future or {}
    back = max([*target_lags, *[k for ks in past.values() for k in ks]], default=0)
    ahead = max([k for ks in future.values() for k in ks], default=0)
    rows = with_halo(df, hour_index(ts), before=back, after=ahead)
    w = chunk_window(keys)
    cols = [F.lag(y, k).over(w).alias(f"{y}_lag-{k}") for k in target_lags]
    cols += [F.lag(c, k).over(w).alias(f"{c}_lag-{k}") for c, ks in past.items() for k in ks]
    cols += [F.lead(c, k).over(w).alias(f"{c}_lead+{k}") for c, ks in future.items() for k in ks]
    return home_rows(rows.select("*", *cols))


def inference_frames(
    df: DataFrame, keys: Sequence[str], origins: DataFrame, future: Sequence[str],
    history: int, horizon: int, shift_hours: int = 0, ts: str = "ds",
) -> DataFrame:
    """History before each origin and future covariates of the horizon after origin + shift.

    One row per (origin, hour): ``part`` is ``history`` or ``future``, ``horizon``
    runs 1 … H. Origins without a full horizon in every series are left out
    from the first such origin on.
    """
    lo = F.expr(f"origin - make_dt_interval(0, {history})")
    first = F.expr(f"origin + make_dt_interval(0, {shift_hours})")
    final = F.expr(f"origin + make_dt_interval(0, {shift_hours + horizon})")
    days = F.sequence(F.date_trunc("day", "_lo"), F.date_trunc("day", "_f1"), F.expr("INTERVAL 1 DAY"))
    spans = (
        origins.withColumn("_lo", lo).withColumn("_f0", first).withColumn("_f1", final)
        .withColumn("_day", F.explode(days))
    )
    t = F.col(ts)
    past, ahead = (t >= F.col("_lo")) & (t < F.col("origin")), (t >= F.col("_f0")) & (t < F.col("_f1"))
    # an origin lists the days it needs: an equi-join instead of a range join
    rows = df.withColumn("_day", F.date_trunc("day", ts)).join(spans, "_day").where(past | ahead).drop("_day")
    parts = F.array(
        F.when(past, F.struct(F.lit("history").alias("part"), F.lit(None).cast("int").alias("horizon"))),
        F.when(
            ahead,
            F.struct(
                F.lit("future").alias("part"),
                ((F.unix_seconds(t) - F.unix_seconds("_f0")) / 3600 + 1).cast("int").alias("horizon"),
            ),
        ),
    )
    rows = rows.withColumn("_p", F.explode(F.filter(parts, lambda p: p.isNotNull())))
    rows = rows.select(*keys, "origin", ts, "_p.part", "_p.horizon", *future, *(["y"] if "y" in df.columns else []))
    ok = (F.col("part") == "future")
    for c in future:
        ok = ok & F.col(c).isNotNull()
    full = rows.groupBy("origin", *keys).agg(F.sum(ok.cast("int")).alias("_n"))
    short = full.where(F.col("_n") < horizon).agg(F.min("origin").alias("_cut"))
    return rows.crossJoin(F.broadcast(short)).where(F.col("_cut").isNull() | (F.col("origin") < F.col("_cut"))).drop("_cut")


def alignment_errors(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side has and the other lacks; empty when the grids agree."""
    missing = expected.select(*keys).join(df.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = df.select(*keys).join(expected.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def dataset_compatibility(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ds") -> DataFrame:
    """One row: compatible, extended (with the first new timestamp) or incompatible."""
    if set(old.columns) != set(new.columns):
        spark = old.sparkSession
        return spark.createDataFrame([("incompatible", None)], "status string, first_new timestamp")
    a = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    same = F.lit(True)
    per = a.groupBy(*keys).agg(
        F.count_if(F.col("_s") == 0).alias("_o"), F.count_if(F.col("_s") == 1).alias("_w"),
        *[F.min(F.struct(F.col(v).isNull().alias("n"), F.col(v).alias("v"))).alias(f"_lo_{v}") for v in values],
        *[F.max(F.struct(F.col(v).isNull().alias("n"), F.col(v).alias("v"))).alias(f"_hi_{v}") for v in values],
    )
    for v in values:
        same = same & F.col(f"_lo_{v}").eqNullSafe(F.col(f"_hi_{v}"))
    both = (F.col("_o") > 0) & (F.col("_w") > 0)
    flags = per.agg(
        F.sum((both & ~same).cast("int")).alias("_diff"),
        F.count_if(F.col("_w") == 0).alias("_lost"),
        F.min(F.when(F.col("_o") == 0, F.col(ts))).alias("_new"),
        F.max(F.when(F.col("_o") > 0, F.col(ts))).alias("_end"),
    )
    status = (
        F.when((F.col("_diff") > 0) | (F.col("_lost") > 0), "incompatible")
        .when(F.col("_new").isNull(), "compatible")
        .when(F.col("_new") > F.col("_end"), "extended")
        .otherwise("incompatible")
    )
    return flags.select(status.alias("status"), F.col("_new").alias("first_new")).withColumn(
        "first_new", F.when(F.col("status") == "extended", F.col("first_new"))
    )


def tail_rows(df: DataFrame, keys: Sequence[str], n: int, ts: str = "ds") -> DataFrame:
    """Last n hours of each series on a complete grid: a maximum per series, no ordering of the rows."""
    ends = df.groupBy(*keys).agg(F.max(ts).alias("_end"))
    return join_null_safe(df, ends, keys).where(
        F.col(ts) > F.expr(f"_end - make_dt_interval(0, {n})")
    ).drop("_end")


def history_before(
    predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], hours: int, window: str = "window_index", ts: str = "ds"
) -> DataFrame:
    """Actual values from ``hours`` before the first forecast of a window to its last one."""
    spans = predictions.groupBy(*keys, window).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return join_null_safe(actuals, spans, keys).where(
        (F.col(ts) >= F.expr(f"_lo - make_dt_interval(0, {hours})")) & (F.col(ts) <= F.col("_hi"))
    ).drop("_lo", "_hi")


def clip_interval(df: DataFrame, keys: Sequence[str], start: Column, end: Column, ts: str = "ds") -> DataFrame:
    """Requested interval cut to each series; a series outside of it fails."""
    b = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    out = b.select(*keys, F.greatest("_lo", start).alias("start"), F.least("_hi", end).alias("end"))
    ok = F.assert_true(F.col("start") < F.col("end"), F.lit("interval outside the series")).isNull()
    return out.where(ok).withColumn("n_points", F.expr("timestampdiff(HOUR, start, end)"))
