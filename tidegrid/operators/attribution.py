"""Feature attributions as a long table (keys, stride, horizon, feature, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunked import join_null_safe

# Feature name patterns and their group, first match wins.
GROUPS = [
    (r"^stat_exog_", "static_covariates"),
    (r"^((hist|futr)_exog_)?y_lag", "target_lags/basic"),
    (r"^((hist|futr)_exog_)?(hour|day|month|is_weekend|is_holiday|is_workday)$", "calendar"),
    (r"^((hist|futr)_exog_)?bloomberg_", "bloomberg"),
    (r"^((hist|futr)_exog_)?runlength(_|$)", "runlength"),
    (r"^((hist|futr)_exog_)?data_driven(_|$)", "data_driven"),
    (r"^((hist|futr)_exog_)?sce_forecast_", "sce"),
    (r"^((hist|futr)_exog_)?cross_border_", "cross_border"),
    (r"^((hist|futr)_exog_)?day_ahead_price", "day_ahead_price"),
    (r"^((hist|futr)_exog_)?(wind|pv)_(forecast|actual)_", "wind_pv"),
    (r"^((hist|futr)_exog_)?(production_|consumption_|.*residual_load)", "production_consumption"),
]
STRUCTURAL = ["static_covariates", "data_driven", "runlength", "calendar"]


def feature_group(feature: Column, basic: str = "target_lags/basic") -> Column:
    out = F.lit(basic)
    for pattern, group in reversed(GROUPS):
        out = F.when(feature.rlike(pattern), F.lit(basic if group == "target_lags/basic" else group)).otherwise(out)
    return out


def feature_set(feature: Column, known: Sequence[str]) -> Column:
    """Group by dataset feature set; a set the dataset does not have falls back to basic."""
    fallback = "basic" if "basic" in known or not known else known[0]
    g = feature_group(feature, "basic")
    return F.when(g.isin([*STRUCTURAL, *known]), g).otherwise(F.lit(fallback))


def base_feature(lagged: Column) -> Column:
    """Name of a lag column without its lag."""
    return F.regexp_replace(lagged, r"_lag[+-]?\d+$", "")


def shares(
    df: DataFrame, sample: Sequence[str], label: Column, average_over: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Mean share of each label in the absolute attribution of a sample.

    ``sample`` names one prediction (series, window, stride, horizon),
    ``average_over`` the columns among them that are averaged away. Labels
    missing from a sample count 0, samples without any attribution give 0.
    """
    keep = [c for c in sample if c not in average_over]
    rows = df.withColumn("label", label)
    if exclude:
        rows = rows.where(~feature_group(F.col("feature")).isin(list(exclude)))
    parts = rows.groupBy(*sample, "label").agg(F.sum(F.abs("value")).alias("_a"))
    total = F.sum("_a").over(Window.partitionBy(*sample))
    share = F.coalesce(F.try_divide(F.col("_a"), total), F.lit(0.0))
    sums = parts.withColumn("_s", share).groupBy(*keep, "label").agg(F.sum("_s").alias("_s"))
    n = df.groupBy(*sample).agg(F.lit(1).alias("_one")).groupBy(*keep).agg(F.count(F.lit(1)).alias("n_predictions"))
    return join_null_safe(sums, n, keep).select(
        *keep, "label", (F.col("_s") / F.col("n_predictions")).alias("share"), "n_predictions"
    )


def horizon_block(horizon: Column) -> Column:
    return F.when(horizon <= 9, "early").when(horizon <= 17, "middle").otherwise("late")


def block_shares(share: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean share per horizon block, predictions summed."""
    return share.groupBy(*keys, horizon_block(F.col("horizon")).alias("horizon_block"), "label").agg(
        F.avg("share").alias("share"), F.sum("n_predictions").alias("n_predictions")
    )


def top_shares(share: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Largest shares overall and per block; ties by name. A group holds the features of one model."""
    block = F.explode(F.array(F.lit("overall"), horizon_block(F.col("horizon")))).alias("horizon_block")
    means = share.select("*", block).groupBy(*keys, "horizon_block", "label").agg(
        F.avg("share").alias("share"), F.sum("n_predictions").alias("n_predictions")
    )
    w = Window.partitionBy(*keys, "horizon_block").orderBy(F.col("share").desc(), F.col("label"))
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def leading_groups(block: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First, second and third group per series and what the first two say."""
    means = block.groupBy(*keys, "label").agg(F.avg("share").alias("share"))
    # a series has about a dozen groups
    order = F.sort_array(
        F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("label").alias("label")))
    )
    top = means.groupBy(*keys).agg(order.alias("_t"))
    names = F.transform(F.slice("_t", 1, 2), lambda x: x["label"])
    state = F.arrays_overlap(
        names, F.array(*[F.lit(x) for x in ("production_consumption", "target_lags/basic", "runlength", "data_driven")])
    )
    ahead = F.arrays_overlap(names, F.array(*[F.lit(x) for x in ("wind_pv", "sce", "day_ahead_price")]))

    def cell(i: int) -> Column:
        x = F.get("_t", F.lit(i))
        return F.coalesce(
            F.concat(x["label"], F.lit(" ("), F.round(-x["s"] * 100).cast("int").cast("string"), F.lit("%)")), F.lit("")
        )

    reading = (
        F.when(state & ahead, "mixed state/forecast driven")
        .when(state, "system-state driven")
        .when(ahead, "forecast driven")
        .otherwise("diffuse feature reliance")
    )
    return top.select(
        *keys, cell(0).alias("first"), cell(1).alias("second"), cell(2).alias("third"), reading.alias("interpretation")
    )


def stride_importance(
    df: DataFrame,
    stride: Sequence[str],
    mode: str = "absolute",
    scaler: DataFrame | None = None,
    min_std: float = 1e-3,
    pooled: bool = False,
    parts: Sequence[str] = ("hist", "futr"),
) -> DataFrame:
    """Attribution of one stride per feature: tokens are summed, then horizons.

    ``absolute`` sums absolute horizon values, ``signed`` keeps the sign.
    ``parts`` picks the token part if the table has a ``part`` column. ``scaler``
    (feature, std[, series keys]) rescales, with a floor and optionally one
    pooled deviation per feature.
    """
    rows = df.where(F.col("part").isin(list(parts)) | F.col("part").isNull()) if "part" in df.columns else df
    v = F.sum("value")
    per = rows.groupBy(*stride, "horizon", "feature").agg(v.alias("_v"))
    one = F.abs("_v") if mode == "absolute" else F.col("_v")
    out = per.groupBy(*stride, "feature").agg(F.sum(one).alias("value"))
    if scaler is None:
        return out
    s = scaler
    if pooled:
        s = s.groupBy("feature").agg(F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"))
    on = [c for c in s.columns if c != "std"]
    return (
        out.join(s, on, "left")
        .withColumn("value", F.col("value") * F.greatest(F.coalesce(F.col("std"), F.lit(1.0)), F.lit(min_std)))
        .drop("std")
    )


def importance(
    strides: DataFrame, model: Sequence[str], batch: str = "direction", slices: Sequence[str] = (), drop_last: bool = False
) -> DataFrame:
    """Importance per feature: mean over strides, then absolute and signed sums over directions.

    ``slices`` (quarter, …) are extra keys. ``drop_last`` leaves the last
    feature by name out, for inputs that end with a baseline row.
    """
    keys = [*model, *slices]
    rows = strides
    if drop_last:
        last = strides.groupBy(*model).agg(F.max("feature").alias("_last"))
        rows = join_null_safe(strides, last, model).where(F.col("feature") < F.col("_last")).drop("_last")
    avg = rows.groupBy(*keys, batch, "feature").agg(F.avg("value").alias("_v"))
    tot = avg.groupBy(*keys, "feature").agg(
        F.sum(F.abs("_v")).alias("abs_combined"),
        F.sum("_v").alias("signed_combined"),
        F.sum(F.greatest(F.col("_v"), F.lit(0.0))).alias("_p"),
        F.sum(F.greatest(-F.col("_v"), F.lit(0.0))).alias("_n"),
    )

    def pct(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c), F.col("abs_combined")) * 100, F.lit(0.0))

    w = Window.partitionBy(*keys)  # one row per feature
    return tot.select(
        *keys, "feature", "abs_combined",
        F.coalesce(F.try_divide(F.col("abs_combined"), F.sum("abs_combined").over(w)) * 100, F.lit(0.0)).alias("pct_of_total_abs"),
        "signed_combined", pct("signed_combined").alias("net_ratio"), pct("_p").alias("pos_share"), pct("_n").alias("neg_share"),
    )


def horizon_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of the attribution over strides per (keys, horizon, feature).

    A cell holds one value per stride, so exact percentiles work on a bounded group.
    """
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    g = df.groupBy(*keys, "horizon", "feature").agg(
        F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("mean_abs"),
        F.avg((F.col("value") > 0).cast("int")).alias("frac_pos"),
        F.avg((F.col("value") < 0).cast("int")).alias("frac_neg"), q.alias("_q"),
    )
    names = ("p10", "p25", "p50", "p75", "p90")
    return g.select(
        *keys, "horizon", "feature", "mean", "mean_abs", "frac_pos", "frac_neg",
        *[F.col("_q")[i].alias(n) for i, n in enumerate(names)],
    )


def top_per_horizon(stats: DataFrame, model: Sequence[str], batch: str, k: int, metric: str = "mean_abs") -> DataFrame:
    """Rows of the k features with the largest mean metric over directions, per horizon."""
    score = stats.groupBy(*model, "horizon", "feature").agg(F.avg(F.abs(metric)).alias("_score"))
    w = Window.partitionBy(*model, "horizon").orderBy(F.col("_score").desc(), F.col("feature").desc())
    best = score.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).drop("_score")
    return stats.join(best, [*model, "horizon", "feature"])


def summary(df: DataFrame, model: Sequence[str], stride: Sequence[str], scaler: DataFrame | None = None) -> DataFrame:
    """Mean and median over strides of the absolute sum per feature, optionally rescaled."""
    per = df.groupBy(*model, *stride, "feature").agg(F.sum(F.abs("value")).alias("_a"))
    out = per.groupBy(*model, "feature").agg(
        F.avg("_a").alias("mean_abs"), F.percentile("_a", F.lit(0.5)).alias("median_abs")
    )
    if scaler is None:
        return out
    std = F.coalesce(F.col("std"), F.lit(1.0))
    return out.join(scaler, "feature", "left").withColumns(
        {"mean_abs_original": F.col("mean_abs") * std, "median_abs_original": F.col("median_abs") * std}
    ).drop("std")


def average_tables(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Element-wise average of importance tables over windows."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def lag_importance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute importance per base feature, the lags of a feature summed."""
    return df.groupBy(*keys, base_feature(F.col("feature")).alias("feature")).agg(
        F.sum(F.abs("value")).alias("importance")
    )


def set_importance(df: DataFrame, model: Sequence[str], cell: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature set and its share of the total.

    The value of a feature is the mean over cells (direction, horizon) of the
    absolute mean over strides.
    """
    per_cell = df.groupBy(*model, *cell, "feature").agg(F.abs(F.avg("value")).alias("_m"))
    per = per_cell.groupBy(*model, "feature").agg(F.avg("_m").alias("_m"))
    sets = per.groupBy(*model, feature_set(F.col("feature"), known).alias("feature_set")).agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("_m").alias("mean_abs_total")
    )
    w = Window.partitionBy(*model)  # one row per set
    return sets.withColumn(
        "pct_of_total", F.coalesce(F.try_divide(F.col("mean_abs_total"), F.sum("mean_abs_total").over(w)) * 100, F.lit(0.0))
    )


def profile_distance(df: DataFrame, model: Sequence[str], profile: Sequence[str], collapse: Callable[[Column], Column] = F.avg) -> DataFrame:
    """1 − correlation of the horizon profiles of two features; constant profiles are left out.

    Features of a model are a short list, and a pair meets once per profile cell.
    """
    cells = df.groupBy(*model, *profile, "feature").agg(collapse(F.col("value")).alias("v"))
    pairs = cells.alias("a").join(
        cells.select(*model, *profile, F.col("feature").alias("other"), F.col("v").alias("w")), [*model, *profile]
    ).where(F.col("feature") < F.col("other"))
    flat = 1e-12
    stats = pairs.groupBy(*model, "feature", "other").agg(
        F.corr("v", "w").alias("_r"), F.stddev_pop("v").alias("_a"), F.stddev_pop("w").alias("_b")
    )
    return stats.where((F.col("_a") > flat) & (F.col("_b") > flat)).select(
        *model, "feature", "other", (F.lit(1.0) - F.col("_r")).alias("distance")
    )


def cluster_means(
    df: DataFrame, clusters: DataFrame, keys: Sequence[str], collapse: Callable[[Column], Column] = F.avg, model: Sequence[str] = ()
) -> DataFrame:
    """Profile of each cluster from a (feature, cluster) table, or from one with ``model`` keys of its own."""
    return join_null_safe(df, clusters, ["feature", *model]).groupBy(*keys, "cluster").agg(
        collapse(F.col("value")).alias("value"), F.count_distinct("feature").alias("n_features")
    )
