"""Forecast evaluation over long predictions (keys, ds, horizon, y, model, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.stats import fbeta, sigmoid
from tidegrid.operators.chunked import exact_quantiles


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def metric_columns(beta: float = 2.0, y: str = "y", p: str = "y_pred") -> dict[str, Column]:
    """All metrics of a group as aggregates of one pass."""
    err = F.col(p) - F.col(y)
    on, fc = F.col(y) > 0, F.col(p) > 0
    ss_res, ss_tot = F.sum(err * err), F.count(y) * F.var_pop(y)
    r2 = F.when(F.max(y) == F.min(y), F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.try_divide(ss_res, ss_tot)
    )
    return {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "mae_conditional": F.avg(F.when(on, F.abs(err))),
        f"fbeta_{float(beta)}": fbeta(_count(on & fc), _count(~on & fc), _count(on & ~fc), beta),
        "r2_score": r2,
    }


def point_metrics(df: DataFrame, keys: Sequence[str], beta: float = 2.0) -> DataFrame:
    """One row per group, one column per metric, plus share of zeros and volume."""
    cols = metric_columns(beta)
    return df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in cols.items()],
        F.avg((F.col("y") == 0).cast("int")).alias("sparsity"),
        F.sum("y").alias("volume"),
    )


def evaluate(
    df: DataFrame,
    keys: Sequence[str] = ("tso", "unique_id", "model"),
    beta: float = 2.0,
    start: Column | None = None,
    end: Column | None = None,
    closed: bool = True,
) -> DataFrame:
    """Long table (keys, sparsity, volume, metric, value). The end is inclusive unless told otherwise."""
    if start is not None:
        df = df.where(F.col("ds") >= start)
    if end is not None:
        df = df.where(F.col("ds") <= end if closed else F.col("ds") < end)
    names = [f"`{n}`" for n in metric_columns(beta)]
    return point_metrics(df, keys, beta).unpivot(
        [*keys, "sparsity", "volume"], names, "metric", "value"
    )


def evaluate_levels(
    df: DataFrame, keys: Sequence[str], slices: Sequence[str], beta: float = 2.0
) -> DataFrame:
    """Every slice (horizon, regime, …) and the overall level in one pass.

    ``level`` names the slice column, or ``overall``.
    """
    base = [F.col(k) for k in keys]
    sets = [base] + [[*base, F.col(s)] for s in slices]
    level = F.lit("overall")
    for s in slices:
        level = F.when(F.grouping(s) == 0, F.lit(s)).otherwise(level)
    cols = metric_columns(beta)
    return df.groupingSets(sets, *base, *[F.col(s) for s in slices]).agg(
        level.alias("level"), *[c.alias(n) for n, c in cols.items()]
    ).select(*keys, "level", *slices, *[f"`{n}`" for n in cols])


def pooled_fbeta(df: DataFrame, keys: Sequence[str], beta: float = 2.0) -> DataFrame:
    name = f"fbeta_{float(beta)}"
    return df.groupBy(*keys).agg(metric_columns(beta)[name].alias(name))


def series_class(df: DataFrame, keys: Sequence[str] = ("tso", "unique_id"), threshold: float = 0.7, y: str = "y") -> DataFrame:
    """Share of zeros per series and its class."""
    share = F.avg((F.col(y) == 0).cast("int"))
    return df.groupBy(*keys).agg(
        share.alias("sparsity"),
        F.when(share >= threshold, F.lit("Sparse")).otherwise(F.lit("Dense")).alias("sparsity_class"),
    )


def by_class(eval_long: DataFrame, threshold: float = 0.7, weighted: Sequence[str] = ("mae",)) -> DataFrame:
    """Metric per model and class: volume-weighted for ``weighted`` metrics, plain mean otherwise."""
    cls = F.when(F.col("sparsity") >= threshold, "Sparse").otherwise("Dense").alias("sparsity_class")
    w = F.try_divide(F.sum(F.col("value") * F.col("volume")), F.sum("volume"))
    return eval_long.groupBy("metric", "model", cls).agg(
        F.when(F.col("metric").isin(list(weighted)), w).otherwise(F.avg("value")).alias("value")
    )


def horizon_bin(horizon: Column, edges: Sequence[int]) -> Column:
    """Label ``lo-hi`` of the block that holds the horizon; the last block is open."""
    lo, out = 1, None
    for e in edges:
        label = F.lit(f"{lo}-{e}")
        out = F.when(horizon <= e, label) if out is None else out.when(horizon <= e, label)
        lo = e + 1
    return out.otherwise(F.lit(f"{lo}+"))


def metric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """A minus B per key, from one aggregation over both sets."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    return both.groupBy(*keys).agg(
        (F.max(F.when(F.col("_s") == 0, F.col(value))) - F.max(F.when(F.col("_s") == 1, F.col(value)))).alias(
            "difference"
        )
    )


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min, quartiles and max of groups of any size."""
    q = exact_quantiles(df, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )


def describe_series(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Mean, quantiles and share of zeros of hourly series (bounded by the calendar)."""
    q = F.percentile(y, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9), F.lit(0.99)))
    return df.groupBy(*keys).agg(
        F.avg(y).alias("mean"), q.alias("_q"), F.avg((F.col(y) == 0).cast("int")).alias("zero_share")
    ).select(
        *keys, "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "q75", "q90", "q99"))],
        "zero_share",
    )


def collapse_overlaps(df: DataFrame, keys: Sequence[str], how: str = "mean") -> DataFrame:
    """Overlapping predictions of one timestamp to one value."""
    agg = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}[how]
    return df.groupBy(*keys).agg(agg("y_pred").alias("y_pred"))


def mean_rank(df: DataFrame, block: Sequence[str], setting: Sequence[str], value: str = "value") -> DataFrame:
    """Average rank (ties share the mean) of each setting over the blocks.

    A block holds one row per setting.
    """
    w = Window.partitionBy(*block).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*block, value))
    ranked = df.withColumn("_rank", F.rank().over(w) + (ties - 1) / 2)
    return ranked.groupBy(*setting).agg(F.avg("_rank").alias("mean_rank"))


def mark_best(df: DataFrame, row: Sequence[str], value: str = "value", higher: Column | None = None, digits: int = 3) -> DataFrame:
    """Adds ``is_best`` (all ties at the printed precision) and the printed ``text``."""
    shown = F.round(value, digits)
    signed = -shown if higher is None else F.when(higher, shown).otherwise(-shown)
    best = F.max(signed).over(Window.partitionBy(*row))
    return df.withColumn("is_best", signed == best).withColumn("text", F.format_number(value, digits))


def percent_text(share: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def dm_cell(statistic: Column, p: Column, digits: int = 2) -> Column:
    """Statistic with its stars; an undefined one is a dash."""
    return F.coalesce(F.concat(F.format_number(statistic, digits), stars(p)), F.lit("-"))


def metric_order(metric: Column, order: Sequence[str]) -> Column:
    """Place of a metric in a report; metrics not named come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(metric == name, F.lit(i)).otherwise(out)
    return out


def with_anchor_target(benchmarks: DataFrame, predictions: DataFrame, keys: Sequence[str], anchor: str) -> DataFrame:
    """Benchmark forecasts with the target of one anchor model's rows."""
    rows = predictions.where(F.col("model") == anchor).select(*keys, "y")
    return benchmarks.drop("y").join(rows, list(keys))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


# costs, lead times, telemetry


def yearly_cost(df: DataFrame, operators: Sequence[str], ts: str = "begin_date") -> DataFrame:
    """Cost per year and operator in millions; months with equal costs in all columns count once."""
    unique = df.dropDuplicates(list(operators))
    return (
        unique.groupBy(F.year(ts).alias("year"))
        .agg(*[(F.sum(o) / F.lit(1e6)).alias(o) for o in operators])
        .unpivot("year", list(operators), "operator", "cost_million")
    )


def covered_period(df: DataFrame, ts: str = "begin_date") -> DataFrame:
    return df.agg(
        F.date_format(F.min(ts), "yyyy-MM").alias("first_month"),
        F.date_format(F.max(ts), "yyyy-MM").alias("last_month"),
    )


def lead_time(df: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Hours from publication to start of first versions: quantiles of groups of any size."""
    hours = df.where("version = 1").withColumn(
        "hours", F.expr("(unix_micros(start) - unix_micros(published)) / 3600000000D")
    )
    return exact_quantiles(hours, keys, "hours", probs)


def run_memory(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Maximum and quantiles of bytes per run in GiB."""
    q = exact_quantiles(df, keys, value, [0.5, 0.9, 0.95, 1.0])
    names = {0.5: "median", 0.9: "q90", 0.95: "q95", 1.0: "max"}
    return q.groupBy(*keys).agg(
        *[
            (F.max(F.when(F.col("prob") == p, F.col("quantile"))) / F.lit(1024.0**3)).alias(n)
            for p, n in names.items()
        ]
    )


# two-stage (hurdle) forecasts


def hurdle_point(logit: Column, magnitude: Column) -> Column:
    return sigmoid(logit) * F.greatest(magnitude, F.lit(0.0))


def hurdle_gate(logit: Column, magnitude: Column, theta: Column) -> Column:
    return F.when(sigmoid(logit) >= theta, F.greatest(magnitude, F.lit(0.0))).otherwise(F.lit(0.0))


def hurdle_stats(df: DataFrame, keys: Sequence[str], eps: float = 1e-6, huber: float = 0.9, y: str = "y") -> DataFrame:
    """Base rate, median, positive weight and Huber quantile; fixed values without positives."""
    pos = F.when(F.col(y) >= eps, F.col(y))
    n, n_pos = F.count(F.lit(1)), F.count(pos)
    none = n_pos == 0
    return df.groupBy(*keys).agg(
        F.when(none, 0.01).otherwise(n_pos / n).alias("base_rate"),
        F.when(none, 0.0).otherwise(F.percentile(pos, F.lit(0.5))).alias("median"),
        F.when(none, n.cast("double")).otherwise(F.try_divide(n - n_pos, n_pos)).alias("pos_weight"),
        F.when(none, 1.0).otherwise(F.percentile(pos, F.lit(huber))).alias("delta"),
    )


def threshold_search(
    df: DataFrame,
    keys: Sequence[str],
    direction: str = "unique_id",
    target: float = 0.5,
    weight: float = 0.5,
    n_grid: int = 200,
    beta: float = 2.0,
    p: str = "p",
    magnitude: str = "magnitude",
    y: str = "y",
) -> DataFrame:
    """Best gate per group: smallest MAE plus penalty for a low mean F-beta.

    Rows are counted once into the grid cell of their probability; running sums
    over the ``n_grid`` + 1 cells give every threshold, so rows are never
    multiplied by the grid.
    """
    steps = F.lit(n_grid + 1)
    raw = F.floor(F.col(p) * steps).cast("int")
    cell = F.when((raw + 1) / steps <= F.col(p), raw + 1).when(raw / steps > F.col(p), raw - 1).otherwise(raw)
    m, on = F.greatest(F.col(magnitude), F.lit(0.0)), F.col(y) > 0
    cells = (
        df.withColumn("_cell", F.least(cell, F.lit(n_grid)))
        .groupBy(*keys, direction, "_cell")
        .agg(
            F.sum(F.abs(m - F.col(y))).alias("_open"),
            F.sum(F.abs(F.col(y))).alias("_shut"),
            _count(on).alias("_pos"),
            _count(~on).alias("_neg"),
        )
    )
    grid = cells.select(*keys, direction).distinct().withColumn(
        "_cell", F.explode(F.sequence(F.lit(0), F.lit(n_grid)))
    )
    full = grid.join(cells, [*keys, direction, "_cell"], "left").fillna(0, ["_open", "_shut", "_pos", "_neg"])
    by = Window.partitionBy(*keys, direction).orderBy("_cell")
    above = by.rowsBetween(0, Window.unboundedFollowing)
    below = by.rowsBetween(Window.unboundedPreceding, -1)

    def run(c: str, frame) -> Column:
        return F.coalesce(F.sum(c).over(frame), F.lit(0))

    curve = full.select(
        *keys, direction, "_cell",
        (run("_open", above) + run("_shut", below)).alias("_abs"),
        run("_pos", above).alias("_tp"),
        run("_neg", above).alias("_fp"),
        run("_pos", below).alias("_fn"),
        (run("_pos", above) + run("_neg", above) + run("_pos", below) + run("_neg", below)).alias("_n"),
    ).where("_cell >= 1")
    per_theta = curve.groupBy(*keys, (F.col("_cell") / steps).alias("theta")).agg(
        (F.sum("_abs") / F.sum("_n")).alias("mae"),
        F.avg(fbeta(F.col("_tp"), F.col("_fp"), F.col("_fn"), beta)).alias("fbeta_mean"),
    )
    scored = per_theta.withColumn(
        "combined",
        F.col("mae") + F.lit(weight) * F.greatest(F.lit(target) - F.col("fbeta_mean"), F.lit(0.0)),
    )
    best = scored.groupBy(*keys).agg(F.min(F.struct("combined", "theta", "mae", "fbeta_mean")).alias("b"))
    return best.select(*keys, "b.theta", "b.combined", "b.mae", "b.fbeta_mean")


# parameters in model names, choice among settings


def number_in_alias(alias: Column, pattern: str) -> Column:
    """Number after a tag in a model alias: ``p`` is the point, ``m`` the minus sign."""
    raw = F.regexp_extract(alias, pattern, 1)
    return F.when(raw == "", None).otherwise(
        F.translate(raw, "pm", ".-").try_cast("double")
    )


def list_order(text: Column) -> Column:
    """``20_15_10`` as a comparable array of integers."""
    return F.transform(F.split(text, "_"), lambda x: x.try_cast("int"))


def choose_parameters(
    df: DataFrame,
    group: Sequence[str],
    primary: str,
    guardrail: str,
    order: Sequence[Column],
    primary_higher: bool = False,
    guardrail_higher: bool = False,
    primary_tol: float = 0.02,
    guardrail_tol: float = 0.02,
) -> DataFrame:
    """Settings near the best primary metric, then near the best guardrail, then the simplest.

    One row per setting goes in, so a group is as small as the sweep.
    """
    def near(value: str, best: Column, higher: bool, tol: float) -> Column:
        return F.col(value) >= best * (1 - tol) if higher else F.col(value) <= best * (1 + tol)

    def best_of(value: str, higher: bool, w) -> Column:
        return (F.max if higher else F.min)(value).over(w)

    w = Window.partitionBy(*group)
    first = df.withColumn("best_primary", best_of(primary, primary_higher, w)).where(
        near(primary, F.col("best_primary"), primary_higher, primary_tol)
    )
    second = first.withColumn("best_guardrail", best_of(guardrail, guardrail_higher, w)).withColumn(
        "_near", near(guardrail, F.col("best_guardrail"), guardrail_higher, guardrail_tol)
    )
    rank = F.row_number().over(w.orderBy(F.col("_near").desc(), *order))
    return second.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_near")


# prediction tables


def display_name(model: Column) -> Column:
    return F.regexp_replace(model, "_seed\\d+", "")


def is_model(model: Column, name: str) -> Column:
    """The model itself or one of its seeds; ``tft`` does not match ``tft_quantile``."""
    return model.rlike(f"^{name}(_seed\\d+)?$")


def select_models(df: DataFrame, names: Sequence[str], model: str = "model") -> DataFrame:
    """Rows of the named models with their place in the list as ``model_order``."""
    order = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        order = F.when(is_model(F.col(model), n), F.lit(i)).otherwise(order)
    return df.withColumn("model_order", order).where(F.col("model_order").isNotNull())


def prepare_predictions(df: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach y, drop interval bounds, strip ``-median``, no negative forecasts."""
    named = df.where(~F.col("model").rlike("-(lo|hi)-")).withColumn(
        "model", F.regexp_replace("model", "-median$", "")
    )
    clipped = named.withColumn("y_pred", F.when(F.col("y_pred") < 0, F.lit(0.0)).otherwise(F.col("y_pred")))
    return clipped.join(actuals, list(keys), "left")


def cyclic_horizon(ts: Column, start: Column, horizon: int) -> Column:
    hours = F.floor((F.unix_seconds(ts) - F.unix_seconds(start)) / 3600)
    return (F.pmod(hours, F.lit(horizon)) + 1).cast("int")


def filter_predictions(
    df: DataFrame, tsos: Sequence[str] | None = None, windows: Sequence[int] | None = None,
    unique_ids: Sequence[str] | None = None, start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    conds = []
    if tsos:
        conds.append(F.col("tso").isin(list(tsos)))
    if windows:
        conds.append(F.col("window_index").isin(list(windows)))
    if unique_ids:
        conds.append(F.col("unique_id").isin(list(unique_ids)))
    if start is not None:
        conds.append(F.col("ds") >= start)
    if end is not None:
        conds.append(F.col("ds") <= end)
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df
