"""Benchmark models: regularised regressions of every series at once, boosted trees, intermittent demand."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.chunked import join_null_safe

GRAM_KEYS_PER_TASK = 512


def _grams(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Cross products of [1, x, y] per key and task, merged by (key, cell).

    The rows stay where they are: a task adds up its own share of each key and
    ships one small matrix, so a series of any size costs one matrix per task.
    """
    names = [*x, *y]
    fields = [f for f in df.schema.fields if f.name in keys]
    out = T.StructType([*fields, T.StructField("gram", T.ArrayType(T.DoubleType()))])
    ks = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> pd.DataFrame:
            rows = [(*k, g.ravel().tolist()) for k, g in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*ks, "gram"])

        for batch in batches:
            for key, part in batch.groupby(ks, sort=False):
                m = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                held[key] = held[key] + m.T @ m if key in held else m.T @ m
            if len(held) > GRAM_KEYS_PER_TASK:
                yield emit()
        if held:
            yield emit()

    parts = df.select(*ks, *[F.col(n).cast("double").alias(n) for n in names]).dropna().mapInPandas(partial, out)

    cells = parts.select(*ks, F.posexplode("gram").alias("i", "g")).groupBy(*ks, "i").agg(F.sum("g").alias("g"))
    # (1 + features + targets) squared cells per group
    return cells.groupBy(*ks).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "g"))), lambda s: s["g"]).alias("gram")
    )


def _elastic(a: np.ndarray, b: np.ndarray, l1: float, l2: float, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent on cross products."""
    w = np.zeros(len(b))
    diag = np.diag(a)
    for _ in range(sweeps):
        step = 0.0
        for j in np.flatnonzero(diag > 0):
            rest = b[j] - a[j] @ w + diag[j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (diag[j] + l2)
            step = max(step, abs(new - w[j]))
            w[j] = new
        if step < 1e-10:
            break
    return w


def solve_gram(g: np.ndarray, n_x: int, n_y: int, alpha: float, ratio: float) -> list[list[float]]:
    """[intercept, slopes] of each target from the cross products of [1, x, y]."""
    n, mean = g[0, 0], g[0] / g[0, 0]
    c = g - n * np.outer(mean, mean)
    xx, xy = c[1 : 1 + n_x, 1 : 1 + n_x], c[1 : 1 + n_x, 1 + n_x :]
    out = []
    for k in range(n_y):
        if ratio == 0:
            w = np.linalg.pinv(xx + alpha * np.eye(n_x), hermitian=True) @ xy[:, k]
        else:
            w = _elastic(xx / n, xy[:, k] / n, alpha * ratio, alpha * (1 - ratio))
        out.append([float(mean[1 + n_x + k] - mean[1 : 1 + n_x] @ w), *w.tolist()])
    return out


def _solver(n_x: int, n_y: int):
    """UDF: coefficients of each target from one Gram matrix."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def solve(gram: pd.Series, alpha: pd.Series, l1_ratio: pd.Series) -> pd.Series:
        def one(flat, a, ratio) -> list[list[float]]:
            return solve_gram(np.asarray(flat, dtype=float).reshape(1 + n_x + n_y, -1), n_x, n_y, a, ratio)

        return pd.Series([one(*v) for v in zip(gram, alpha, l1_ratio)])

    return solve


def fit_linear(
    df: DataFrame,
    keys: Sequence[str],
    x: Sequence[str],
    y: Sequence[str],
    settings: Sequence[tuple[str, float, float]] = (("ridge", 1.0, 0.0),),
) -> DataFrame:
    """(keys, model, coef): one row per series and setting, ``coef`` one list per target.

    A setting is (name, alpha, l1_ratio): ratio 0 is ridge with penalty
    alpha·|w|², alpha 0 plain least squares; otherwise the objective is
    |y − Xw|²/2n + alpha·(ratio·|w|₁ + (1 − ratio)/2·|w|²). All settings share
    one pass over the rows.
    """
    grams = _grams(df, keys, x, y)
    table = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.lit(float(a)).alias("alpha"), F.lit(float(r)).alias("ratio"))
            for n, a, r in settings
        ]
    )
    rows = grams.withColumn("s", F.explode(table))
    return rows.select(
        *keys, "s.model", _solver(len(x), len(y))("gram", "s.alpha", "s.ratio").alias("coef")
    )


def predict_linear(
    df: DataFrame, coefficients: DataFrame, keys: Sequence[str], x: Sequence[str], ts: str = "ds"
) -> DataFrame:
    """(keys, ts, model, horizon, y_pred) for every target of the fitted rows."""
    joined = join_null_safe(df, coefficients, keys)
    values = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in x])
    return joined.withColumn("_x", values).select(
        *keys, ts, "model", F.posexplode("coef").alias("_k", "_c"), "_x"
    ).select(
        *keys, ts, "model", (F.col("_k") + 1).alias("horizon"),
        F.aggregate(F.zip_with("_x", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v).alias("y_pred"),
    )


def direct_targets(df: DataFrame, keys: Sequence[str], horizon: int, shift: int = 0, y: str = "y", ts: str = "ds") -> DataFrame:
    """Adds ``y+1`` … ``y+H``: the values a model of this origin has to predict."""
    from tidegrid.operators.chunked import chunk_window, home_rows, hour_index, with_halo

    rows = with_halo(df, hour_index(ts), after=shift + horizon)
    w = chunk_window(keys)
    return home_rows(
        rows.select("*", *[F.lead(y, shift + h - 1).over(w).alias(f"y+{h}") for h in range(1, horizon + 1)])
    )


def finalize(df: DataFrame, keys: Sequence[str], ts: str = "ds", prefer: str = "window_index") -> DataFrame:
    """One prediction per timestamp, the latest window wins; no negative values.

    A maximum by window: rows are combined before the exchange.
    """
    last = df.groupBy(*keys, ts).agg(
        F.max(prefer).alias(prefer), F.max_by("y_pred", prefer).alias("y_pred")
    )
    return last.withColumn("y_pred", F.greatest(F.col("y_pred"), F.lit(0.0)))


def boosted_trees(
    train: DataFrame, test: DataFrame, x: Sequence[str], y: str, trees: int = 100, depth: int = 5,
    validation: str | None = None, seed: int = 7,
) -> DataFrame:
    """Gradient-boosted trees with absolute loss; ``validation`` is a boolean column for early stopping."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assemble = VectorAssembler(inputCols=list(x), outputCol="_features", handleInvalid="skip")
    model = GBTRegressor(
        featuresCol="_features", labelCol=y, predictionCol="y_pred", lossType="absolute",
        maxIter=trees, maxDepth=depth, seed=seed,
    )
    if validation is not None:
        model = model.setValidationIndicatorCol(validation)
    fitted = model.fit(assemble.transform(train))
    return fitted.transform(assemble.transform(test)).drop("_features")


def intermittent_demand(
    df: DataFrame,
    keys: Sequence[str],
    horizon: int = 24,
    alpha_d: float = 0.1,
    alpha_p: float = 0.1,
    y: str = "y",
    ts: str = "ds",
) -> DataFrame:
    """TSB forecast of every day start from the hours before it: (keys, origin, forecast).

    Smoothing is a chain of affine maps level → a·level + b. Hours compose to
    days, days to months, months to the series, so no group is longer than 24,
    31 or the number of months.
    """
    rows = df.select(*keys, ts, F.col(y).alias("_y"), F.date_trunc("day", ts).alias("_day"))
    pa, da = F.lit(1.0 - alpha_p), F.lit(1.0 - alpha_d)
    hour = F.struct(
        F.col(ts).alias("t"),
        pa.alias("pa"), (F.lit(alpha_p) * (F.col("_y") > 0).cast("double")).alias("pb"),
        F.when(F.col("_y") > 0, da).otherwise(F.lit(1.0)).alias("da"),
        F.when(F.col("_y") > 0, F.lit(alpha_d) * F.col("_y")).otherwise(F.lit(0.0)).alias("db"),
    )
    unit = F.struct(F.lit(1.0).alias("pa"), F.lit(0.0).alias("pb"), F.lit(1.0).alias("da"), F.lit(0.0).alias("db"))

    def fold(items: Column) -> Column:
        return F.aggregate(
            items, unit,
            lambda a, m: F.struct(
                (a["pa"] * m["pa"]).alias("pa"), (m["pa"] * a["pb"] + m["pb"]).alias("pb"),
                (a["da"] * m["da"]).alias("da"), (m["da"] * a["db"] + m["db"]).alias("db"),
            ),
        )

    days = rows.groupBy(*keys, "_day").agg(fold(F.sort_array(F.collect_list(hour))).alias("m"))
    first = rows.groupBy(*keys).agg(
        F.min_by((F.col("_y") > 0).cast("double"), ts).alias("_p0"),
        F.coalesce(F.min_by("_y", F.when(F.col("_y") > 0, F.col(ts))), F.lit(0.0)).alias("_d0"),
    )
    days = days.withColumn("_month", F.date_trunc("month", "_day"))
    item = F.struct(F.col("_day").alias("t"), F.col("m.pa"), F.col("m.pb"), F.col("m.da"), F.col("m.db"))
    months = days.groupBy(*keys, "_month").agg(fold(F.sort_array(F.collect_list(item))).alias("mm"))
    earlier = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*keys, "_month", fold(F.collect_list("mm").over(earlier)).alias("_before"))
    inside = Window.partitionBy(*keys, "_month").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    state = join_null_safe(
        join_null_safe(days.withColumn("_in", fold(F.collect_list("m").over(inside))), months, [*keys, "_month"]), first, keys
    )

    def level(a: str, b: str, start: str) -> Column:
        before = F.col(f"_before.{a}") * F.col(start) + F.col(f"_before.{b}")
        return F.col(f"_in.{a}") * before + F.col(f"_in.{b}")

    return state.select(
        *keys,
        F.expr("_day + INTERVAL 1 DAY").alias("origin"),
        (level("pa", "pb", "_p0") * level("da", "db", "_d0")).alias("forecast"),
    )


def over_horizon(df: DataFrame, horizon: int = 24, origin: str = "origin") -> DataFrame:
    """One row per hour of the horizon with the same forecast."""
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "ds", F.expr(f"{origin} + make_dt_interval(0, horizon - 1)")
    )


def sweep(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str],
    settings: Sequence[tuple[str, float, float]], ts: str = "ds", prepare=None,
) -> DataFrame:
    """Every setting on every rolling window in one plan: fit on train rows, predict test rows.

    ``prepare`` changes the rows of the windows first (DataFrame to DataFrame).
    """
    from tidegrid.operators.frames import window_roles

    rows = window_roles(df, windows, ts=ts)
    if prepare is not None:
        rows = prepare(rows)
    by = ["window_index", *keys]
    coef = fit_linear(rows.where("role = 'train'"), by, x, y, settings)
    return predict_linear(rows.where("role = 'test'"), coef, by, x, ts)
