"""Autocorrelation, unit-root and whiteness statistics per series on the hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.stats import chi2_tail
from tidegrid.operators.chunked import chunk_window, home_rows, hour_index, join_null_safe, running_sum, with_halo


def centred(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Adds ``_c``: value minus the mean of its series (one row per series is joined)."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("_mean"))
    return join_null_safe(df, means, keys).withColumn("_c", F.col(y) - F.col("_mean"))


def _lagged(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], ts: str) -> DataFrame:
    rows = with_halo(df, hour_index(ts), before=max(lags))
    w = chunk_window(keys)
    return home_rows(rows.select("*", *[F.lag(value, k).over(w).alias(f"_l{k}") for k in lags]))


def acf(df: DataFrame, keys: Sequence[str], nlags: int = 48, y: str = "y", ts: str = "ds") -> DataFrame:
    """(keys, n, acf): autocorrelations 0 … nlags as an array."""
    lags = list(range(1, nlags + 1))
    rows = _lagged(centred(df, keys, y), keys, "_c", lags, ts)
    sums = rows.groupBy(*keys).agg(
        F.count("_c").alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags],
    )
    r = [F.lit(1.0)] + [F.coalesce(F.try_divide(F.col(f"_s{k}"), F.col("_s0")), F.lit(0.0)) for k in lags]
    return sums.select(*keys, "n", F.array(*r).alias("acf"))


def yule_walker():
    """UDF, defined inside so that executors get it by value."""
    arrays = T.ArrayType(T.DoubleType())

    @F.pandas_udf(T.StructType([T.StructField("pacf", arrays), T.StructField("phi", arrays)]))
    def walk(acf_arrays: pd.Series) -> pd.DataFrame:
        """Partial autocorrelations and the AR coefficients of the full order, per short array."""

        def solve(r: np.ndarray) -> tuple[list[float], list[float]]:
            partial, phi = [1.0], np.zeros(0)
            for k in range(1, len(r)):
                gain = r[k] - phi @ r[1:k][::-1]
                scale = 1.0 - phi @ r[1:k]
                last = gain / scale if scale else 0.0
                phi = np.append(phi - last * phi[::-1], last)
                partial.append(float(last))
            return partial, phi.tolist()

        out = [solve(np.asarray(a, dtype=float)) for a in acf_arrays]
        return pd.DataFrame(out, columns=["pacf", "phi"])

    return walk


def acf_pacf(df: DataFrame, keys: Sequence[str], nlags: int = 48, y: str = "y", ts: str = "ds") -> DataFrame:
    """Long (keys, lag, acf, pacf, bound) with the 95 % bound of white noise."""
    a = acf(df, keys, nlags, y, ts).withColumn("_yw", yule_walker()("acf"))
    return a.select(
        *keys,
        (F.lit(1.96) / F.sqrt("n")).alias("bound"),
        F.posexplode(F.arrays_zip(F.col("acf"), F.col("_yw.pacf").alias("pacf"))).alias("lag", "z"),
    ).select(*keys, "lag", F.col("z.acf").alias("acf"), F.col("z.pacf").alias("pacf"), "bound")


def kpss(df: DataFrame, keys: Sequence[str], lags: int = 24, y: str = "y", ts: str = "ds") -> DataFrame:
    """KPSS level statistic with Bartlett weights, and the published 5 % critical value."""
    c = centred(df, keys, y)
    run = running_sum(c, keys, ts, F.date_trunc("quarter", ts), {"_s": F.col("_c")})
    rows = _lagged(run, keys, "_c", list(range(1, lags + 1)), ts)
    sums = rows.groupBy(*keys).agg(
        F.count("_c").alias("n"),
        F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        F.sum(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lags + 1)],
    )
    long_run = F.col("_g0")
    for k in range(1, lags + 1):
        long_run = long_run + F.lit(2.0 * (1.0 - k / (lags + 1.0))) * F.col(f"_g{k}")
    n = F.col("n")
    stat = F.try_divide(F.col("_ss") / (n * n), long_run / n)
    return sums.select(*keys, stat.alias("kpss"), (stat > 0.463).alias("rejects_level"))


def _first_t():
    """UDF, defined inside so that executors get it by value."""

    @F.pandas_udf(T.DoubleType())
    def first_t(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        """t statistic of the first coefficient from centred cross products of one series."""

        def t(a, b, s, rows) -> float:
            b = np.asarray(b, dtype=float)
            k = len(b)
            m = np.asarray(a, dtype=float).reshape(k, k)
            try:
                inv = np.linalg.inv(m)
            except np.linalg.LinAlgError:
                return float("nan")
            beta = inv @ b
            rss = s - beta @ b
            return float(beta[0] / np.sqrt(rss / (rows - k - 1) * inv[0, 0]))

        return pd.Series([t(*v) for v in zip(xx, xy, yy, n)])

    return first_t


def adf(df: DataFrame, keys: Sequence[str], lags: int = 24, y: str = "y", ts: str = "ds") -> DataFrame:
    """Dickey–Fuller t statistic with constant and ``lags`` differences, 5 % critical value −2.86.

    The regression is one aggregation of covariances per series; only its small
    matrix is solved in Python.
    """
    first = _lagged(df, keys, y, [1], ts).withColumn("_dy", F.col(y) - F.col("_l1"))
    rows = first.withColumn("_x0", F.col("_l1")).drop("_l1")
    if lags:
        rows = _lagged(rows, keys, "_dy", list(range(1, lags + 1)), ts)
    names = ["_x0"] + [f"_l{k}" for k in range(1, lags + 1)]
    rows = rows.dropna(subset=["_dy", *names])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.var_pop("_dy") * F.count("_dy")).alias("_yy"),
        *[(F.covar_pop(names[i], names[j]) * F.count("_dy")).alias(f"_c{i}_{j}") for i, j in pairs],
        *[(F.covar_pop(c, "_dy") * F.count("_dy")).alias(f"_b{i}") for i, c in enumerate(names)],
    )
    k = len(names)
    xx = F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    xy = F.array(*[F.col(f"_b{i}") for i in range(k)])
    stat = _first_t()(xx, xy, F.col("_yy"), F.col("n"))
    return sums.select(*keys, "n", stat.alias("adf")).withColumn("rejects_unit_root", F.col("adf") < -2.86)


def ar_residuals(df: DataFrame, keys: Sequence[str], order: int = 1, y: str = "y", ts: str = "ds") -> DataFrame:
    """Residuals of an AR model with Yule–Walker coefficients; the first ``order`` rows are null."""
    coef = acf(df, keys, order, y, ts).select(*keys, yule_walker()("acf")["phi"].alias("_phi"))
    rows = join_null_safe(_lagged(centred(df, keys, y), keys, "_c", list(range(1, order + 1)), ts), coef, keys)
    fit: Column = F.lit(0.0)
    for k in range(1, order + 1):
        fit = fit + F.col("_phi")[k - 1] * F.col(f"_l{k}")
    return rows.select(*keys, ts, (F.col("_c") - fit).alias("residual"))


def ljung_box(
    df: DataFrame, keys: Sequence[str], lags: int = 24, value: str = "residual", ts: str = "ds"
) -> DataFrame:
    """Ljung–Box statistic, its p-value, mean and standard deviation of the residuals."""
    kept = df.where(F.col(value).isNotNull())
    a = acf(kept, keys, lags, value, ts)
    moments = kept.groupBy(*keys).agg(
        F.avg(value).alias("residual_mean"), F.stddev_samp(value).alias("residual_std")
    )
    n = F.col("n")
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.pow(F.col("acf")[k], 2) / (n - k)
    return (
        join_null_safe(a, moments, keys)
        .withColumn("ljung_box", n * (n + 2) * q)
        .withColumn("p_value", chi2_tail(F.col("ljung_box"), lags))
        .select(*keys, "ljung_box", "p_value", "residual_mean", "residual_std")
    )
