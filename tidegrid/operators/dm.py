"""Diebold–Mariano tests of many series and models at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.stats import two_sided_p
from tidegrid.operators.bootstrap import wide_rows
from tidegrid.operators.chunked import (
    CHUNK,
    HOME,
    POS,
    chunk_window,
    home_rows,
    hour_index,
    join_null_safe,
    row_position,
    with_halo,
)


def dm_test(
    df: DataFrame, keys: Sequence[str], d: Column, horizon: int = 24, ts: str = "ds", dense: bool = False
) -> DataFrame:
    """Statistic and p-value of the mean loss difference ``d`` per group.

    The lags sit in chunks with a halo of ``horizon`` − 1 rows; one aggregation
    gives the variance and every autocovariance. ``dense`` says the rows form a
    complete hourly grid, so positions need no extra pass.
    """
    rows = df.select(*keys, ts, d.alias("_d"))
    if dense:
        pos = hour_index(ts)
    else:
        rows = row_position(rows, keys, [ts], F.date_trunc("month", ts))
        pos = F.col(POS)
    lag = horizon - 1
    rows = with_halo(rows, pos, before=max(lag, 0))
    w = chunk_window(keys)
    rows = home_rows(rows.select("*", *[F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, lag + 1)]))
    stats = rows.groupBy(*keys).agg(
        F.avg("_d").alias("_mean"),
        F.count("_d").alias("n"),
        F.var_samp("_d").alias("_v0"),
        *[F.covar_samp(f"_d{k}", "_d").alias(f"_c{k}") for k in range(1, lag + 1)],
    )
    var = F.col("_v0")
    for k in range(1, lag + 1):
        var = var + F.lit(2.0 * (1.0 - k / horizon)) * F.col(f"_c{k}")
    stat = F.when(var > 0, F.col("_mean") / F.sqrt(var / F.col("n")))
    return stats.select(*keys, "n", stat.alias("dm_statistic")).withColumn(
        "p_value", two_sided_p(F.col("dm_statistic"))
    )


def compare_sets(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tso", "unique_id", "model"),
    horizon: int = 24, dense: bool = False,
) -> DataFrame:
    """Same models in two prediction sets, paired on their keys.

    Both sets move in the join: a set that is made of a smaller table looks small enough to broadcast, what it becomes is not.
    """
    on = [*keys, "ds", "horizon"]
    pair = join_null_safe(a.select(*on, "y", F.col("y_pred").alias("_p1")).hint("merge"), b.select(*on, F.col("y_pred").alias("_p2")), on)
    e1, e2 = F.col("y") - F.col("_p1"), F.col("y") - F.col("_p2")
    return dm_test(pair, keys, e1 * e1 - e2 * e2, horizon, "ds", dense)


def loss_moments(rows: DataFrame, keys: Sequence[str], losses: int, lag: int, pos: Column) -> DataFrame:
    """(keys, moments): for every lag the number of row pairs, the sums of the earlier and of the later losses, and the sums of their products.

    ``rows`` has an array ``_l`` of losses. A task sees one series and chunk with the ``lag`` rows before it and leaves one array.
    """
    width = 1 + 2 * losses + losses * losses

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(POS)
        own = np.flatnonzero(group[HOME].to_numpy())
        flat = group["_l"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        loss = flat.reshape(-1, losses)
        known = ~np.isnan(loss).any(axis=1)
        out = np.zeros((lag + 1, width))
        for k in range(lag + 1):
            late = own[own >= k]
            late = late[known[late] & known[late - k]]
            x, y = loss[late - k], loss[late]
            out[k] = np.concatenate([[len(late)], x.sum(axis=0), y.sum(axis=0), (x.T @ y).ravel()])
        found = {k: group[k].slice(0, 1) for k in keys}
        return pa.table(found | {"_m": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    fields = [f for k in keys for f in rows.schema.fields if f.name == k]
    schema = T.StructType([*fields, T.StructField("_m", T.ArrayType(T.DoubleType()))])
    parts = with_halo(rows, pos, before=lag).groupBy(*keys, CHUNK).applyInArrow(run, schema)
    cells = parts.select(*keys, F.posexplode("_m").alias("_at", "_s")).groupBy(*keys, "_at").agg(F.sum("_s").alias("_s"))
    # as many entries as an array has
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda c: c["_s"])
    return cells.groupBy(*keys).agg(ordered.alias("moments"))


def _pair_statistics(losses: int, horizon: int):
    """UDF: statistics of all pairs of losses from their moments, null without variance."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def statistics(moments: pd.Series) -> pd.Series:
        def one(flat) -> list[float | None]:
            m = np.asarray(flat, dtype=float).reshape(-1, 1 + 2 * losses + losses * losses)
            n, early, late = m[:, 0], m[:, 1 : 1 + losses], m[:, 1 + losses : 1 + 2 * losses]
            both = m[:, 1 + 2 * losses :].reshape(-1, losses, losses)
            with np.errstate(divide="ignore", invalid="ignore"):
                c = (both - early[:, :, None] * late[:, None, :] / n[:, None, None]) / (n - 1)[:, None, None]
                mean = early[0] / n[0]
            out = []
            for i in range(losses):
                for j in range(i + 1, losses):
                    d = c[:, i, i] - c[:, i, j] - c[:, j, i] + c[:, j, j]
                    var = d[0] + sum(2.0 * (1.0 - k / horizon) * d[k] for k in range(1, len(d)))
                    out.append(float((mean[i] - mean[j]) / np.sqrt(var / n[0])) if var > 0 else None)
            return out

        return pd.Series([one(f) for f in moments])

    return statistics


def pairwise(
    df: DataFrame, keys: Sequence[str], models: Sequence[str], horizon: int = 24, dense: bool = False
) -> DataFrame:
    """Upper triangle of model against model, with the diagonal 0 / 1.

    The covariance of two loss differences is a sum of covariances of losses, so one set of moments of all models' losses
    serves every pair and rows are not copied for pairs.
    """
    keys = list(keys)
    gap = lambda f: F.col("y") - f
    rows = wide_rows(df, keys, models).select(*keys, "ds", F.transform("f", lambda f: gap(f) * gap(f)).alias("_l"))
    if dense:
        pos = hour_index("ds")
    else:
        rows = row_position(rows, keys, ["ds"], F.date_trunc("month", "ds"))
        pos = F.col(POS)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    names = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(b).alias("rival")) for a, b in pairs])
    stats = loss_moments(rows, keys, len(models), max(horizon - 1, 0), pos).withColumn("_t", _pair_statistics(len(models), horizon)("moments"))
    tests = stats.select(*keys, F.explode(F.arrays_zip(names.alias("pair"), F.col("_t").alias("t"))).alias("_z")).select(
        *keys, "_z.pair.model", "_z.pair.rival", F.col("_z.t").alias("dm_statistic")
    ).withColumn("p_value", two_sided_p(F.col("dm_statistic")))
    diagonal = df.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    ).select(
        *keys, "model", F.col("model").alias("rival"), F.lit(0.0).alias("dm_statistic"), F.lit(1.0).alias("p_value")
    )
    return tests.unionByName(diagonal)


def rejection_shares(
    tests: DataFrame, classes: DataFrame, series: Sequence[str], group: Sequence[str] = ("model",),
    alpha: float = 0.05, lower_better: bool = False,
) -> DataFrame:
    """Share of series with an expected and an unexpected rejection per model and class."""
    j = tests.join(classes.select(*series, "sparsity_class"), list(series), "left")
    sig = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    up, down = F.col("dm_statistic") > 0, F.col("dm_statistic") < 0
    good, bad = (down, up) if lower_better else (up, down)
    return j.groupBy(*group, "sparsity_class").agg(
        F.avg((sig & good).cast("int")).alias("expected"),
        F.avg((sig & bad).cast("int")).alias("unexpected"),
    )
