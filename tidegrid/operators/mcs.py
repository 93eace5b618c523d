"""Model Confidence Set over many series, each row moved once.

With equal blocks a series is one row: its losses and the starts of all blocks. The task that holds it takes the block totals
from prefix sums, so no replicate becomes a row. The order of elimination depends only on the mean losses and the second moments
of the replicate losses; with the order known, the replicates beyond the test value of every round are counted at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.bootstrap import (
    Draw,
    _spread,
    fixed_blocks,
    hashed_draw,
    prefix_table,
    replicate_sums,
    series_sizes,
    stationary_blocks,
    wide_rows,
)
from tidegrid.operators.chunked import join_null_safe


def absolute_loss(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def _rounds(method: str):
    """Function of one series' replicate losses around the mean losses ``d``: order of elimination and p-value by round.

    Defined inside so that executors get it by value.
    """

    def elimination_order(second: np.ndarray, mean: np.ndarray) -> list[int]:
        alive, out = list(range(len(mean))), []
        while len(alive) > 1:
            k = len(alive)
            scale = k / (k - 1)
            # contrast of each model with the average of those still alive
            contrast = (np.eye(k) - np.full((k, k), 1.0 / k)) * scale
            spread = np.sqrt(np.diag(contrast @ second[np.ix_(alive, alive)] @ contrast.T))
            excess = contrast @ mean[alive]
            with np.errstate(divide="ignore", invalid="ignore"):
                worst = int(np.argmax(excess / spread))
            out.append(alive.pop(worst))
        return out + alive

    def rounds(c: np.ndarray, d: np.ndarray) -> tuple[list[int], list[float]]:
        m = len(d)
        order = elimination_order(c.T @ c / len(c), d)
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
        size = np.square if method == "SQ" else np.abs
        boot, seen = np.empty((len(pairs), len(c))), np.empty((len(pairs), 1))
        for at, (i, j) in enumerate(pairs):
            gap = c[:, j] - c[:, i]
            sd = np.sqrt(np.mean(gap * gap))
            if sd == 0:
                raise ZeroDivisionError("two models have the same loss in every replicate")
            boot[at], seen[at] = size(gap / sd), size((d[j] - d[i]) / sd)
        total = np.sum if method == "SQ" else np.max
        p = []
        for r in range(m - 1):
            alive = set(order[r:])
            at = [x for x, pair in enumerate(pairs) if alive.issuperset(pair)]
            p.append(float(np.mean(total(boot[at], axis=0) > total(seen[at], axis=0))))
        return order, np.maximum.accumulate([*p, 1.0]).tolist()

    return rounds


#: Blocks of a series that a task draws at once.
STARTS = 250_000


def _block_rounds(
    rows: DataFrame, keys: Sequence[str], losses: Sequence[Column], reps: int, length: Column, draw: Draw, method: str
) -> DataFrame:
    """(keys, _order, _p) by circular blocks of ``length`` rows.

    A series is a row: the calendar bounds its hours. Its replicates come in ranges of at most ``STARTS`` blocks, one after another in the
    task that has the series; a task holds one series and a range. A ``draw`` that has ``numbers`` is asked there, another one's
    starts travel with the row.
    """
    keys, m = list(keys), len(losses)
    known = F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in losses])
    # as many entries as a series has hours, and as an array of models
    hours = F.sort_array(F.collect_list(F.struct("ds", known.alias("l"))))
    # few bytes become many blocks: dealt to all tasks, however small they look
    series = _spread(rows, keys).groupBy(*keys).agg(hours.alias("_h"), F.count(F.lit(1)).alias("n")).withColumn("_len", length.cast("long"))
    series = series.where(F.assert_true(F.col("n") >= F.col("_len"), F.lit("block longer than the series")).isNull())
    count = F.ceil(F.col("n") / F.col("_len")).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(STARTS) / F.col("_count")).cast("int"))
    ranges = series.withColumn("_count", count).select(
        *keys, "n", "_len", "_count", F.flatten(F.transform("_h", lambda h: h["l"])).alias("_l"), step.alias("_step"),
        F.explode(F.sequence(F.lit(0), F.lit(reps - 1), step)).alias("_first"),
    ).withColumn("_reps", F.least(F.col("_step"), F.lit(reps) - F.col("_first")))

    def start(i: Column) -> Column:
        rep = F.col("_first") + F.floor(i / F.col("_count")).cast("int")
        return F.pmod(draw(rep, F.pmod(i, F.col("_count"))), F.col("n")).cast("int")

    numbers = getattr(draw, "numbers", None)
    starts = F.lit(None).cast("array<int>") if numbers else F.transform(F.sequence(F.lit(0), F.col("_reps") * F.col("_count") - 1), start)
    own = [f"_k{i}" for i in range(len(keys))]
    ranges = ranges.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "n", "_len", "_count", "_first", "_reps", "_l", starts.alias("_s"))
    rounds = _rounds(method)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[np.ndarray] = []
        for batch in batches:
            at, orders, ps = [], [], []
            for i in range(batch.num_rows):
                n, size, count, first, some = (batch.column(c)[i].as_py() for c in ("n", "_len", "_count", "_first", "_reps"))
                flat = batch.column("_l")[i].values.to_numpy(zero_copy_only=False).reshape(n, m)
                if numbers:
                    begin = numbers(np.arange(first, first + some)[:, None], np.arange(count)[None, :]) % n
                else:
                    begin = batch.column("_s")[i].values.to_numpy(zero_copy_only=False).reshape(some, count)
                # sums of the rows from each start on, past the end from the front again
                prefix = np.vstack([np.zeros(m), np.cumsum(np.vstack([flat, flat]), axis=0)])
                last = n - (count - 1) * size
                sums = (prefix[last : last + n] - prefix[:n])[begin[:, -1]]
                if count > 1:
                    sums = sums + (prefix[size : size + n] - prefix[:n])[begin[:, :-1]].sum(axis=1)
                d = prefix[n] / n
                done.append(sums / n - d)
                if first + some == reps:
                    order, p = rounds(np.vstack(done), d)
                    at.append(i)
                    orders.append(order)
                    ps.append(p)
                    done = []
            found = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(found.column(o) for o in own), pa.array(orders, pa.list_(pa.int32())), pa.array(ps, pa.list_(pa.float64()))],
                [*own, "_order", "_p"],
            )

    fields = [T.StructField(o, rows.schema[k].dataType) for k, o in zip(keys, own)]
    more = [T.StructField("_order", T.ArrayType(T.IntegerType())), T.StructField("_p", T.ArrayType(T.DoubleType()))]
    return ranges.mapInArrow(run, T.StructType([*fields, *more])).withColumnsRenamed(dict(zip(own, keys)))


def _rounds_of(method: str):
    """UDF: order and p-values from a series' replicates and mean losses."""
    one = _rounds(method)

    @F.pandas_udf("_order array<int>, _p array<double>")
    def rounds(c: pd.Series, d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(np.array(x.tolist(), dtype=float), np.asarray(y, dtype=float)) for x, y in zip(c, d)], columns=["_order", "_p"])

    return rounds


def replicate_losses(
    df: DataFrame,
    keys: Sequence[str],
    models: Sequence[str],
    loss: Callable[[Column, Column], Column] = absolute_loss,
    reps: int = 5000,
    block_len: Column | None = None,
    variant: str = "block",
    draw: Draw | None = None,
) -> DataFrame:
    """(keys, rep, c, d): replicate mean losses minus the sample mean, and the sample mean losses."""
    draw = draw or hashed_draw(23, keys)
    length = block_len if block_len is not None else F.floor(F.sqrt("n"))
    cols = {f"l{i}": loss(F.col("y"), F.col("f")[i]) for i in range(len(models))}
    prefix = prefix_table(wide_rows(df, keys, models), keys, cols)
    sizes = series_sizes(prefix, keys)
    if variant == "block":
        blocks = fixed_blocks(sizes, keys, reps, length, draw, circular=True)
    elif variant == "stationary":
        blocks = stationary_blocks(sizes, keys, reps, length, draw)
    else:
        raise ValueError("variant is 'block' or 'stationary'")
    sums = replicate_sums(prefix, blocks, keys, list(cols))
    ends = prefix.groupBy(*keys).agg(
        F.max("pos").alias("n"),
        F.array(*[F.max_by(c, "pos") for c in cols]).alias("_t"),
    )
    mean = F.transform("_t", lambda x: x / F.col("n"))
    out = join_null_safe(sums, ends, keys).select(
        *keys, "rep", F.array(*[F.col(c) / F.col("n") for c in cols]).alias("_b"), mean.alias("d")
    )
    return out.withColumn("c", F.zip_with("_b", "d", lambda b, d: b - d)).drop("_b")


def model_confidence_set(
    df: DataFrame,
    keys: Sequence[str],
    models: Sequence[str],
    alpha: float = 0.25,
    loss: Callable[[Column, Column], Column] = absolute_loss,
    reps: int = 5000,
    block_len: Column | None = None,
    variant: str = "block",
    method: str = "R",
    draw: Draw | None = None,
) -> DataFrame:
    """(keys, model, round, p_value, included) for every series."""
    if method not in ("R", "SQ"):
        raise ValueError("method is 'R' or 'SQ'")
    if variant == "block":
        own = [loss(F.col("y"), F.col("f")[i]) for i in range(len(models))]
        length = block_len if block_len is not None else F.floor(F.sqrt("n"))
        found = _block_rounds(wide_rows(df, keys, models), keys, own, reps, length, draw or hashed_draw(23, keys), method)
    else:
        losses = replicate_losses(df, keys, models, loss, reps, block_len, variant, draw)
        # as many entries as replicates
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("rep", "c"))), lambda x: x["c"])
        series = losses.groupBy(*keys).agg(ordered.alias("_c"), F.first("d").alias("_d"))
        found = series.select(*keys, _rounds_of(method)("_c", "_d").alias("_z")).select(*keys, "_z._order", "_z._p")
    names = F.array(*[F.lit(x) for x in models])
    # at most one row per model and series
    return found.select(*keys, "_order", F.posexplode("_p").alias("round", "p_value")).select(
        *keys, F.get(names, F.get("_order", F.col("round"))).alias("model"), "round", "p_value",
    ).withColumn("included", F.col("p_value") >= alpha)


def inclusion_rate(mcs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of the series that keep a model."""
    return mcs.groupBy(*group, "model").agg(F.avg(F.col("included").cast("int")).alias("inclusion"))


def inclusion_marks(mcs: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per series, a mark per model."""
    return mcs.groupBy(*keys).pivot("model", list(models)).agg(
        F.max(F.when(F.col("included"), "x").otherwise(""))
    )
