"""Block bootstrap over prefix sums.

A block total is a difference of two prefix sums, so a replicate needs two or
three joined rows per block instead of one row per resampled hour. Replicates
spread a long series over many tasks: the exchange is by (series, position)
and by (series, replicate), never by the series alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import fbeta
from tidegrid.operators.chunked import join_null_safe, running_sum
from tidegrid.session import cut_lineage

Draw = Callable[[Column, Column], Column]


def hashed_draw(seed: int, keys: Sequence[str]) -> Draw:
    """Non-negative pseudo-random integer of (series, replicate, block)."""
    return lambda rep, block: F.shiftrightunsigned(
        F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], rep, block), 1
    )


def integer_draw(seed: int) -> Draw:
    """Plain integer arithmetic that any SQL engine can repeat, and ``numbers``, the same of NumPy arrays."""

    def draw(rep: Column, block: Column) -> Column:
        return rep.cast("long") * 7919 + block.cast("long") * 104729 + F.lit(seed)

    draw.numbers = lambda rep, block: rep * 7919 + block * 104729 + seed
    return draw


def wide_rows(df: DataFrame, keys: Sequence[str], models: Sequence[str], ts: str = "ds") -> DataFrame:
    """One row per (keys, ts) that every model has: y and an array of forecasts in the order of ``models``.

    A model with two forecasts for one row fails.
    """
    own = [F.when(F.col("model") == m, F.col("y_pred")) for m in models]
    rows = df.groupBy(*keys, ts).agg(
        F.max("y").alias("y"), F.array(*[F.max(c) for c in own]).alias("f"), F.greatest(F.lit(0), *[F.count(c) for c in own]).alias("_most")
    )
    twice = F.raise_error(F.lit("two forecasts of one model for one row")).cast("array<double>")
    rows = rows.where(F.forall("f", lambda x: x.isNotNull()))
    return rows.withColumn("f", F.when(F.col("_most") > 1, twice).otherwise(F.col("f"))).drop("_most")


def prefix_table(
    rows: DataFrame, keys: Sequence[str], cols: dict[str, Column], ts: str = "ds"
) -> DataFrame:
    """(keys, pos = 1 … n, running sums). Written to the shared folder once, then read three times."""
    out = running_sum(
        rows, keys, ts, F.date_trunc("month", ts), {"pos": F.lit(1), **cols}
    ).select(*keys, F.col("pos").cast("long").alias("pos"), *cols)
    return cut_lineage(out)


def _spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def series_sizes(prefix: DataFrame, keys: Sequence[str]) -> DataFrame:
    return prefix.groupBy(*keys).agg(F.max("pos").alias("n"))


def fixed_blocks(
    sizes: DataFrame, keys: Sequence[str], reps: int, block_len: Column | int, draw: Draw, circular: bool
) -> DataFrame:
    """(keys, rep, start, len): equal blocks, the last one cut so that a replicate has n rows."""
    length = F.lit(block_len) if isinstance(block_len, int) else block_len
    sized = sizes.withColumn("_l", length.cast("long")).where(
        F.assert_true(F.col("n") >= F.col("_l"), F.lit("block longer than the series")).isNull()
    )
    replicate = _spread(
        sized.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))), [*keys, "rep"]
    )
    room = F.col("n") if circular else F.col("n") - F.col("_l") + 1
    return (
        replicate.withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("_l")).cast("int") - 1))
        )
        .withColumn("start", F.pmod(draw(F.col("rep"), F.col("_block")), room))
        .withColumn("len", F.least(F.col("_l"), F.col("n") - F.col("_block") * F.col("_l")))
        .select(*keys, "n", "rep", "start", "len")
    )


def stationary_blocks(
    sizes: DataFrame, keys: Sequence[str], reps: int, mean_len: Column, draw: Draw
) -> DataFrame:
    """Blocks of geometric length on the circle: each row begins a new block with probability 1/mean_len.

    Lengths come from the inverse of their distribution, one draw a block, so a replicate costs about n / mean_len rows. Nearly always the
    first handful of blocks beyond that number covers the series; a replicate that they don't cover draws on, n blocks at most.
    """
    from pyspark.sql import Window

    replicate = _spread(
        sizes.withColumn("_l", mean_len).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))),
        [*keys, "rep"],
    )
    stop = F.lit(1.0) / F.col("_l")

    def length(block: Column) -> Column:
        u = F.pmod(draw(F.col("rep"), block * 2 + 1), F.lit(1_000_003)) / F.lit(1_000_003.0)
        return F.when(stop >= 1, F.lit(1)).otherwise(F.floor(F.log(1 - u) / F.log(1 - stop)) + 1).cast("long")

    def covered(blocks: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), blocks - 1), F.lit(0).cast("long"), lambda a, block: a + length(block))

    usual = F.least(F.col("n"), F.ceil(F.col("n") * stop + 4 * F.sqrt(F.col("n") * stop) + 8)).cast("int")
    drawn = (
        replicate.withColumn("_m", usual)
        .withColumn("_m", F.when(covered(F.col("_m")) >= F.col("n"), F.col("_m")).otherwise(F.col("n")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("_len", length(F.col("_block")))
    )
    w = Window.partitionBy(*keys, "rep").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = drawn.withColumn("_at", F.coalesce(F.sum("_len").over(w), F.lit(0))).where(F.col("_at") < F.col("n"))
    return blocks.select(
        *keys, "n", "rep", F.pmod(draw(F.col("rep"), F.col("_block") * 2), F.col("n")).alias("start"),
        F.least(F.col("_len"), F.col("n") - F.col("_at")).alias("len"),
    )


def replicate_sums(
    prefix: DataFrame, blocks: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Sums of the resampled rows per (keys, rep); a block past the end wraps to the front.

    Both sides move in the join: the blocks' size before they are exploded looks small enough to broadcast, what they become is not.
    """
    end = F.col("start") + F.col("len")
    points = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")),
        F.struct(F.least(end, F.col("n")).alias("pos"), F.lit(1).alias("sign")),
        F.struct(F.greatest(end - F.col("n"), F.lit(0)).alias("pos"), F.lit(1).alias("sign")),
    )
    marks = (
        blocks.select(*keys, "rep", F.explode(points).alias("p"))
        .select(*keys, "rep", F.col("p.pos").cast("long").alias("pos"), F.col("p.sign").alias("sign"))
        .where("pos > 0")
    )
    return join_null_safe(marks.hint("merge"), prefix, [*keys, "pos"]).groupBy(*keys, "rep").agg(
        *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in cols]
    )


def fbeta_replicates(
    df: DataFrame,
    keys: Sequence[str],
    models: Sequence[str],
    block_len: int = 24,
    reps: int = 1000,
    beta: float = 2.0,
    draw: Draw | None = None,
) -> DataFrame:
    """F-beta of each model in each replicate: (keys, rep, f array in the order of ``models``)."""
    draw = draw or hashed_draw(7, keys)
    rows = wide_rows(df, keys, models)
    on = F.col("y") > 0
    cols: dict[str, Column] = {}
    for i in range(len(models)):
        hit = F.coalesce(F.col("f")[i] > 0, F.lit(False))
        cols[f"tp{i}"] = (on & hit).cast("long")
        cols[f"fp{i}"] = (~on & hit).cast("long")
        cols[f"fn{i}"] = (on & ~hit).cast("long")
    prefix = prefix_table(rows, keys, cols)
    blocks = fixed_blocks(series_sizes(prefix, keys), keys, reps, block_len, draw, circular=False)
    sums = replicate_sums(prefix, blocks, keys, list(cols))
    return sums.select(
        *keys,
        "rep",
        F.array(
            *[fbeta(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}"), beta) for i in range(len(models))]
        ).alias("f"),
    )


def fbeta_deltas(replicates: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Long (keys, rep, model, delta): distance to the best model of the replicate."""
    names = F.array(*[F.lit(m) for m in models])
    return replicates.select(
        *keys, "rep", F.array_max("f").alias("_best"), F.explode(F.arrays_zip(names.alias("model"), F.col("f").alias("f"))).alias("z")
    ).select(*keys, "rep", F.col("z.model").alias("model"), (F.col("z.f") - F.col("_best")).alias("delta"))


def superiority(replicates: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Long (keys, model, rival, p): share of replicates won, ties count half."""
    n = len(models)
    pairs = [(i, j) for i in range(n) for j in range(n)]

    def won(i: int, j: int) -> Column:
        a, b = F.col("f")[i], F.col("f")[j]
        return F.avg(F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0))

    wide = replicates.groupBy(*keys).agg(*[won(i, j).alias(f"p{i}_{j}") for i, j in pairs])
    cells = F.array(
        *[
            F.struct(
                F.lit(models[i]).alias("model"), F.lit(models[j]).alias("rival"),
                F.col(f"p{i}_{j}").alias("p"),
            )
            for i, j in pairs
        ]
    )
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.model", "c.rival", "c.p")


def acceptance(
    replicates: DataFrame, keys: Sequence[str], models: Sequence[str], eps: float = 0.05, alpha: float = 0.05
) -> DataFrame:
    """A model is accepted when it stays within ``eps`` of the best in 1 − alpha of the replicates."""
    d = fbeta_deltas(replicates, keys, models)
    share = F.avg((F.col("delta") >= -eps).cast("int"))
    return d.groupBy(*keys, "model").agg(
        share.alias("share"), (share >= 1 - alpha).alias("accepted")
    )


def dominance(sup: DataFrame, series: Sequence[str], slices: Sequence[str] = ()) -> DataFrame:
    """Share of rivals beaten with probability over one half, mean over the series."""
    per = sup.groupBy(*slices, *series, "model").agg(
        (F.sum((F.col("p") > 0.5).cast("int")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("d")
    )
    return per.groupBy(*slices, "model").agg(F.avg("d").alias("dominance"))


def mean_interval(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], bucket: Column,
    reps: int = 500, alpha: float = 0.05, draw: Draw | None = None, seed: int = 11,
) -> DataFrame:
    """Percentile interval of the mean from independent draws of single rows.

    Without ``draw`` no row is joined: see ``drawn_sums``. A ``draw`` of (replicate, number) names every drawn position itself
    and joins replicates with rows, for draws that have to be repeated elsewhere.
    """
    if draw is None:
        sums = drawn_sums(df, keys, value, order, bucket, reps, seed)
        means = sums.withColumn("_m", F.try_divide("sum", "n"))
    else:
        from tidegrid.operators.chunked import row_position

        rows = cut_lineage(
            row_position(df, keys, order, bucket, "pos").select(*keys, "pos", F.col(value).alias("_v"))
        )
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        draws = fixed_blocks(sizes, keys, reps, 1, draw, circular=True).select(
            *keys, "rep", F.col("start").cast("long").alias("pos")
        )
        # as in ``replicate_sums``, the exploded draws must not be broadcast
        means = join_null_safe(draws.hint("merge"), rows, [*keys, "pos"]).groupBy(*keys, "rep").agg(F.avg("_v").alias("_m"))
    q = F.percentile("_m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return means.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high")
    )


#: Neighbouring rows that a task draws from at once.
DRAW_ROWS = 4096


def drawn_sums(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], bucket: Column, reps: int = 500, seed: int = 11, size: int = DRAW_ROWS
) -> DataFrame:
    """(keys, rep, sum, n): total and count of the non-null values among as many independent draws as a series has rows.

    How many draws fall into which ``size`` neighbouring rows is multinomial. It is split downwards: the halves of a span share its draws
    by a binomial number that follows from (seed, series, span), so every task finds the count of its own rows by itself and then draws
    them. Rows move once; a replicate leaves one number for each ``size`` rows.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from tidegrid.operators.chunked import row_position

    keys = list(keys)
    placed = row_position(df, keys, order, bucket, "_pos").select(*keys, "_pos", F.col(value).cast("double").alias("_v"))
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    salt = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    rows = join_null_safe(placed, sizes, keys).withColumns({"_part": F.floor(F.col("_pos") / size), "_salt": salt})

    def run(group: pa.Table) -> pa.Table:
        n, part, own = (group[c][0].as_py() for c in ("_n", "_part", "_salt"))
        order = np.argsort(group["_pos"].to_numpy(), kind="stable")
        values = group["_v"].to_numpy().astype(float)[order]

        def numbers(*place: int) -> np.random.Generator:
            return np.random.default_rng([own & (2**64 - 1), *place])

        counts, lo, hi = np.full(reps, n), 0, -(-n // size)
        while hi - lo > 1:
            middle = (lo + hi) // 2
            rows_left, rows_all = (middle - lo) * size, min(hi * size, n) - lo * size
            left = numbers(0, lo, hi).binomial(counts, rows_left / rows_all)
            counts, lo, hi = (left, lo, middle) if part < middle else (counts - left, middle, hi)
        known = ~np.isnan(values)
        told = np.where(known, values, 0.0)
        draws = numbers(1, part)
        sums, seen = np.empty(reps), np.empty(reps, int)
        for r, m in enumerate(counts.tolist()):
            at = draws.integers(0, len(values), m)
            sums[r], seen[r] = told[at].sum(), known[at].sum()
        out = {k: pa.chunked_array([pa.concat_arrays([group[k].slice(0, 1).combine_chunks()] * reps)]) for k in keys}
        return pa.table(out | {"rep": pa.array(range(reps), pa.int32()), "_s": sums, "_c": pa.array(seen, pa.int64())})

    fields = [f for k in keys for f in df.schema.fields if f.name == k]
    more = [T.StructField("rep", T.IntegerType()), T.StructField("_s", T.DoubleType()), T.StructField("_c", T.LongType())]
    parts = rows.groupBy(*keys, "_part").applyInArrow(run, T.StructType([*fields, *more]))
    return parts.groupBy(*keys, "rep").agg(F.sum("_s").alias("sum"), F.sum("_c").alias("n"))
