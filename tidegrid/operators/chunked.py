"""Ordered operators cut into chunks of a series.

A window partitioned by the series alone runs a whole series in one task. The
helpers below partition by (series, chunk of the order axis): bounded frames
get the neighbouring rows they need by a halo copy, unbounded frames get a
carry value from a summary table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 4096

CHUNK = "_chunk"
HOME = "_home"
POS = "_pos"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come once."""
    names = {k: f"_r_{k}" for k in keys}
    cond = F.lit(True)
    for k, r in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())


def _one_key(keys: Sequence[str]) -> Column:
    """All keys as one value: null equals null in joins on it, and windows, sums and joins share one partitioning."""
    return F.struct(*keys) if keys else F.lit(0)


def hour_index(ts: str | Column) -> Column:
    """Hours since 1970; the row position of a complete hourly grid."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c) / 3600).cast("long")


def day_index(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(c.cast("date")).cast("long")


def chunk_of(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(
    df: DataFrame, pos: Column, before: int = 0, after: int = 0, size: int = CHUNK_ROWS
) -> DataFrame:
    """Copy each row into every chunk whose frames can reach it.

    ``pos`` counts rows without holes inside a series. A row lands in its own
    chunk, in later chunks up to ``before`` rows ahead, in earlier chunks up to
    ``after`` rows back. With a chunk no shorter than the reach that is at most
    two extra copies of the rows near a chunk edge.
    """
    size = max(size, before + after + 1)
    return (
        df.withColumn(POS, pos)
        .withColumn(
            CHUNK,
            F.explode(
                F.sequence(
                    chunk_of(F.col(POS) - after, size), chunk_of(F.col(POS) + before, size)
                )
            ),
        )
        .withColumn(HOME, F.col(CHUNK) == chunk_of(F.col(POS), size))
    )


def home_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(HOME, CHUNK, POS)


def chunk_window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(POS)


def row_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = POS
) -> DataFrame:
    """Exact 0-based row number inside a series, by two levels.

    ``bucket`` must rise with the order (a month or a day of the time column).
    """
    keys, order = list(keys), list(order)
    rows = df.withColumns({"_rp_k": _one_key(keys), "_rp_b": bucket})
    sizes = rows.groupBy("_rp_k", "_rp_b").agg(F.count(F.lit(1)).alias("_rp_n"))
    before = Window.partitionBy("_rp_k").orderBy("_rp_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_rp_k", "_rp_b", F.coalesce(F.sum("_rp_n").over(before), F.lit(0)).alias("_rp_off")
    )
    inside = Window.partitionBy("_rp_k", "_rp_b").orderBy(*order)
    return (
        rows.withColumn("_rp_rn", F.row_number().over(inside) - 1)
        .join(offsets, ["_rp_k", "_rp_b"])
        .withColumn(name, (F.col("_rp_rn") + F.col("_rp_off")).cast("long"))
        .drop("_rp_k", "_rp_b", "_rp_rn", "_rp_off")
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    cols: dict[str, Column],
    following: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Last non-null value up to this row (or next one, ``following``), by two levels.

    ``cols`` maps the new column to the value that is carried. ``source`` is a
    cheaper table with the same keys, order and values for the chunk summary;
    without it the summary reads ``df`` a second time.
    """
    keys = list(keys)

    def valued(table: DataFrame) -> DataFrame:
        return table.withColumns({"_carry_k": _one_key(keys), "_b": bucket, **{f"_v_{n}": v for n, v in cols.items()}})

    rows = valued(df)
    edge = F.min_by if following else F.max_by
    ends = (rows if source is None else valued(source)).groupBy("_carry_k", "_b").agg(
        *[
            edge(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}")
            for n in cols
        ]
    )
    outer_order = F.col("_b").desc() if following else F.col("_b").asc()
    outside = (
        Window.partitionBy("_carry_k").orderBy(outer_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = ends.select(
        "_carry_k", "_b", *[F.last(f"_e_{n}", True).over(outside).alias(f"_c_{n}") for n in cols]
    )
    inner_order = F.col(order).desc() if following else F.col(order).asc()
    inside = (
        Window.partitionBy("_carry_k", "_b")
        .orderBy(inner_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.select(
        "*", *[F.last(f"_v_{n}", True).over(inside).alias(f"_i_{n}") for n in cols]
    ).join(carries, ["_carry_k", "_b"])
    for n in cols:
        out = out.withColumn(n, F.coalesce(f"_i_{n}", f"_c_{n}"))
    return out.drop("_carry_k", "_b", *[f"_{p}_{n}" for n in cols for p in "vic"])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, cols: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums inside a series, by two levels."""
    keys = list(keys)
    rows = df.withColumns({"_carry_k": _one_key(keys), "_b": bucket})
    for name, value in cols.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy("_carry_k", "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols])
    outside = Window.partitionBy("_carry_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_carry_k",
        "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(outside), F.lit(0)).alias(f"_o_{n}") for n in cols],
    )
    inside = (
        Window.partitionBy("_carry_k", "_b")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.select(
        "*", *[F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in cols]
    ).join(offsets, ["_carry_k", "_b"])
    for n in cols:
        out = out.withColumn(n, F.coalesce(F.col(f"_i_{n}"), F.lit(0)) + F.col(f"_o_{n}"))
    return out.drop("_carry_k", "_b", *[f"_{p}_{n}" for n in cols for p in "vio"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], splits: int = 256
) -> DataFrame:
    """Linear-interpolated exact quantiles of groups of any size.

    Approximate split points cut each group into buckets; bucket counts tell
    which buckets hold the wanted ranks; only those buckets are ordered. No
    task sees more than about 1/``splits`` of a group, ties aside, and ties are
    counted before the shuffle. One row per (keys, prob).
    """
    keys = list(keys)
    vals = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_x")
    )
    counted = vals.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_m"))
    grid = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    cuts = vals.groupBy(*keys).agg(
        F.percentile_approx("_x", grid, splits * 20).alias("_cuts"),
        F.count(F.lit(1)).alias("_n"),
    )
    if keys:
        located = join_null_safe(counted, cuts.drop("_n"), keys)
    else:
        located = counted.crossJoin(F.broadcast(cuts.drop("_n")))
    located = located.withColumn(
        "_bk", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    ).drop("_cuts")
    sizes = located.groupBy(*keys, "_bk").agg(F.sum("_m").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_lo", F.coalesce(F.sum("_bn").over(w), F.lit(0)))
    ranks = cuts.select(
        *keys,
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
        "_n",
    ).withColumn("_h", F.col("prob") * (F.col("_n") - 1))
    ranks = ranks.select(
        *keys, "prob", "_h", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_r")
    ).distinct()
    cond = (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_lo") + F.col("_bn"))
    if keys:
        wanted = join_null_safe(ranks, sizes, keys).where(cond)
    else:
        wanted = ranks.crossJoin(sizes).where(cond)
    # tiny: (groups x probs x 2) rows
    inner = Window.partitionBy(*keys, "_bk").orderBy("_x")
    needed = join_null_safe(located, wanted.select(*keys, "_bk").distinct(), [*keys, "_bk"], "left_semi")
    ordered = needed.withColumn(
        "_hi", F.sum("_m").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    hit = join_null_safe(wanted, ordered, [*keys, "_bk"]).where(
        (F.col("_r") - F.col("_lo") < F.col("_hi"))
        & (F.col("_r") - F.col("_lo") >= F.col("_hi") - F.col("_m"))
    )
    frac = F.max("_h") - F.floor(F.max("_h"))
    return hit.groupBy(*keys, "prob").agg(
        (F.min("_x") + (F.max("_x") - F.min("_x")) * frac).alias("quantile")
    )
