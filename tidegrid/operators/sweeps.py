"""Sweep of models x input sizes x parameters x rolling windows in one long result.

Linear models of all input sizes share one matrix of cross products: the lags of a smaller input size are the first columns of the largest design, so
its matrix is a sub-block. Rows that have some lags only (at a window's start, beside missing hours) are summed
in classes by the largest input size they serve, and an input size adds up its own class and those above.

Windows overlap, mostly by all but a month. Time is cut at all their bounds, the pieces' matrices are summed once, and a window
adds up its pieces; only the rows next to its start, whose lags would reach before it, are summed for it alone.
A task sees one series and ``CHUNK_ROWS`` hours at a time; the lags are made there, so only the plain series moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators import boosting, models
from tidegrid.operators.chunked import CHUNK, HOME, POS, hour_index, join_null_safe, with_halo
from tidegrid.operators.frames import lag_design, window_roles

NAMES = ("train_start", "valid_start", "test_start", "test_end")


@dataclass(frozen=True)
class Design:
    """Lags 1 .. max(sizes) before an origin, targets from ``shift`` hours after it on."""

    sizes: tuple[int, ...]
    horizon: int = 24
    shift: int = 0

    @property
    def longest(self) -> int:
        return self.sizes[-1]

    @property
    def reach(self) -> int:
        """Hours from an origin to its last target."""
        return self.shift + self.horizon - 1


@dataclass(frozen=True)
class Span:
    """A window in hours since 1970; training origins end early enough for their last target."""

    index: int
    train: int
    valid: int
    test: int
    end: int


def _spans(windows: DataFrame) -> list[Span]:
    """The windows, a parameter table with one row a month of data; joins broadcast it, as few tasks would hold all rows of few windows."""
    rows = windows.select("window_index", *[hour_index(n).alias(n) for n in NAMES]).orderBy("window_index").collect()
    return [Span(r.window_index, *[r[n] for n in NAMES]) for r in rows]


def _pieces(spans: Sequence[Span], d: Design) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds that cut time, and (piece, window) for every piece of a window's training span."""
    whole = {s.index: (s.train + d.longest, s.valid - d.reach) for s in spans}
    bounds = sorted({b for lo, hi in whole.values() if lo < hi for b in (lo, hi)})
    inside = [(i, w) for w, (lo, hi) in whole.items() for i, b in enumerate(bounds, 1) if lo <= b < hi]
    return bounds, inside


def _chunks(df: DataFrame, keys: Sequence[str], d: Design, y: str, ts: str, after: int):
    """Rows of each series and chunk with the hours that its origins reach."""
    rows = df.select(*keys, F.col(y).cast("double").alias("_y"), F.col(ts).alias("_ts"))
    return with_halo(rows, hour_index("_ts"), before=d.longest, after=after).drop("_ts").groupBy(*keys, CHUNK)


def _dense(group: pa.Table, before: int, after: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the chunk's own rows, the series around them (missing: NaN) and the position of its first value."""
    pos, value = group[POS].to_numpy(), group["_y"].to_numpy().astype(float)
    own = np.sort(pos[group[HOME].to_numpy()])
    if not len(own):
        return own, np.zeros(0), 0
    lo = int(own[0]) - before
    series = np.full(int(own[-1]) + after + 1 - lo, np.nan)
    near = (pos >= lo) & (pos < lo + len(series))
    series[pos[near] - lo] = value[near]
    return own, series, lo


def _key_columns(group: pa.Table, keys: Sequence[str], n: int) -> dict[str, pa.Array]:
    return {k: pa.chunked_array([pa.concat_arrays([group[k].slice(0, 1).combine_chunks()] * n)]) if n else group[k].slice(0, 0) for k in keys}


def _fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [f for k in keys for f in df.schema.fields if f.name == k]


def nested_grams(
    df: DataFrame, spans: Sequence[Span], keys: Sequence[str], d: Design, y: str = "y", ts: str = "ds"
) -> DataFrame:
    """(keys, piece, window_index, size_class, gram): upper triangles of the cross products of [1, lags, targets].

    ``piece`` numbers the cuts of time; rows next to a window's start have a null piece and their window instead.
    """
    bounds, _ = _pieces(spans, d)
    keys, sizes, longest, width = list(keys), np.array(d.sizes), d.longest, 1 + d.longest + d.horizon
    upper = np.triu_indices(width)

    def run(group: pa.Table) -> pa.Table:
        own, series, lo = _dense(group, longest, d.reach)
        found: dict[tuple[int | None, int | None, int], np.ndarray] = {}
        if len(own):
            views = np.lib.stride_tricks.sliding_window_view
            at = own - lo
            lags = views(series, longest)[at - longest][:, ::-1]
            targets = views(series, d.horizon)[at + d.shift]
            leading = np.cumprod(~np.isnan(lags), axis=1).sum(axis=1)
            told = ~np.isnan(targets).any(axis=1)

            def add(piece: int | None, window: int | None, rows: np.ndarray, room: np.ndarray | int) -> None:
                served = np.searchsorted(sizes, np.minimum(leading[rows], room), side="right") - 1
                for c in np.unique(served[served >= 0]).tolist():
                    part = rows[served == c]
                    x = np.where(np.arange(longest) < sizes[c], lags[part], 0.0)
                    m = np.column_stack([np.ones(len(part)), x, targets[part]])
                    found[piece, window, c] = (m.T @ m)[upper]

            piece = np.searchsorted(bounds, own, side="right")
            for p in np.unique(piece).tolist():
                if 0 < p < len(bounds):
                    add(p, None, np.flatnonzero((piece == p) & told), longest)
            for s in spans:
                edge = np.flatnonzero((own >= s.train) & (own < min(s.train + longest, s.valid - d.reach)) & told)
                if len(edge):
                    add(None, s.index, edge, own[edge] - s.train)
        out = _key_columns(group, keys, len(found))
        for i, name in enumerate(("piece", "window_index", "size_class")):
            out[name] = pa.array([k[i] for k in found], pa.int32())
        out["gram"] = pa.array([g.tolist() for g in found.values()], pa.list_(pa.float64()))
        return pa.table(out)

    more = [T.StructField(n, T.IntegerType()) for n in ("piece", "window_index", "size_class")]
    schema = T.StructType([*_fields(df, keys), *more, T.StructField("gram", T.ArrayType(T.DoubleType()))])
    return _chunks(df, keys, d, y, ts, d.reach).applyInArrow(run, schema)


def fit_nested(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], d: Design, settings: Sequence[tuple[str, float, float]], y: str = "y", ts: str = "ds"
) -> DataFrame:
    """(window_index, keys, model, input_size, coef): every setting of every input size on every window, from one pass over the rows.

    A window whose rows serve no origin of an input size has no model of that size.
    """
    spans, keys = _spans(windows), list(keys)
    grams = nested_grams(df, spans, keys, d, y, ts)
    spark = df.sparkSession
    inside = spark.createDataFrame(_pieces(spans, d)[1], "_piece int, _window int")
    shared = grams.join(inside, F.col("piece") == F.col("_piece")).withColumn("window_index", F.col("_window")).drop("_piece", "_window")
    every = shared.unionByName(grams.where("piece IS NULL"))
    width = 1 + d.longest + d.horizon
    upper = np.triu_indices(width)

    def run(group: pa.Table) -> pa.Table:
        # as many matrices as a window has chunks, pieces and classes
        totals = np.zeros((len(d.sizes), width, width))
        for c, flat in zip(group["size_class"].to_pylist(), group["gram"].to_pylist()):
            totals[c][upper] += flat
        rows = []
        for c, size in enumerate(d.sizes):
            g = totals[c:].sum(axis=0)
            g = g + np.triu(g, 1).T
            own = [*range(1 + size), *range(1 + d.longest, width)]
            if g[0, 0] > 0:
                block = g[np.ix_(own, own)]
                rows += [(name, size, models.solve_gram(block, size, d.horizon, alpha, ratio)) for name, alpha, ratio in settings]
        out = _key_columns(group, ["window_index", *keys], len(rows))
        out["model"] = pa.array([r[0] for r in rows], pa.string())
        out["input_size"] = pa.array([r[1] for r in rows], pa.int32())
        out["coef"] = pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.float64())))
        return pa.table(out)

    index = T.StructField("window_index", T.IntegerType())
    coef = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([index, *_fields(df, keys), T.StructField("model", T.StringType()), T.StructField("input_size", T.IntegerType()), T.StructField("coef", coef)])
    return every.groupBy("window_index", *keys).applyInArrow(run, schema)


def test_origins(df: DataFrame, windows: DataFrame, keys: Sequence[str], d: Design, y: str = "y", ts: str = "ds") -> DataFrame:
    """(window_index, keys, origin, lags): origins whose targets tile the test span, with the lags before them, nearest first.

    An origin is an hour of the series; missing hours are null.
    """
    spans, keys = _spans(windows), list(keys)

    def run(group: pa.Table) -> pa.Table:
        own, series, lo = _dense(group, d.longest, 0)
        rows = []
        for s in spans if len(own) else []:
            first = s.test - d.shift
            for o in own[(own >= first) & (own < s.end - d.shift) & ((own - first) % d.horizon == 0)].tolist():
                lags = series[o - lo - d.longest : o - lo][::-1]
                rows.append((s.index, o, [None if np.isnan(v) else float(v) for v in lags]))
        out = {"window_index": pa.array([r[0] for r in rows], pa.int32()), **_key_columns(group, keys, len(rows))}
        out["origin"] = pa.array([r[1] for r in rows], pa.int64())
        out["lags"] = pa.array([r[2] for r in rows], pa.list_(pa.float64()))
        return pa.table(out)

    fields = [T.StructField("window_index", T.IntegerType()), *_fields(df, keys), T.StructField("origin", T.LongType())]
    return _chunks(df, keys, d, y, ts, 0).applyInArrow(run, T.StructType([*fields, T.StructField("lags", T.ArrayType(T.DoubleType()))]))


def linear_sweep(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], d: Design, settings: Sequence[tuple[str, float, float]], y: str = "y", ts: str = "ds"
) -> DataFrame:
    """(window_index, keys, ds, model, input_size, horizon, y_pred) of every setting and input size on the test spans."""
    coef = fit_nested(df, windows, keys, d, settings, y, ts)
    by = ["window_index", *keys]
    rows = join_null_safe(test_origins(df, windows, keys, d, y, ts), coef, by)
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), F.slice("lags", F.lit(1), F.col("input_size"))), "_c", lambda x, c: x * c)
    ends = windows.select("window_index", F.col("test_end").alias("_end"))
    out = rows.select(*by, "origin", "lags", "model", "input_size", F.posexplode("coef").alias("_k", "_c")).select(
        *by, F.timestamp_seconds((F.col("origin") + d.shift + F.col("_k")) * 3600).alias(ts), "model", "input_size",
        (F.col("_k") + 1).alias("horizon"), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v).alias("y_pred"),
    )
    return join_null_safe(out, F.broadcast(ends), ["window_index"]).where(F.col(ts) < F.col("_end")).drop("_end")


def _number(v: float) -> str:
    return str(float(v)).replace(".", "p")


def intermittent_sweep(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], alphas: Sequence[tuple[float, float]], horizon: int = 24, y: str = "y", ts: str = "ds"
) -> DataFrame:
    """Intermittent-demand arm: (alpha of the size, alpha of the probability) pairs; each test day from the window's hours before it. No input size."""
    by = ["window_index", *keys]
    rows = window_roles(df, windows, ts=ts).select(*by, ts, y)
    spans = windows.select("window_index", "test_start", "test_end")
    out = []
    for a_d, a_p in alphas:  # a short list of parameters
        one = models.over_horizon(models.intermittent_demand(rows, by, horizon, a_d, a_p, y, ts), horizon)
        name = f"croston_tsb_ad{_number(a_d)}_ap{_number(a_p)}"
        out.append(one.withColumnsRenamed({"forecast": "y_pred", "ds": ts}).withColumn("model", F.lit(name)))
    long = out[0]
    for more in out[1:]:
        long = long.unionByName(more)
    long = join_null_safe(long, F.broadcast(spans), ["window_index"]).where((F.col(ts) >= F.col("test_start")) & (F.col(ts) < F.col("test_end")))
    return long.select(*by, ts, "model", F.lit(None).cast("int").alias("input_size"), "horizon", "y_pred")


def tree_sweep(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], d: Design, leaves: Sequence[int], y: str = "y", ts: str = "ds", depth: int = 5, **settings
) -> DataFrame:
    """Boosted-tree arm: least rows of a leaf x input sizes, horizons as keys; origins tile the test spans as those of the linear models."""
    targets = {h: f"_t{h}" for h in range(1, d.horizon + 1)}
    lags = [f"{y}_lag-{k}" for k in range(1, d.longest + 1)]
    led = models.direct_targets(lag_design(df, keys, range(1, d.longest + 1), y=y, ts=ts), keys, d.horizon, d.shift, y, ts)
    led = led.withColumnsRenamed({f"{y}+{h}": c for h, c in targets.items()})
    rows = boosting.horizons(led.select(*keys, ts, y, *lags, *targets.values()), targets, y)
    dealt = window_roles(rows, windows, ts=ts, shift_hours=d.shift)
    spans = windows.select("window_index", *[hour_index(n).alias(f"_{n}") for n in NAMES])
    at, last = hour_index(ts), hour_index(ts) + d.reach
    # targets of training origins lie before the validation span, those of validation origins before the test span
    dealt = join_null_safe(dealt, F.broadcast(spans), ["window_index"]).where(
        F.when(F.col("role") == "test", (at + d.shift - F.col("_test_start")) % d.horizon == 0)
        .when(F.col("role") == "valid", last < F.col("_test_start"))
        .otherwise(last < F.col("_valid_start"))
    )
    by, out = ["window_index", *keys, "horizon"], None
    for size in d.sizes:  # short lists of parameters
        sized = dealt.where((F.col("role") == "test") | (at - F.col("_train_start") >= size)).dropna(subset=lags[:size])
        learnt = sized.where("role <> 'test'").withColumn("_valid", F.col("role") == "valid")
        for least in leaves:
            model = boosting.fit_boosted(learnt, by, lags[:size], y, valid="_valid", min_rows=least, depth=depth, **settings)
            told = boosting.predict_boosted(sized.where("role = 'test'"), model, by, lags[:size], depth)
            one = told.select(
                "window_index", *keys, F.expr(f"{ts} + make_dt_interval(0, horizon - 1 + {d.shift})").alias(ts),
                F.lit(f"lightgbm_leaf{least}").alias("model"), F.lit(size).alias("input_size"), "horizon", "y_pred", "_test_end",
            )
            one = one.where(hour_index(ts) < F.col("_test_end")).drop("_test_end")
            out = one if out is None else out.unionByName(one)
    return out
