"""Gradient-boosted trees with absolute loss for many series at once.

Every key (window, series, direction, horizon, ...) has its own model, and all of them grow together, level by level. Features are
cut into bins once; a level is one grouped sum of (key, node, feature, bin), combined before the exchange, so no
task sees the rows of a key and a key of any size is spread like the others. A key's trees travel as one row of the model table,
which rows meet by key; the model is cut at every level, the rows' own predictions only once in ``refresh`` rounds.

The gradient of the absolute loss is the sign of the residual. A split takes the greatest gain of squared sums over counts, ties go to the first
feature and the lowest cut; a leaf's value is the median of its residuals, shrunk by ``rate``. Missing features go left. Medians
and bin edges are order statistics (lower median), exact up to ``accuracy`` rows of a group.

Nodes are numbered as a heap: the root is 1, the children of n are 2n (at most the cut) and 2n + 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.chunked import join_null_safe
from tidegrid.session import cut_lineage

ACCURACY = 10_000
TREE = "struct<splits: map<int, struct<feature: int, bin: int>>, leaves: map<int, double>>"


def _median(value: Column, accuracy: int) -> Column:
    return F.percentile_approx(value, 0.5, accuracy)


def _node(splits: Column, depth: int, right: Callable[[Column], Column]) -> Column:
    """Node a row falls into after ``depth`` steps; it stays where there is no split."""

    def step(node: Column, _: Column) -> Column:
        split = F.try_element_at(splits, node)
        return F.when(split.isNull(), node).otherwise(node * 2 + F.coalesce(right(split), F.lit(False)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def _by_bin(split: Column) -> Column:
    return F.get(F.col("_bins"), split["feature"]) > split["bin"]


def _values(trees: Column, depth: int) -> Column:
    """What each tree adds to a row's prediction."""
    return F.transform(trees, lambda t: F.coalesce(F.try_element_at(t["leaves"], _node(t["splits"], depth, _by_bin)), F.lit(0.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def bin_edges(rows: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, bins: int, accuracy: int) -> DataFrame:
    """(keys, base, edges): the median target and the distinct inner quantiles of every feature."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = [F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(F.col(c).cast("double"), at, accuracy), F.array().cast("array<double>")))) for c in x]
    return rows.groupBy(*keys).agg(_median(F.col(y).cast("double"), accuracy).alias("base"), F.array(*edges).alias("edges"))


def _bin(value: Column, edges: Column) -> Column:
    """Number of edges below a value."""
    return F.size(F.filter(edges, lambda e: value > e))


def _best_splits(placed: DataFrame, keys: Sequence[str], level: int, min_rows: int) -> DataFrame:
    """(keys, node, feature, bin) of the nodes of one level that have a split worth making."""
    histogram = (
        placed.where(F.col("_node") >= 1 << level)
        .select(*keys, "_node", "_sign", F.posexplode("_bins").alias("_feature", "_bin"))
        .groupBy(*keys, "_node", "_feature", "_bin")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_sign").alias("_g"))
    )
    cell = [*keys, "_node", "_feature"]
    # at most as many rows as bins
    up_to = Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*cell)
    sums = histogram.select(
        *cell, "_bin", *[F.sum(c).over(w).cast("double").alias(c + s) for c in ("_n", "_g") for w, s in ((up_to, "l"), (whole, "t"))]
    )
    nl, nr = F.col("_nl"), F.col("_nt") - F.col("_nl")
    gl, gr = F.col("_gl"), F.col("_gt") - F.col("_gl")
    gain = gl * gl / nl + gr * gr / nr - F.col("_gt") * F.col("_gt") / F.col("_nt")
    worth = sums.where((nl >= min_rows) & (nr >= F.lit(max(min_rows, 1)))).withColumn("_gain", gain).where("_gain > 1e-9")
    order = F.struct("_gain", (-F.col("_feature")).alias("f"), (-F.col("_bin")).alias("b"))
    best = F.max_by(F.struct(F.col("_feature").alias("feature"), F.col("_bin").alias("bin")), order)
    return worth.groupBy(*keys, "_node").agg(best.alias("_split"))


def _entries(rows: DataFrame, keys: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """One map for each key; a tree has few nodes."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def fit_boosted(
    rows: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y", rounds: int = 100, depth: int = 5, bins: int = 32, rate: float = 0.1,
    min_rows: int = 20, valid: str | None = None, patience: int = 0, refresh: int = 5, accuracy: int = ACCURACY,
) -> DataFrame:
    """(keys, base, trees, rounds, depth): one model for each key.

    Rows whose boolean column ``valid`` is true are not learnt from: they choose how many rounds a key uses, the best by mean absolute
    error before ``patience`` rounds without a better one (0: of all rounds). Rows without a target are left out.
    """
    keys = list(keys)
    rows = rows.where(F.col(y).isNotNull())
    held = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    learnt = rows.where(~held)
    edges = cut_lineage(bin_edges(learnt, keys, x, y, bins, accuracy))
    numbered = join_null_safe(rows.withColumn("_held", held), edges, keys).select(
        *keys, "_held", F.col(y).cast("double").alias("_y"), F.col("base").alias("_f"),
        F.array(*[_bin(F.col(c).cast("double"), F.get("edges", F.lit(i))) for i, c in enumerate(x)]).alias("_bins"),
    )
    state = numbered = cut_lineage(numbered)
    model = edges.select(*keys, F.array().cast(f"array<{TREE}>").alias("trees"))
    folded = 0  # trees that the state's predictions hold
    for done in range(rounds):
        late = F.slice("trees", folded + 1, max(done - folded, 1)) if done > folded else F.array().cast(f"array<{TREE}>")
        fitted = join_null_safe(state, model, keys).withColumn("_f", F.col("_f") + _sum(_values(late, depth)))
        if done - folded >= refresh:
            state, folded = cut_lineage(fitted.drop("trees")), done
            fitted = state
        train = fitted.where(~F.col("_held")).withColumn("_sign", F.signum(F.col("_y") - F.col("_f")).cast("int"))
        found: DataFrame | None = None
        for level in range(depth):
            placed = train.withColumn("_node", F.lit(1))
            if found is not None:
                splits = _entries(found, keys, "_node", "_split", "_splits")
                placed = join_null_safe(train, splits, keys, "left").withColumn("_node", _node(F.col("_splits"), level, _by_bin))
            new = cut_lineage(_best_splits(placed, keys, level, min_rows))
            found = new if found is None else found.unionByName(new)
        splits = _entries(found, keys, "_node", "_split", "splits")
        placed = join_null_safe(train, splits, keys, "left").withColumn("_node", _node(F.col("splits"), depth, _by_bin))
        medians = placed.groupBy(*keys, "_node").agg((_median(F.col("_y") - F.col("_f"), accuracy) * rate).alias("_leaf"))
        grown = join_null_safe(_entries(medians, keys, "_node", "_leaf", "leaves"), splits, keys, "left")
        one = grown.select(*keys, F.struct("splits", "leaves").cast(TREE).alias("_tree"))
        model = cut_lineage(join_null_safe(model, one, keys, "left").select(*keys, F.concat("trees", F.array("_tree")).alias("trees")))
    best = model.select(*keys, F.lit(rounds).alias("rounds"))
    if valid:
        best = _best_rounds(join_null_safe(numbered.where("_held"), model, keys), model, keys, depth, patience)
    named = join_null_safe(join_null_safe(model, edges, keys), best, keys)
    cuts = lambda t: F.transform_values(
        t["splits"], lambda _, s: F.struct(s["feature"].alias("feature"), F.get(F.get(F.col("edges"), s["feature"]), s["bin"]).alias("cut"))
    )
    trees = F.transform(F.slice("trees", F.lit(1), F.col("rounds")), lambda t: F.struct(cuts(t).alias("splits"), t["leaves"].alias("leaves")))
    return named.select(*keys, "base", trees.alias("trees"), "rounds", F.lit(depth).alias("depth"))


def _best_rounds(held: DataFrame, model: DataFrame, keys: Sequence[str], depth: int, patience: int) -> DataFrame:
    """(keys, rounds) with the least mean absolute error on held rows; all rounds for a key without such rows."""
    steps = F.sequence(F.lit(1), F.size("_v"))
    gap = F.transform(steps, lambda k: F.abs(F.col("_y") - F.col("_f") - _sum(F.slice(F.col("_v"), F.lit(1), k))))
    errors = (
        held.withColumn("_v", _values(F.col("trees"), depth)).select(*keys, F.posexplode(gap).alias("_at", "_e"))
        .groupBy(*keys, "_at").agg(F.avg("_e").alias("_e"))
    )
    # one row a round
    so_far = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    best = errors.withColumn("_best", F.min_by("_at", F.struct("_e", "_at")).over(so_far))
    if patience:
        stale = F.max((F.col("_at") - F.col("_best") >= patience).cast("int")).over(so_far)
        best = best.withColumn("_stale", stale).where((F.col("_stale") == 0) | (F.col("_at") == F.col("_best")))
    chosen = best.groupBy(*keys).agg((F.min_by("_at", F.struct("_e", "_at")) + 1).alias("rounds"))
    every = model.select(*keys, F.size("trees").alias("_all"))
    return join_null_safe(every, chosen, keys, "left").select(*keys, F.coalesce("rounds", "_all").alias("rounds"))


def predict_boosted(rows: DataFrame, model: DataFrame, keys: Sequence[str], x: Sequence[str], depth: int) -> DataFrame:
    """``rows`` with y_pred, null where the key has no model."""
    values = F.array(*[F.col(c).cast("double") for c in x])
    right = lambda s: F.get(F.col("_x"), s["feature"]) > s["cut"]
    leaf = F.transform("trees", lambda t: F.coalesce(F.try_element_at(t["leaves"], _node(t["splits"], depth, right)), F.lit(0.0)))
    joined = join_null_safe(rows.withColumn("_x", values), model.select(*keys, "base", "trees"), list(keys), "left")
    return joined.withColumn("y_pred", F.col("base") + _sum(leaf)).drop("_x", "base", "trees")


def horizons(rows: DataFrame, targets: dict[int, str], y: str = "y") -> DataFrame:
    """One row for each row and horizon: the target columns of ``targets`` become ``horizon`` and ``y``."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias(y)) for h, c in targets.items()])
    kept = [c for c in rows.columns if c != y and c not in targets.values()]
    return rows.select(*kept, F.explode(pairs).alias("_h")).select(*kept, "_h.horizon", f"_h.{y}")


def rolling_boosted(
    rows: DataFrame, windows: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y", ts: str = "ds", depth: int = 5, **settings
) -> DataFrame:
    """Trees learnt anew in every window from its train rows, stopped by its valid rows: test rows with y_pred, by (window, key)."""
    from tidegrid.operators.frames import window_roles

    by = ["window_index", *keys]
    dealt = window_roles(rows, windows, ts=ts).withColumn("_valid", F.col("role") == "valid")
    model = fit_boosted(dealt.where("role <> 'test'"), by, x, y, depth=depth, valid="_valid", **settings)
    return predict_boosted(dealt.where("role = 'test'"), model, by, x, depth).drop("_valid", "role")
