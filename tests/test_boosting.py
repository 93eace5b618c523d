"""Keyed boosted trees against a plain loop over keys, rounds, nodes and cuts."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidegrid.operators import boosting as bo

X = ["a", "b", "s"]


def _rows(seed=3):
    r = random.Random(seed)
    out = []
    for key, n in (("k1", 160), ("k2", 90), (None, 70), ("flat", 30), ("few", 5)):
        for i in range(n):
            a, b = r.randrange(12), r.choice([None, float(r.randrange(5))])
            y = 5.0 if key == "flat" else 3.0 * (a > 6) + (b or 0) * (a % 3) + r.randrange(7)
            out.append((key, float(a), b, 1.0, None if i % 41 == 7 else y, i % 4 == 1, i))
    return out


SCHEMA = "s0 string, a double, b double, s double, y double, valid boolean, i int"


def _order(values, p):
    """Lower order statistic."""
    values = sorted(v for v in values if v is not None)
    return values[max(math.ceil(p * len(values)), 1) - 1] if values else None


def _node(tree, x, depth):
    at = 1
    for _ in range(depth):
        if at in tree:
            f, cut = tree[at]
            at = 2 * at + (x[f] is not None and x[f] > cut)
    return at


def _fit(rows, rounds, depth, bins, rate, least):
    """Loop form of one key: base, trees with leaves, and the errors of the held rows after each round."""
    train = [(r[1:4], r[4]) for r in rows if not r[5] and r[4] is not None]
    held = [(r[1:4], r[4]) for r in rows if r[5] and r[4] is not None]
    base = _order([y for _, y in train], 0.5)
    cuts = [sorted({_order([x[f] for x, _ in train], i / bins) for i in range(1, bins)} - {None}) for f in range(len(X))]
    f_of = {id(t): base for t in train + held}
    trees, errors = [], []
    for _ in range(rounds):
        tree = {}
        for level in range(depth):
            at = defaultdict(list)
            for t in train:
                at[_node(tree, t[0], level)].append((t[0], (t[1] > f_of[id(t)]) - (t[1] < f_of[id(t)])))
            for node, inside in at.items():
                if node < 1 << level:
                    continue
                n, g = len(inside), sum(s for _, s in inside)
                best = None
                for f in range(len(X)):
                    for cut in cuts[f]:
                        left = [s for x, s in inside if x[f] is None or x[f] <= cut]
                        nl, gl = len(left), sum(left)
                        if nl >= least and n - nl >= max(least, 1):
                            gain = gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, f, cut)
                if best:
                    tree[node] = best[1:]
        rest = defaultdict(list)
        for t in train:
            rest[_node(tree, t[0], depth)].append(t[1] - f_of[id(t)])
        leaves = {node: _order(v, 0.5) * rate for node, v in rest.items()}
        for t in train + held:
            f_of[id(t)] += leaves.get(_node(tree, t[0], depth), 0.0)
        trees.append((tree, leaves))
        errors.append(sum(abs(t[1] - f_of[id(t)]) for t in held) / max(len(held), 1))
    return base, trees, errors


def _chosen(errors, patience):
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif patience and i - best >= patience:
            break
    return best + 1


def _close(a, b):
    return (a is None and b is None) or abs(a - b) < 1e-9


def test_trees_equal_a_plain_loop(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for rounds, depth, patience in ((4, 2, 2), (2, 3, 0)):
        model = bo.fit_boosted(df, ["s0"], X, rounds=rounds, depth=depth, bins=8, rate=0.4, min_rows=4, valid="valid", patience=patience, refresh=2)
        got = {(r.s0, r.i): (r.y_pred, r.y) for r in bo.predict_boosted(df, model, ["s0"], X, depth).collect()}
        used = {r.s0: r.rounds for r in model.select("s0", "rounds").collect()}
        assert len(got) == len(rows)
        for key in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == key]
            base, trees, errors = _fit(own, rounds, depth, 8, 0.4, 4)
            n = _chosen(errors, patience) if any(r[5] and r[4] is not None for r in own) else rounds
            assert used[key] == n, (key, errors)
            for r in own:
                want = base + sum(leaves.get(_node(tree, r[1:4], depth), 0.0) for tree, leaves in trees[:n])
                assert _close(got[key, r[6]][0], want)


def test_unknown_keys_have_no_prediction(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    model = bo.fit_boosted(df.where("s0 = 'k1'"), ["s0"], X, rounds=1, depth=1, bins=4, min_rows=2)
    out = bo.predict_boosted(df, model, ["s0"], X, 1)
    assert out.where("s0 = 'k1' AND y_pred IS NULL").count() == 0
    assert out.where("NOT s0 <=> 'k1' AND y_pred IS NOT NULL").count() == 0


def test_horizons_are_keys(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 9.0)], "k int, y1 double, y2 double, y double")
    got = {(r.k, r.horizon, r.y) for r in bo.horizons(df, {1: "y1", 2: "y2"}).collect()}
    assert got == {(1, 1, 2.0), (1, 2, 3.0)}


def test_rolling_trees_learn_from_train_rows_only(spark):
    days = [(k, d, float(d % 7), float(d % 7) * 2 + k) for k in (0, 1) for d in range(60)]
    df = spark.createDataFrame(days, "k int, d int, x double, y double").withColumn("ds", F.expr("timestamp'2024-01-01' + make_dt_interval(d)"))
    windows = spark.createDataFrame([(i, a, a + 20, a + 25, a + 30) for i, a in enumerate((0, 10, 30))], "window_index int, a int, b int, c int, e int")
    at = {"a": "train_start", "b": "valid_start", "c": "test_start", "e": "test_end"}
    windows = windows.select("window_index", *[F.expr(f"timestamp'2024-01-01' + make_dt_interval({s})").alias(t) for s, t in at.items()])
    out = bo.rolling_boosted(df, windows, ["k"], ["x"], depth=2, rounds=2, bins=8, rate=0.5, min_rows=1)
    rows = out.collect()
    assert sorted({(r.window_index, r.d) for r in rows}) == [(i, a + 25 + d) for i, a in enumerate((0, 10, 30)) for d in range(5)]
    assert sum(abs(r.y_pred - r.y) for r in rows) < 0.5 * sum(abs(6 + r.k - r.y) for r in rows)
