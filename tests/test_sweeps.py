"""The sweep against one fit for each window, series, input size and setting."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import boosting as bo, sweeps as sw

START = datetime(2024, 1, 1)
SCHEMA = "key string, size_class int, ds timestamp, y double"


def _hours(n):
    return START + timedelta(hours=n)


def _series(seed=1, n=4600):
    r = random.Random(seed)
    out = {}
    for key in ("a", None):
        level = 0.0
        for h in range(n):
            level = 0.8 * level + r.gauss(0, 1) + (h % 24) * 0.1
            if r.random() > 0.01:
                out[key, h] = None if r.random() < 0.005 else round(level, 3)
    return out


BOUNDS = [(0, 0, 4200, 4224, 4248), (1, 4000, 4300, 4330, 4361), (2, 4300, 4306, 4310, 4320)]


def _windows(spark):
    rows = [(i, *map(_hours, b)) for i, *b in BOUNDS]
    return spark.createDataFrame(rows, "window_index int, train_start timestamp, valid_start timestamp, test_start timestamp, test_end timestamp")


def _want(series, d, alpha):
    out = {}
    for key in ("a", None):
        y = lambda h: series.get((key, h))  # noqa: B023, E731
        for w, train, valid, test, end in BOUNDS:
            for size in d.sizes:
                xs, ts = [], []
                for o in range(train + size, valid - d.reach):
                    x = [y(o - k) for k in range(1, size + 1)]
                    t = [y(o + d.shift + h) for h in range(d.horizon)]
                    if (key, o) in series and None not in x and None not in t:
                        xs.append(x)
                        ts.append(t)
                if not xs:
                    continue
                x, t = np.array(xs), np.array(ts)
                xc, tc = x - x.mean(0), t - t.mean(0)
                slope = np.linalg.solve(xc.T @ xc + alpha * np.eye(size), xc.T @ tc)
                for o in range(test - d.shift, end - d.shift, d.horizon):
                    if (key, o) not in series:
                        continue
                    lags = [y(o - k) for k in range(1, size + 1)]
                    for h in range(d.horizon):
                        if o + d.shift + h < end:
                            told = None if None in lags else float(t.mean(0)[h] + (np.array(lags) - x.mean(0)) @ slope[:, h])
                            out[w, key, size, h + 1, o + d.shift + h] = told
    return out


@pytest.mark.parametrize("shift", [0, 5])
def test_input_sizes_share_one_matrix(spark, shift):
    series = _series()
    df = spark.createDataFrame([(k, 1, _hours(h), v) for (k, h), v in series.items()], SCHEMA).repartition(5)
    d = sw.Design((2, 5, 24), horizon=3, shift=shift)
    rows = sw.linear_sweep(df, _windows(spark), ["key"], d, [("ridge_alpha_2p0", 2.0, 0.0)]).collect()
    got = {(r.window_index, r.key, r.input_size, r.horizon, int((r.ds - START).total_seconds() // 3600)): r.y_pred for r in rows}
    want = _want(series, d, 2.0)
    assert len(got) == len(rows) and set(got) == set(want)
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or abs(v - got[k]) < 1e-6), k
    # the last window serves the smallest size only, and none with a shift
    assert {k[2] for k in got if k[0] == 2} == (set() if shift else {2})


def test_pieces_of_time_are_shared():
    d = sw.Design((2, 24), horizon=1)
    bounds, inside = sw._pieces([sw.Span(0, 0, 100, 110, 120), sw.Span(1, 50, 150, 160, 170)], d)
    assert bounds == [24, 74, 100, 150]
    assert inside == [(1, 0), (2, 0), (2, 1), (3, 1)]


def test_tree_arm_is_the_keyed_trees(spark):
    series = {("a", h): float((h * 7) % 11) for h in range(400)}
    df = spark.createDataFrame([(k, 1, _hours(h), v) for (k, h), v in series.items()], SCHEMA)
    spans = [(0, 0, 300, 330, 360)]
    windows = spark.createDataFrame([(i, *map(_hours, b)) for i, *b in spans], "window_index int, train_start timestamp, valid_start timestamp, test_start timestamp, test_end timestamp")
    d = sw.Design((2, 3), horizon=2)
    rows = sw.tree_sweep(df, windows, ["key"], d, [5], rounds=1, depth=2, bins=8, rate=0.5).collect()
    got = {(r.input_size, r.horizon, int((r.ds - START).total_seconds() // 3600)): r.y_pred for r in rows}
    assert set(got) == {(s, h, o + h - 1) for s in (2, 3) for h in (1, 2) for o in range(330, 360, 2)}
    train = [(h, o, *[series["a", o - k] for k in (1, 2, 3)], series["a", o + h - 1], o >= 300) for h in (1, 2) for o in range(3, 400 - 1) if o + 1 < 300 or 300 <= o < 329]
    flat = spark.createDataFrame(train, "horizon int, o int, l1 double, l2 double, l3 double, y double, held boolean")
    tests = spark.createDataFrame([(h, o, *[series["a", o - k] for k in (1, 2, 3)]) for h in (1, 2) for o in range(330, 360, 2)], "horizon int, o int, l1 double, l2 double, l3 double")
    x = ["l1", "l2", "l3"]
    model = bo.fit_boosted(flat, ["horizon"], x, rounds=1, depth=2, bins=8, rate=0.5, min_rows=5, valid="held")
    for r in bo.predict_boosted(tests, model, ["horizon"], x, 2).collect():
        assert abs(got[3, r.horizon, r.o + r.horizon - 1] - r.y_pred) < 1e-12


def test_intermittent_arm_starts_with_the_window(spark):
    df = spark.createDataFrame([("a", 1, _hours(h), float(h % 5 == 0) * h) for h in range(24 * 6)], SCHEMA)
    spans = [(0, 24, 72, 96, 120)]
    windows = spark.createDataFrame([(i, *map(_hours, b)) for i, *b in spans], "window_index int, train_start timestamp, valid_start timestamp, test_start timestamp, test_end timestamp")
    rows = sw.intermittent_sweep(df, windows, ["key"], [(0.3, 0.2)]).collect()
    p = z = None
    for h in range(24, 96):
        v = float(h % 5 == 0) * h
        p = float(v > 0) if p is None else 0.8 * p + 0.2 * (v > 0)
        z = z if v == 0 else v if z is None else 0.7 * z + 0.3 * v
    assert len(rows) == 24 and all(abs(r.y_pred - p * z) < 1e-9 and r.model == "croston_tsb_ad0p3_ap0p2" for r in rows)
    assert sorted(r.horizon for r in rows) == list(range(1, 25))
    assert sw.linear_sweep(df.where(F.lit(False)), windows, ["key"], sw.Design((1,), 1), [("r", 1.0, 0.0)]).count() == 0
