"""Small cases worked out by hand or by brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import lookups, stats, timeutil
from tidegrid.operators import (
    bootstrap as bs,
    chunked,
    densify,
    dm,
    features as ft,
    frames as fr,
    impute as imp,
    intervals as iv,
    joins,
    mcs,
    metrics as me,
    models as mo,
    series_tests as st,
)
from tidegrid.plans import target
from tidegrid.sources import files, market_xml as mx, predictions as pred

DAY = dt.datetime(2024, 1, 1)


def hours(spark, values, key="s", start=DAY):
    rows = [(key, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp, value double")


def events(spark, rows):
    cols = "event_id long, begin_date timestamp, end_date timestamp, total_load double, mean_load double, max_load double"
    return spark.createDataFrame(rows, cols)


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def values(df, *order, col):
    return [r[col] for r in df.orderBy(*order).collect()]


# intervals


def test_equal_split(spark):
    df = events(spark, [(1, at(10), at(11), 100.0, 1.0, 1.0), (2, at(10, 30), at(13), 250.0, 1.0, 1.0)])
    out = iv.split_hourly(df, "equal")
    assert values(out.where("event_id = 1"), "hour_begin", col="hour_load") == [100.0]
    assert values(out.where("event_id = 2"), "hour_begin", col="hour_load") == pytest.approx([50, 100, 100])


def test_front_back_split(spark):
    df = events(spark, [(1, at(10), at(14), 200.0, 100.0, 1.0)])
    out = iv.split_hourly(df, "split").orderBy("hour_begin").collect()
    assert [(r.hour_begin.hour, r.hour_load) for r in out] == [(10, 100.0), (13, 100.0)]


@pytest.mark.parametrize("method", ["equal", "split"])
def test_split_conserves_energy(spark, method):
    df = events(spark, [(1, at(10), at(12), 100.0, 50.0, 1.0), (2, at(14), at(16, 30), 150.0, 60.0, 1.0)])
    assert iv.split_hourly(df, method).agg(F.sum("hour_load")).first()[0] == pytest.approx(250)


def test_split_drops_degenerate_rows(spark):
    df = events(
        spark,
        [(1, at(10), at(10), 5.0, 1.0, 1.0), (2, at(10), at(11), 0.0, 1.0, 1.0), (3, None, at(11), 5.0, 1.0, 1.0)],
    )
    assert iv.split_hourly(df, "equal").count() == 0


def test_isolated_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        b = DAY + dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 20)))
        rows.append((i, b, b + dt.timedelta(minutes=int(rng.integers(1, 120))), 1.0, 1.0, 1.0))
    rows.append((900, rows[0][1], rows[0][2], 1.0, 1.0, 1.0))
    want = {
        a[0] for a in rows if sum(1 for b in rows if b[1] <= a[2] and b[2] >= a[1]) == 1
    }
    got = {r.event_id for r in iv.isolated_intervals(events(spark, rows)).collect()}
    assert got == want


def test_monthly_curve_and_unknown_curve(spark):
    cols = "k int, period_start timestamp, step_minutes int, step_months int, n_steps int, curve_type string, points array<struct<position:int,quantity:double>>"
    df = spark.createDataFrame([(1, DAY, 60, 1, 3, "A03", [(2, 5.0)])], cols)
    out = iv.expand_curve(df, ["k"]).orderBy("begin_date").collect()
    assert [(r.begin_date.month, r.value) for r in out] == [(1, 0.0), (2, 5.0), (3, 5.0)]
    bad = spark.createDataFrame([(1, DAY, 60, None, 3, "A04", [(2, 5.0)])], cols)
    with pytest.raises(Exception, match="curve type"):
        iv.expand_curve(bad, ["k"]).collect()


def test_grid_adds_missing_hours(spark):
    df = hours(spark, [1.0, None, 3.0]).where("value IS NOT NULL")
    b = densify.fixed_bounds(df, ["k"], F.lit(at(0)), F.lit(at(3)))
    out = densify.complete_grid(df, ["k"], b, {"value": 0.0})
    assert values(out, "ts", col="value") == [1.0, 0.0, 3.0, 0.0]
    off = densify.fixed_bounds(df, ["k"], F.lit(at(0, 15)), F.lit(at(3)))
    with pytest.raises(Exception, match="on the hour"):
        densify.complete_grid(df, ["k"], off).collect()


def test_run_features(spark):
    y = [0, 100, 100, 0, 0, 0, 50, 50, 50, 0]
    df = hours(spark, [float(v) for v in y]).withColumnRenamed("value", "total_load").withColumn("union_exposure", F.lit(0.0))
    out = target.run_features(df, ["k"], state="y")
    assert values(out, "ts", col="runlength_indicator") == [0, 1, 1, 0, 0, 0, 1, 1, 1, 0]
    assert values(out, "ts", col="runlength_zero") == [1, 2, 0, 0, 1, 2, 3, 0, 0, 0]
    assert values(out, "ts", col="runlength_switches") == [0, 0, 1, 1, 2, 2, 2, 3, 3, 3]


def test_gap_filter_keeps_negative_infinite_and_null(spark):
    rows = [
        (1, at(0), at(1), 10.0, 0.0), (2, at(0), at(1), -10.0, 0.0), (3, at(0), at(1), 10.0, None),
        (4, at(0), at(1), 10.0, 1.0), (5, at(0), at(1), 10.0, 10.0),
    ]
    df = spark.createDataFrame(
        rows, "event_id long, begin_date timestamp, end_date timestamp, total_load double, mean_load double"
    ).withColumns({"reason": F.lit("r"), "operator": F.lit("Amprion"), "primary_energy_type": F.lit("x")})
    got = {r.event_id for r in target.relevant_interventions(df, ["r"]).collect()}
    assert got == {2, 3, 5}
    two = df.withColumn("operator", F.lit("Amprion & 50Hertz"))
    with pytest.raises(Exception, match="more than one"):
        target.relevant_interventions(two, ["r"]).collect()


# imputation


@pytest.mark.parametrize(
    "series,want",
    [
        ([1.0, None, None, 2.0, None], [0, 1, 2, 0, 1]),
        ([None, None, None], [1, 2, 3]),
        ([1.0, None, 2.0, None, None, None, 3.0], [0, 1, 0, 1, 2, 3, 0]),
    ],
)
def test_gap_position(spark, series, want):
    assert values(imp.gap_position(hours(spark, series), ["k"]), "ts", col="gap_position") == want


def test_short_and_long_gaps(spark):
    vals = [float(i % 24 * 10) for i in range(24 * 8)]
    for i in (10, 11):
        vals[i] = None
    for i in range(50, 74):
        vals[i] = None
    df = hours(spark, vals).withColumn("metric", F.lit("x"))
    out = values(imp.impute(df, [imp.Rule("", gap=10)], keys=["k"]), "ts", col="imputed")
    assert out[10] == out[11] == 90.0
    assert out[50:74] == [float(i % 24 * 10) for i in range(50, 74)]


def test_forward_fill_leaves_leading_gap(spark):
    out = values(imp.forward_fill(hours(spark, [None, None, 1.0, None]), ["k"]), "ts", col="imputed")
    assert out == [None, None, 1.0, 1.0]


def test_fill_does_not_look_ahead_of_the_fit(spark):
    vals = [float(i) for i in range(24 * 10)]
    vals[100] = None
    fit = F.col("ts") < F.lit(DAY + dt.timedelta(days=5))
    rule = [imp.Rule("", gap=0)]
    a = hours(spark, vals).withColumn("metric", F.lit("x"))
    b = a.withColumn("value", F.when(fit, F.col("value")).otherwise(F.col("value") * 100))
    pick = lambda d: values(imp.impute(d, rule, fit, ["k"]).where(F.col("value").isNull()), "ts", col="imputed")
    assert pick(a) == pick(b)


# features


def test_lag_and_backfill(spark):
    df = hours(spark, [float(i) for i in range(60)])
    plain = values(ft.lags(df, ["k"], (24,), backfill=False), "ts", col="lag_24h")
    assert plain[:24] == [None] * 24 and plain[24] == 0.0 and plain[48] == 24.0
    filled = values(ft.lags(df, ["k"], (24,)), "ts", col="lag_24h")
    assert filled[:24] == [0.0] * 24 and filled[48] == 24.0


def test_backfill_passes_leading_nulls(spark):
    df = hours(spark, [None] * 10 + [float(i) for i in range(30)])
    filled = values(ft.lags(df, ["k"], (1,)), "ts", col="lag_1h")
    assert filled[:11] == [0.0] * 11 and filled[12] == 1.0


def test_no_look_ahead_without_backfill(spark):
    a = [float(i) for i in range(24 * 12)]
    b = a[: 24 * 8] + [v * 9 for v in a[24 * 8:]]
    f = lambda v: values(ft.lag_and_rolling(hours(spark, v), ["k"], backfill=False), "ts", col="rollingmean_7d")
    assert f(a)[: 24 * 8 + 1] == f(b)[: 24 * 8 + 1]


# chunked helpers across chunk edges


def test_chunked_helpers_match_plain_python(spark):
    rng = np.random.default_rng(5)
    n = 3000
    vals = [None if rng.random() < 0.3 else float(rng.integers(0, 9)) for _ in range(n)]
    df = hours(spark, vals)
    bucket = F.date_trunc("day", "ts")
    seen, want = None, []
    for v in vals:
        seen = v if v is not None else seen
        want.append(seen)
    assert values(chunked.carry_last(df, ["k"], "ts", bucket, {"c": F.col("value")}), "ts", col="c") == want
    pos = values(chunked.row_position(df, ["k"], ["ts"], bucket, "p"), "ts", col="p")
    assert pos == list(range(n))
    sums = values(chunked.running_sum(df, ["k"], "ts", bucket, {"t": F.coalesce("value", F.lit(0.0))}), "ts", col="t")
    assert sums == pytest.approx(np.cumsum([v or 0 for v in vals]).tolist())
    rows = chunked.with_halo(df, chunked.hour_index("ts"), before=5, size=64)
    lagged = chunked.home_rows(rows.withColumn("l", F.lag("value", 5).over(chunked.chunk_window(["k"]))))
    assert values(lagged, "ts", col="l") == [None] * 5 + vals[:-5]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    data = [("a", float(x)) for x in rng.normal(size=5000)] + [("b", float(x)) for x in rng.integers(0, 3, 800)] + [("c", 1.5)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {(r.k, r.prob): r["quantile"] for r in chunked.exact_quantiles(df, ["k"], "v", probs).collect()}
    for k in "abc":
        want = np.quantile([v for kk, v in data if kk == k], probs)
        assert [got[(k, p)] for p in probs] == pytest.approx(want.tolist())


# time


def test_clock_change(spark):
    rows = [("25.10.2020", "2:00"), ("25.10.2020", "2B:00"), ("25.10.2020", "2A:00"), ("01.07.2021", "3:05 PM"), ("01.07.2021", "")]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [r[0] for r in df.select(timeutil.parse_wall_time(F.col("d"), F.col("t"))).collect()]
    assert got == [
        dt.datetime(2020, 10, 25, 0), dt.datetime(2020, 10, 25, 1), dt.datetime(2020, 10, 25, 0),
        dt.datetime(2021, 7, 1, 13, 5), None,
    ]
    kept = df.where("t LIKE '%PM'").select(timeutil.parse_wall_time(F.col("d"), F.col("t"), ignore_pm=True)).first()[0]
    assert kept == dt.datetime(2021, 7, 1, 1, 5)


def test_easter(spark):
    known = {2020: (4, 12), 2021: (4, 4), 2022: (4, 17), 2023: (4, 9), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2027: (3, 28), 2038: (4, 25), 1981: (4, 19)}
    df = spark.createDataFrame([(y,) for y in known], "y int")
    got = {r.y: (r.e.month, r.e.day) for r in df.select("y", timeutil.easter_sunday(F.col("y")).alias("e")).collect()}
    assert got == known


def test_lookups(spark):
    df = spark.createDataFrame([("50HzT",), ("Transnet BW",), ("Elsewhere",), (None,)], "n string")
    got = [tuple(r) for r in df.select(lookups.canonical_operator(F.col("n")), lookups.split_method(F.col("n"))).collect()]
    assert got == [("50Hertz", "equal"), ("TransnetBW", "equal"), ("Elsewhere", "equal"), (None, "equal")]


# statistics


def test_normal_and_chi_square_tails(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.5, 6.9, 7.2, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(stats.two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-9)
    q = df.select(stats.chi2_tail(F.col("z"), 2)).collect()
    assert [r[0] for r in q] == pytest.approx([math.exp(-z / 2) for z in zs])


def panel(spark, n=200, models=4, seed=1):
    rng = np.random.default_rng(seed)
    y = np.maximum(rng.normal(2, 4, n), 0)
    f = np.stack([np.maximum(y + rng.normal(0.2 * m, 1 + m, n), 0) for m in range(models)])
    rows = [
        ("s", DAY + dt.timedelta(hours=i), i % 24 + 1, float(y[i]), f"m{m}", float(f[m, i]))
        for i in range(n)
        for m in range(models)
    ]
    return y, f, spark.createDataFrame(rows, "k string, ds timestamp, horizon int, y double, model string, y_pred double")


def test_dm_by_hand(spark):
    y, f, df = panel(spark)
    d = (y - f[0]) ** 2 - (y - f[1]) ** 2
    var = d.var(ddof=1) + sum(2 * (1 - k / 24) * np.cov(d[:-k], d[k:])[0, 1] for k in range(1, 24))
    want = d.mean() / math.sqrt(var / len(d))
    out = dm.pairwise(df, ["k"], ["m0", "m1"]).where("model < rival").first()
    assert out.dm_statistic == pytest.approx(want)
    assert out.p_value == pytest.approx(math.erfc(abs(want) / math.sqrt(2)))


def starts(rep, block, room, seed=17):
    return (rep * 7919 + block * 104729 + seed) % room


def test_fbeta_bootstrap_by_resampling(spark):
    y, f, df = panel(spark, n=100)
    names = [f"m{i}" for i in range(4)]
    out = bs.fbeta_replicates(df, ["k"], names, 24, 6, 2.0, bs.integer_draw(17)).orderBy("rep").collect()
    for rep, row in enumerate(out):
        idx = np.concatenate([np.arange(starts(rep, b, 77), starts(rep, b, 77) + 24) for b in range(5)])[:100]
        for m in range(4):
            on, hit = y[idx] > 0, f[m][idx] > 0
            tp, fp, fn = (on & hit).sum(), (~on & hit).sum(), (on & ~hit).sum()
            assert row.f[m] == pytest.approx(5 * tp / (5 * tp + 4 * fn + fp))


def brute_mcs(loss, reps, block, method):
    n, m = loss.shape
    mean = loss.mean(axis=0)
    boot = []
    for rep in range(reps):
        idx = np.array([(starts(rep, t // block, n) + t % block) % n for t in range(n)])
        boot.append(loss[idx].mean(axis=0))
    boot = np.array(boot)
    pair = mean[None, :] - mean[:, None]
    pboot = boot[:, None, :] - boot[:, :, None]
    sd = np.sqrt(((pboot - pair) ** 2).mean(axis=0) + np.eye(m))
    alive, out, top = list(range(m)), [], 0.0
    while len(alive) > 1:
        ix = np.ix_(alive, alive)
        z, zb = (pair / sd)[ix], ((pboot - pair) / sd)[:, alive][:, :, alive]
        if method == "R":
            p = (np.abs(zb).max(axis=(1, 2)) > z.max()).mean()
        else:
            p = ((zb**2).sum(axis=(1, 2)) / 2 > (z**2).sum() / 2).mean()
        k = len(alive)
        di = pair[ix].mean(axis=0) * k / (k - 1)
        db = pboot[:, alive][:, :, alive].mean(axis=1) * k / (k - 1)
        t = di / np.sqrt(((db - di) ** 2).mean(axis=0))
        top = max(top, p)
        out.append((alive.pop(int(np.argmax(t))), top))
    return out + [(alive[0], 1.0)]


@pytest.mark.parametrize("method", ["R", "SQ"])
def test_model_confidence_set_by_brute_force(spark, method):
    y, f, df = panel(spark, n=150, models=5)
    names = [f"m{i}" for i in range(5)]
    got = mcs.model_confidence_set(df, ["k"], names, reps=60, method=method, draw=bs.integer_draw(17)).orderBy("round").collect()
    want = brute_mcs(np.abs(f - y).T, 60, int(math.sqrt(150)), method)
    assert [r.model for r in got] == [f"m{i}" for i, _ in want]
    assert [r.p_value for r in got] == pytest.approx([p for _, p in want])


def test_stationary_blocks_cover_each_replicate(spark):
    sizes = spark.createDataFrame([("s", 500)], "k string, n long")
    b = bs.stationary_blocks(sizes, ["k"], 40, F.lit(10.0), bs.hashed_draw(1, ["k"]))
    per = b.groupBy("rep").agg(F.sum("len").alias("t"), F.count(F.lit(1)).alias("c")).collect()
    assert len(per) == 40 and all(r.t == 500 for r in per)
    assert 35 < np.mean([r.c for r in per]) < 65
    assert b.agg(F.max("start"), F.min("start")).first()[0] < 500


def test_pacf_of_an_ar_process(spark):
    rng = np.random.default_rng(2)
    x = [0.0, 0.0]
    for _ in range(3000):
        x.append(0.5 * x[-1] + 0.3 * x[-2] + rng.normal())
    df = hours(spark, [float(v) for v in x[2:]]).withColumnsRenamed({"value": "y", "ts": "ds"})
    out = {r.lag: r for r in st.acf_pacf(df, ["k"], 5).collect()}
    c = np.array(x[2:]) - np.mean(x[2:])
    r = [float((c[k:] * c[: len(c) - k]).sum() / (c * c).sum()) for k in range(6)]
    assert [out[k].acf for k in range(6)] == pytest.approx(r)
    for k in range(1, 6):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert out[k].pacf == pytest.approx(np.linalg.solve(m, r[1 : k + 1])[-1])


def test_adf_by_least_squares(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=400)) * 0.9
    df = hours(spark, y.tolist()).withColumnsRenamed({"value": "y", "ts": "ds"})
    got = st.adf(df, ["k"], 3).first().adf
    d = np.diff(y)
    rows = range(3, len(d))
    x = np.array([[1, y[t], d[t - 1], d[t - 2], d[t - 3]] for t in rows])
    t = d[3:]
    beta, *_ = np.linalg.lstsq(x, t, rcond=None)
    res = t - x @ beta
    cov = np.linalg.inv(x.T @ x) * (res @ res) / (len(t) - 5)
    assert got == pytest.approx(beta[1] / math.sqrt(cov[1, 1]))


def test_r2_of_constant_series(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0)], "k string, y double, y_pred double")
    got = {r.k: r.r2_score for r in me.point_metrics(df, ["k"]).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_series_class(spark):
    df = spark.createDataFrame(
        [("d", v) for v in (1.0, 0.0, 2.0, 1.0)] + [("s", v) for v in (0.0, 0.0, 0.0, 1.0)], "k string, y double"
    )
    got = {r.k: (r.sparsity, r.sparsity_class) for r in me.series_class(df, ["k"]).collect()}
    assert got == {"d": (0.25, "Dense"), "s": (0.75, "Sparse")}


def test_hurdle_gate(spark):
    df = spark.createDataFrame([(0.0, 5.0), (-1.0, 5.0), (3.0, -2.0), (-800.0, 1.0)], "l double, m double")
    got = [r[0] for r in df.select(me.hurdle_gate(F.col("l"), F.col("m"), F.lit(0.5))).collect()]
    assert got == [5.0, 0.0, 0.0, 0.0]


# models


def test_elastic_net_conditions(spark):
    """Optimality conditions of the penalised problem, and ridge in closed form."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = x @ np.array([2.0, 0.0, -1.0, 0.05]) + rng.normal(size=300)
    rows = [("s", *map(float, r), float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double, t double")
    names = ["a", "b", "c", "d"]
    coef = {
        r.model: np.array(r.coef[0])
        for r in mo.fit_linear(df, ["k"], names, ["t"], [("ridge", 7.0, 0.0), ("enet", 0.2, 0.6), ("ols", 0.0, 0.0)]).collect()
    }
    xc, yc = x - x.mean(0), y - y.mean()
    assert coef["ridge"][1:] == pytest.approx(np.linalg.solve(xc.T @ xc + 7 * np.eye(4), xc.T @ yc))
    assert coef["ols"][1:] == pytest.approx(np.linalg.lstsq(xc, yc, rcond=None)[0])
    w = coef["enet"][1:]
    grad = xc.T @ (yc - xc @ w) / 300 - 0.2 * 0.4 * w
    for g, c in zip(grad, w):
        assert abs(g) <= 0.12 + 1e-6 if c == 0 else g == pytest.approx(0.12 * np.sign(c), abs=1e-6)


def test_intermittent_demand_by_recursion(spark):
    rng = np.random.default_rng(9)
    y = [float(v) if rng.random() < 0.3 else 0.0 for v in rng.integers(1, 50, 24 * 70)]
    df = hours(spark, y).withColumnsRenamed({"value": "y", "ts": "ds"})
    got = values(mo.intermittent_demand(df, ["k"], alpha_d=0.2, alpha_p=0.1), "origin", col="forecast")
    want, p, d = [], None, None
    for i, v in enumerate(y):
        on = 1.0 if v > 0 else 0.0
        p = on if p is None else 0.9 * p + 0.1 * on
        if v > 0:
            d = v if d is None else 0.8 * d + 0.2 * v
        if i % 24 == 23:
            want.append(p * (d or 0.0))
    assert got == pytest.approx(want)


# frames


def test_circular_shift_takes_the_value_ahead(spark):
    df = hours(spark, [float(i) for i in range(10)]).withColumnRenamed("ts", "ds")
    assert values(fr.circular_shift(df, ["k"], ["value"], 3), "ds", col="value") == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2]
    assert values(fr.circular_shift(df, ["k"], ["value"], 3, 4), "ds", col="value") == [3, 0, 1, 2, 3, 0, 1, 2, 3, 0]


def test_window_tail_rule(spark):
    b = spark.createDataFrame([(DAY, dt.datetime(2024, 6, 16, 23))], "lo timestamp, hi timestamp")
    out = fr.rolling_windows(b, 2, 1, 1).orderBy("window_index").collect()
    assert [r.test_start.month for r in out] == [4, 5, 6]


# joins and checks


def test_duplicate_and_conflict_fail(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="duplicate key"):
        joins.add_features(df.select("k"), df, ["k"]).collect()
    with pytest.raises(Exception, match="conflicting"):
        joins.fail_on_conflict(df, ["k"], "v").collect()


def test_incomplete_imputation_fails(spark):
    df = hours(spark, [1.0, None]).withColumnsRenamed({"k": "metric", "value": "imputed"})
    with pytest.raises(Exception, match="missing values"):
        imp.require_complete(df).collect()


# sources


XML = """<D xmlns="urn:x"><mRID>d1</mRID><TimeSeries><mRID>1</mRID><businessType>A01</businessType>
<in_Domain.mRID codingScheme="A01">10Y</in_Domain.mRID><curveType>{curve}</curveType><Period><timeInterval>
<start>2024-01-01T00:00Z</start><end>2024-01-01T01:00Z</end></timeInterval><resolution>PT15M</resolution>
<Point><position>2</position><price.amount>7.5</price.amount></Point></Period></TimeSeries></D>"""


def test_market_document(spark):
    docs = spark.createDataFrame([(XML.format(curve="A03"),)], "xml string")
    out = mx.market_intervals(mx.document_series(docs), "price.amount").orderBy("begin_date").collect()
    assert [r.value for r in out] == [0.0, 7.5, 7.5, 7.5]
    assert out[0].domain == "10Y" and (out[1].begin_date - out[0].begin_date).seconds == 900
    listed = spark.createDataFrame([(XML.format(curve="A01"),)], "xml string")
    assert [r.value for r in mx.market_intervals(mx.document_series(listed), "price.amount").collect()] == [7.5]
    bad = spark.createDataFrame([(XML.format(curve="A04"),)], "xml string")
    with pytest.raises(Exception, match="curve type"):
        mx.market_intervals(mx.document_series(bad), "price.amount").collect()


def test_series_reader_matches_document_reader(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(curve="A03"))
    docs = mx.read_documents(spark, str(tmp_path))
    a = mx.market_intervals(mx.document_series(docs), "price.amount")
    b = mx.market_intervals(mx.read_series(spark, str(tmp_path)), "price.amount")
    cols = ["begin_date", "value", "domain", "resolution"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    assert b.count() == 4


def _write(spark, root, rel, rows, cols):
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{root}/{rel}")


PRED = "unique_id string, ds timestamp, horizon int, y double, m double"


def test_prediction_file_names(spark, tmp_path):
    rel = "50hertz/ds/window_2/evaluation/predictions_best_checkpoint/predictions_best_checkpoint_nhits_seed778_window2.parquet"
    _write(spark, tmp_path, rel, [("up", DAY, 1, 2.0, 3.0)], PRED)
    row = pred.read_predictions(spark, str(tmp_path), "ds", best=True, model_filter="seed").first()
    assert (row.tso, row.model, row.window_index, row.y_pred) == ("50hertz", "nhits_seed778", 2, 3.0)
    assert pred.resolve_dataset(pred.list_files(spark, str(tmp_path)), "other") == "ds"


def test_best_never_reads_last(spark, tmp_path):
    rel = "50hertz/ds/window_0/evaluation/predictions/predictions_nhits_seed1_window0.parquet"
    _write(spark, tmp_path, rel, [("up", DAY, 1, 2.0, 3.0)], PRED)
    with pytest.raises(FileNotFoundError):
        pred.read_predictions(spark, str(tmp_path), "ds", best=True)
    assert pred.read_predictions(spark, str(tmp_path), "ds", best=False).count() == 1


def test_flat_layout_only_without_window_layout(spark, tmp_path):
    flat = "amprion/ds/evaluation/predictions_tft_seed1_Amprion_20240101_window3.parquet"
    _write(spark, tmp_path, flat, [("up", DAY, 1, 2.0, 9.0)], PRED)
    assert pred.read_predictions(spark, str(tmp_path), "ds", best=False).first().window_index == 3
    deep = "amprion/ds/window_1/evaluation/predictions/predictions_tft_seed1_window1.parquet"
    _write(spark, tmp_path, deep, [("up", DAY, 1, 2.0, 5.0)], PRED)
    got = pred.read_predictions(spark, str(tmp_path), "ds", best=False).collect()
    assert [(r.window_index, r.y_pred) for r in got] == [(1, 5.0)]


def test_exactly_one_benchmark_file(spark, tmp_path):
    d = tmp_path / "amprion" / "ds" / "evaluation"
    d.mkdir(parents=True)
    text = "unique_id,ds,y,naive\nup,2024-01-01 00:00:00,1,2\nup,2024-01-01 01:00:00,1,2\n"
    (d / "benchmarks_a.csv").write_text(text)
    got = pred.read_benchmarks(spark, str(tmp_path), "ds", ["naive"], strict=True)
    assert sorted(r.horizon for r in got.collect()) == [1, 2]
    (d / "benchmarks_b.csv").write_text(text)
    with pytest.raises(FileNotFoundError):
        pred.read_benchmarks(spark, str(tmp_path), "ds", ["naive"], strict=True)


def test_resolve_folder(spark):
    files = spark.createDataFrame([("/r/out_seed7/x",), ("/r/out_b_seed8/x",), ("/r/out_seed8/x",)], "path string")
    wanted = ["out_b_seed{seed}", "out_seed{seed}"]
    assert [pred.resolve_folder(files, wanted, seed=n) for n in (7, 8, 9)] == ["out_seed7", "out_b_seed8", None]


def test_predictions_with_a_column_per_model(spark, tmp_path):
    ds = "timestampadd(HOUR, CAST(id AS INT), TIMESTAMP '2024-01-01')"
    for m, tso in (("nhits_seed778", "50Hertz"), ("tft_quantile_seed7", "50Hertz")):
        rows = spark.range(24).selectExpr("'up' AS unique_id", f"{ds} AS ds", "CAST(id AS INT) AS horizon", "1.0D AS y", f"id + 0.5D AS {m}")
        rows.coalesce(1).write.parquet(str(tmp_path / tso / "d1" / "evaluation" / f"predictions_{m}_{tso}_x_window0.parquet"))
    out = pred.read_predictions(spark, str(tmp_path), "d1", best=False)
    got = {r.model: (r.n, r.k) for r in out.groupBy("model").agg(F.count("*").alias("n"), F.count("y_pred").alias("k")).collect()}
    assert got == {"nhits_seed778": (24, 24), "tft_quantile_seed7": (24, 24)}


def test_empty_table_is_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert files.write_csv(empty, str(tmp_path / "x")) is False
    assert not (tmp_path / "x").exists()


def test_csv_columns_by_name(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "x", 1.0, 2.0)], "begin_date string, end_date string, wind double, load double").write.option(
        "header", True
    ).csv(str(tmp_path / "h"))
    from tidegrid.sources import files

    r = files.read_hourly_csv(spark, str(tmp_path / "h"), ["load", "wind"], long=False).first()
    assert (r["load"], r["wind"]) == (2.0, 1.0)


def test_null_groups_keep_their_quantile(spark):
    from tidegrid.operators.chunked import exact_quantiles

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, x double")
    assert {tuple(r) for r in exact_quantiles(df, ["k"], "x", [0.5]).collect()} == {("a", 0.5, 2.0), (None, 0.5, 2.0)}


def test_incomplete_forecasts_leave_the_comparison(spark):
    from tidegrid.operators.bootstrap import wide_rows

    rows = [("s", 1, 1.0, "a", 1.0), ("s", 1, 1.0, "b", 2.0), ("s", 2, 1.0, "a", 1.0)]
    schema = "k string, ds long, y double, model string, y_pred double"
    assert [r.ds for r in wide_rows(spark.createDataFrame(rows, schema), ["k"], ["a", "b"]).collect()] == [1]
    with pytest.raises(Exception, match="two forecasts"):
        wide_rows(spark.createDataFrame([*rows, rows[0]], schema), ["k"], ["a", "b"]).collect()
