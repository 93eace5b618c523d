"""Streams that keep going, bucketed upserts, and series whose key is null."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import bootstrap as bs, chunked as ch, clusters as cl, frames as fr, impute, mcs, series_tests as st
from tidegrid.streaming import jobs

START = datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    return str(tmp_path)


# upserts


ROWS = "k int, v string, batch_order long"


def test_a_batch_rewrites_its_buckets_only(spark, folder):
    table = jobs.BucketedTable(spark, f"{folder}/t", ["k"], buckets=8, keep=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    table.write(rows(*[(i, "a") for i in range(100)], (None, "a")), 0)
    first = table.manifest(0)
    assert len(first) == 8
    table.write(rows((5, "b")), 1)
    second = table.manifest(1)
    changed = [b for b in first if first[b] != second[b]]
    assert len(changed) == 1 and set(first) == set(second)
    assert Counter(r.v for r in table.read(rows((1, "")).schema).collect()) == {"a": 100, "b": 1}
    table.write(rows((5, "again")), 1)  # a repeated batch changes nothing
    assert table.manifest(1) == second
    for version in range(2, 6):
        table.write(rows((5, f"v{version}"), (None, "n"), (200 + version, "new")), version)
    assert table.versions() == [4, 5]
    got = {r.k: r.v for r in table.read(rows((1, "")).schema).collect()}
    assert got == {i: "a" for i in range(100)} | {5: "v5", None: "n"} | {200 + v: "new" for v in range(2, 6)}
    kept = set(table.manifest(4).values()) | set(table.manifest(5).values())
    present = {f"data/{v}/{b}" for v in table._names("data") for b in table._names(f"data/{v}") if b.startswith("_bucket=")}
    assert present == kept
    assert {r.k for r in table.read(rows((1, "")).schema, 4).collect()} >= {204} and 205 not in {r.k for r in table.read(rows((1, "")).schema, 4).collect()}


def test_upsert_stream_in_batches(spark, folder):
    source = f"{folder}/in"
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    stream = lambda: spark.readStream.schema(ROWS).parquet(source)
    run = lambda: jobs.upsert_stream(spark, stream(), f"{folder}/t", f"{folder}/c", ["k"], buckets=4)
    assert run().count() == 0
    want = {}
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 5), (3, "e", 1)], [(1, "f", 0)]):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(source)
        want |= {k: v for k, v, _ in sorted(batch, key=lambda r: r[2])}
        assert {r.k: r.v for r in run().collect()} == want


# dead letters


EVENTS = "event_id int, begin_date timestamp, end_date timestamp, mean_load double, total_load double, operator string, direction string"


def _events(spark, folder, rows):
    out = []
    for i, (begin, hours) in enumerate(rows):
        start = START + timedelta(hours=begin)
        end = None if hours is None else start + timedelta(hours=hours)
        out.append((i, start, end, 10.0, 10.0 * (hours or 0), "A", "up"))
    spark.createDataFrame(out, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_long_events_go_aside_and_the_stream_goes_on(spark, folder):
    sums = {}
    for name, long in (("without", []), ("with", [(3, 500), (4, None), (400, 90)])):
        source = f"{folder}/{name}"
        for part in ([(h, 2) for h in range(0, 60, 2)], long, [(h, 3) for h in range(60, 200, 3)]):
            if part:
                _events(spark, source, part)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        energy, aside = jobs.run_energy(stream, f"{folder}/out-{name}", f"{folder}/c-{name}", longest_hours=24, delay_hours=2)
        sums[name] = Counter((r.ts, round(r.total_load, 6), r.n) for r in energy.collect())
        assert Counter(r.reason for r in aside.collect()) == Counter(["longer than 24 hours"] * 2 + ["no duration"] if long else [])
    assert sums["with"] == sums["without"] and len(sums["with"]) > 100


# null series


def _series(spark, n=30):
    rows = [(k, START + timedelta(hours=h), float((h * 7 + len(k or "")) % 5) if h % 6 else None, float(h)) for k in (None, "a") for h in range(n)]
    return spark.createDataFrame(rows, "k string, ds timestamp, y double, x double")


def test_helpers_keep_null_series(spark):
    df = _series(spark)
    month = F.date_trunc("day", "ds")
    got = defaultdict(list)
    for r in ch.row_position(df, ["k"], ["ds"], month, "pos").orderBy("ds").collect():
        got[r.k].append(r.pos)
    assert got == {None: list(range(30)), "a": list(range(30))}
    sums = ch.running_sum(df, ["k"], "ds", month, {"s": F.col("x")}).orderBy("ds").collect()
    for k in (None, "a"):
        assert [r.s for r in sums if r.k == k] == list(np.cumsum(np.arange(30.0)))
    filled = ch.carry_last(df, ["k"], "ds", month, {"c": F.col("y")})
    assert filled.count() == 60 and filled.where("c IS NULL AND ds > '2024-01-01'").count() == 0
    assert impute.gap_position(df.withColumnRenamed("ds", "ts"), ["k"], "y").count() == 60
    assert st.centred(df, ["k"]).where("k IS NULL AND _c IS NOT NULL").count() == 25
    scaler = fr.standard_scaler(df, ["k"], F.lit(True), "x")
    assert fr.scale(df, scaler, ["k"], "x").count() == 60
    assert fr.circular_shift(df, ["k"], ["x"], 3).where("k IS NULL").count() == 30
    assert {r.k for r in st.acf(df.fillna(0.0), ["k"], 3).collect()} == {None, "a"}


def _forecasts(spark, key):
    r = np.random.default_rng(2)
    rows = []
    for k in (None, "a"):
        for h in range(60):
            y = float(r.integers(0, 9))
            rows += [(k, START + timedelta(hours=h), m, y, y + float(r.normal()) * (i + 1)) for i, m in enumerate(("p", "q", "z"))]
    return spark.createDataFrame(rows, f"{key} string, ds timestamp, model string, y double, y_pred double")


def test_confidence_sets_of_any_key(spark):
    for key in ("s", "k"):
        for variant in ("block", "stationary"):
            out = mcs.model_confidence_set(_forecasts(spark, key), [key], ["p", "q", "z"], reps=30, variant=variant).collect()
            assert Counter(r[key] for r in out) == {None: 3, "a": 3} and {r.p_value for r in out} >= {1.0}


# bootstraps


def test_stationary_blocks_are_geometric_and_cover_the_series(spark):
    sizes = spark.createDataFrame([(None, 500), ("a", 400), ("one", 1)], "k string, n long")
    blocks = bs.stationary_blocks(sizes, ["k"], 300, F.lit(8.0), bs.hashed_draw(3, ["k"])).collect()
    totals = Counter()
    for b in blocks:
        totals[b.k, b.rep] += b.len
        assert 0 <= b.start < b.n and b.len >= 1
    assert totals == Counter({(k, r): n for k, n in ((None, 500), ("a", 400), ("one", 1)) for r in range(300)})
    lengths = np.array([b.len for b in blocks if b.n > 1])
    assert abs(lengths.mean() - 8) < 0.2 and abs((lengths == 1).mean() - 1 / 8) < 0.01 and abs((lengths > 8).mean() - (7 / 8) ** 8) < 0.01
    # about n / 8 rows a replicate, not n
    assert len(blocks) < 300 * (900 / 7 + 2)
    same = bs.stationary_blocks(sizes, ["k"], 5, F.lit(1.0), bs.hashed_draw(3, ["k"])).collect()
    assert {b.len for b in same} == {1} and len(same) == 5 * 901


def test_short_draws_are_drawn_on(spark):
    """With lengths that never exceed one, the usual number of blocks doesn't cover the series."""
    sizes = spark.createDataFrame([("a", 300)], "k string, n long")
    ones = lambda rep, block: F.when(block % 2 == 1, F.lit(0)).otherwise(rep + block).cast("long")
    blocks = bs.stationary_blocks(sizes, ["k"], 2, F.lit(10.0), ones).collect()
    assert len(blocks) == 600 and sum(b.len for b in blocks) == 600


def test_drawn_sums_are_multinomial(spark):
    values = {None: [float(i % 7) for i in range(1000)], "a": [1.0] * 37 + [None] * 13, "one": [5.0]}
    rows = [(k, START + timedelta(hours=i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, ds timestamp, y double").repartition(5)
    out = bs.drawn_sums(df, ["k"], "y", ["ds"], F.date_trunc("month", "ds"), reps=400, size=64).collect()
    by = defaultdict(list)
    for r in out:
        by[r.k].append((r.sum, r.n))
    assert {k: len(v) for k, v in by.items()} == {None: 400, "a": 400, "one": 400}
    assert all(n == 1000 for _, n in by[None]) and by["one"] == [(5.0, 1)] * 400
    means = np.array([s / n for s, n in by[None]])
    sd = np.std(values[None]) / np.sqrt(1000)
    assert abs(means.mean() - np.mean(values[None])) < 4 * sd / 20 and 0.85 < means.std() / sd < 1.15
    seen = np.array([n for _, n in by["a"]])
    assert abs(seen.mean() - 37) < 1 and 0.8 < seen.std() / np.sqrt(50 * 0.74 * 0.26) < 1.2
    again = bs.drawn_sums(df.repartition(3), ["k"], "y", ["ds"], F.date_trunc("month", "ds"), reps=400, size=64).collect()
    assert sorted((str(r.k), r.rep, r.sum, r.n) for r in out) == sorted((str(r.k), r.rep, r.sum, r.n) for r in again)
    interval = {r.k: (r.low, r.high) for r in bs.mean_interval(df, ["k"], "y", ["ds"], F.date_trunc("month", "ds")).collect()}
    assert interval["a"] == (1.0, 1.0) and interval["one"] == (5.0, 5.0) and interval[None][0] < np.mean(values[None]) < interval[None][1]


# feature groups


def test_feature_groups_follow_the_shape_of_profiles(spark):
    shapes = {"up": lambda h: h, "down": lambda h: -h, "wave": lambda h: (-1) ** h * 3}
    rows = []
    for m in (None, "m"):
        for name, f in shapes.items():
            rows += [(m, f"{name}{i}", h, s, (i + 1) * f(h) + 0.01 * i * h * h + s) for i in range(3) for h in range(8) for s in (-1.0, 1.0)]
        rows += [(m, "flat", h, 1.0, 2.0) for h in range(8)]
    df = spark.createDataFrame(rows, "model string, feature string, horizon int, stride double, value double")
    got = {(r.model, r.feature): r.cluster for r in cl.feature_groups(df, ["model"], ["horizon"], 3).collect()}
    for m in (None, "m"):
        groups = defaultdict(set)
        for (model, f), c in got.items():
            if model == m:
                groups[c].add(f.rstrip("012"))
        assert got[m, "flat"] == -1 and {c: len(v) for c, v in groups.items()} == {-1: 1, 0: 1, 1: 1, 2: 1}
    one = cl.feature_groups(df.where("feature LIKE 'up%'").withColumn("value", F.col("horizon") * 1.0), ["model"], ["horizon"], 5)
    assert {r.cluster for r in one.collect()} == {0}


def test_windows_of_a_late_day_step_as_calendars_do(spark):
    import pandas as pd

    lo, hi = pd.Timestamp("2021-01-31 05:00"), pd.Timestamp("2022-06-10 00:00")
    got = fr.rolling_windows(spark.createDataFrame([(lo.to_pydatetime(), hi.to_pydatetime())], "lo timestamp, hi timestamp"), 3, 2, 1)
    want, start = [], lo
    while True:
        valid = start + pd.DateOffset(months=3)
        test = valid + pd.DateOffset(months=2)
        end = test + pd.DateOffset(months=1)
        if end > hi + pd.Timedelta(hours=1) and (hi - test) / (end - test) < 0.5:
            break
        want.append((len(want), start, valid, test, end))
        start = start + pd.DateOffset(months=1)
    rows = [(r.window_index, *(pd.Timestamp(r[c]) for c in ("train_start", "valid_start", "test_start", "test_end"))) for r in got.collect()]
    assert sorted(rows) == want and any(w[1].day == 28 for w in want)
