"""Queries of Model Confidence Sets draw as many replicates as the results to match."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import bootstrap as bs, mcs
from tidegrid.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    d = str(tmp_path_factory.mktemp("events"))
    rows = [(i, i * 1800, int(rng.integers(0, 20)), "a", float(rng.integers(1, 50)), "{}") for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    df.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{d}/events.parquet")
    return d


def _replicates(monkeypatch):
    seen = []
    whole = mcs.model_confidence_set
    monkeypatch.setattr(mcs, "model_confidence_set", lambda *a, **kw: seen.append(kw["reps"]) or whole(*a, **kw))
    return seen


def test_a_confidence_set_takes_all_replicates(spark, events, monkeypatch):
    seen = _replicates(monkeypatch)
    rows = QUERIES["sta13_sta14_sta15_model_confidence_set"](spark, events).collect()
    assert seen == [5000] and len(rows) == 2 * 2 * 4
    assert all(r.p_value * 5000 == pytest.approx(round(r.p_value * 5000)) for r in rows)


def test_marks_of_a_confidence_set_take_all_replicates(spark, events, monkeypatch):
    seen = _replicates(monkeypatch)
    rows = QUERIES["sta16_mcs_marks"](spark, events).collect()
    assert seen == [5000] and len(rows) == 2 * 2
    assert {r[m] for r in rows for m in ("blend", "damped", "naive", "seasonal")} <= {"x", ""}


def test_ranges_of_replicates_and_draws_without_numbers(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [
        (k, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", m, float(h % 7), h % 7 + float(rng.normal()) * (i + 1))
        for k in ("a", None) for h in range(100) for i, m in enumerate("pqr")
    ]
    df = spark.createDataFrame(rows, "k string, ds string, model string, y double, y_pred double").withColumn("ds", F.col("ds").cast("timestamp"))
    plain = bs.integer_draw(17)
    sets = []
    for starts, draw in ((250_000, plain), (35, plain), (35, lambda rep, block: plain(rep, block))):
        monkeypatch.setattr(mcs, "STARTS", starts)
        out = mcs.model_confidence_set(df, ["k"], list("pqr"), reps=50, draw=draw)
        sets.append(sorted((str(r.k), r.round, r.model, round(r.p_value, 9), r.included) for r in out.collect()))
    assert len(sets[0]) == 6 and sets[0] == sets[1] == sets[2]
