"""Steps whose small input grows inside the step: neither one task nor the driver may hold what it becomes."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from tidegrid.operators import bootstrap as bs
from tidegrid.operators.densify import common_bounds, hour_grid
from tidegrid.operators.frames import window_roles


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _prefix(spark, n=50):
    rows = spark.range(3 * n).select((F.col("id") % 3).alias("k"), F.expr("id div 3 + 1").alias("pos"))
    return rows.withColumn("v", F.col("pos").cast("double"))


def test_ends_of_blocks_are_not_broadcast(spark):
    prefix = _prefix(spark)
    blocks = bs.fixed_blocks(bs.series_sizes(prefix, ["k"]), ["k"], 4, 1, bs.integer_draw(3), circular=True)
    sums = bs.replicate_sums(prefix, blocks, ["k"], ["v"])
    assert "SortMergeJoin" in _plan(sums) and "BroadcastHashJoin" not in _plan(sums)
    # one row a block: the total of the prefix sums' differences, 1 for every drawn row
    assert {(r.k, r.rep): r.v for r in sums.collect()} == {(k, rep): 50.0 for k in range(3) for rep in range(4)}


def test_drawn_positions_are_not_broadcast(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("k"), "id", F.lit(5.0).alias("v"))
    out = bs.mean_interval(rows, ["k"], "v", ["id"], F.expr("id div 10"), 4, draw=bs.integer_draw(3))
    joins = [line for line in _plan(out).splitlines() if "Join" in line and "pos" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sorted((r.k, r.low, r.high) for r in out.collect()) == [(0, 5.0, 5.0), (1, 5.0, 5.0)]


def test_hours_of_a_grid_are_dealt_to_all_tasks(spark):
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id")).alias("k"), F.timestamp_seconds((F.col("id") % 48) * 3600).alias("ts"))
    grid = hour_grid(common_bounds(rows, ["k"]), True)
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 * 48
    assert len(sizes) > 4 and max(sizes) < 400 * 48 / 3


def test_a_dataset_folder_has_one_file(spark, tmp_path):
    from tidegrid.sources import files

    rows = spark.range(4000).repartition(8).select(
        F.concat(F.lit("o"), F.col("id") % 5).alias("operator"), F.timestamp_seconds((F.col("id") % 24) * 3600).alias("ts"), F.col("id").alias("y")
    )
    data = files.write_dataset(rows, str(tmp_path), "basic", ["basic"])
    assert sorted(len([*p.glob("*.parquet")]) for p in Path(data).glob("operator=*")) == [1] * 5
    assert files.read_dataset(spark, data).agg(F.sum("y")).first()[0] == sum(range(4000))


def test_an_outage_document_is_parsed_once(spark):
    from tidegrid.sources import market_xml as mx

    xml = (
        "<U><mRID>A</mRID><revisionNumber>2</revisionNumber><TimeSeries><mRID>1</mRID><Available_Period><timeInterval><start>2024-01-01T00:00Z</start>"
        "<end>2024-01-01T02:00Z</end></timeInterval><resolution>PT60M</resolution><Point><position>1</position><quantity>5</quantity></Point>"
        "<Point><position>2</position><quantity>6</quantity></Point></Available_Period></TimeSeries></U>"
    )
    out = mx.outage_intervals(spark.createDataFrame([(xml,)], "xml string")).select("InstanceCode", "VersionNumber", "AvailableCapacityMW")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
    assert sorted((r.InstanceCode, r.VersionNumber, r.AvailableCapacityMW) for r in out.collect()) == [("A", 2, 5.0), ("A", 2, 6.0)]


def test_rows_do_not_gather_by_window(spark):
    from tidegrid.operators import sweeps as sw

    rows = spark.range(24 * 40).select(F.expr("concat('a', id div 960)").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ds"), (F.col("id") % 3).cast("double").alias("y"))
    days = [(i, *[F.timestamp_seconds(F.lit((i + d) * 86400)) for d in (0, 10, 20, 25)]) for i in (0, 5)]
    windows = spark.createDataFrame([(0,), (5,)], "window_index int")
    for at, name in enumerate(sw.NAMES, 1):
        windows = windows.withColumn(name, F.when(F.col("window_index") == 0, days[0][at]).otherwise(days[1][at]))
    out = sw.intermittent_sweep(rows.repartition("k", "ds"), windows, ["k"], [(0.1, 0.3)])
    found = out.groupBy("window_index").count().collect()
    assert {r.window_index: r["count"] for r in found} == {0: 5 * 24, 5: 5 * 24}
    # few windows: rows dealt by the window alone would meet in as many tasks
    assert not re.search(r"hashpartitioning\(coalesce\(window_index#\d+, [^()]*\), isnull\(window_index#\d+\), \d+\)", _plan(out))
    dealt = _plan(window_roles(rows, windows))
    assert "BroadcastHashJoin" in dealt and "BuildRight" in dealt and "BuildLeft" not in dealt


def test_prediction_folders_are_listed_once(spark, tmp_path):
    from tidegrid.sources import predictions as pred

    rows = spark.range(48).select(
        F.lit("up").alias("unique_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ds"), (F.col("id") % 24 + 1).cast("int").alias("horizon"),
        F.col("id").cast("double").alias("y"), (F.col("id") + 1).cast("double").alias("forecast"),
    )
    kind = "predictions_best_checkpoint"
    for tso in ("A", "B"):
        for model in ("one", "two"):
            rows.write.parquet(f"{tmp_path}/{tso}/ds1/window_0/evaluation/{kind}/{kind}_{model}_window0.parquet")
    out = pred.read_predictions(spark, str(tmp_path), "ds1")
    # every model needs the names found; listing files for each of them again takes a task for every few files
    assert "binaryfile" not in _plan(out).lower()
    assert {(r.model, r.tso): (r["count"], r.total) for r in out.groupBy("model", "tso").agg(F.count("*").alias("count"), F.sum("y_pred").alias("total")).collect()} == {
        (m, t): (48, 48 * 49 / 2) for m in ("one", "two") for t in ("A", "B")
    }


def test_compared_prediction_sets_are_not_broadcast(spark):
    from tidegrid.operators import dm

    rows = spark.range(96).select(
        F.lit("s").alias("tso"), F.lit("up").alias("unique_id"), F.lit("m").alias("model"), F.timestamp_seconds(F.col("id") * 3600).alias("ds"),
        (F.col("id") % 24 + 1).alias("horizon"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("y_pred"),
    )
    tests = dm.compare_sets(rows, rows.withColumn("y_pred", F.col("y_pred") + 1), dense=True)
    joins = [line for line in _plan(tests).splitlines() if "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert [r.n for r in tests.collect()] == [96]


def test_rejection_shares_broadcast_no_prediction_set(spark, tmp_path):
    from tidegrid.plans.catalog import QUERIES

    spark.range(600).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 30).alias("user_id"),
        F.lit("a").alias("event_type"), (F.col("id") % 11).cast("double").alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["sta4_rejection_shares"](spark, str(tmp_path))
    hourly = [line for line in _plan(out).splitlines() if "Join" in line and "coalesce(ds#" in line]
    assert hourly and all("SortMergeJoin" in line for line in hourly)
    assert {r.model for r in out.collect()} == {"blend", "damped", "naive", "seasonal"}


def test_folders_of_small_files_hold_what_sparks_writer_holds(spark, tmp_path):
    from tidegrid.sources import files

    keys = ["k1", "k2"]
    rows = spark.range(300).select(
        F.element_at(F.array(*[F.lit(x) for x in ("a", "b=1/2", "c:%", None, "")]), (F.col("id") % 5 + 1).cast("int")).alias("k1"),
        (F.col("id") % 3).alias("k2"), F.timestamp_seconds(F.col("id") * 3600).alias("ds"), F.when(F.col("id") % 7 > 0, F.col("id") / 2).alias("y"),
    )
    count = files.write_folders(rows, f"{tmp_path}/own", keys)
    rows.repartition("k1").write.partitionBy(*keys).parquet(f"{tmp_path}/spark")
    found = lambda name: sorted(str(p.parent.relative_to(tmp_path / name)) for p in (tmp_path / name).rglob("*.parquet"))
    assert set(found("own")) == set(found("spark"))
    # empty and null have one folder
    assert count == len(found("own")) == len(set(found("own"))) == 4 * 3
    read = lambda name: sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").select("k1", "k2", "ds", "y").collect()))
    assert read("own") == read("spark") and len(read("own")) == 300
    assert files.write_folders(rows.limit(0), f"{tmp_path}/none", keys) == 0


def test_located_files_are_sent_to_their_rows(spark, tmp_path):
    from tidegrid.sources import predictions as pred

    kind = "predictions_best_checkpoint"
    rows = spark.range(48).selectExpr("'up' AS unique_id", "timestamp_seconds(id * 3600) AS ds", "1 AS horizon", "CAST(id AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS forecast")
    for tso in ("A", "B"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{tso}/ds1/window_0/evaluation/{kind}/{kind}_one_window0.parquet")
    out = pred.read_predictions(spark, str(tmp_path), "ds1")
    joins = [line for line in _plan(out).splitlines() if "Join" in line]
    assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)
    assert out.count() == 96


def test_attribution_files_are_staged_in_one_file_a_folder(spark, tmp_path):
    from tidegrid.plans import q_sources

    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 20).alias("user_id"),
        F.lit("a").alias("event_type"), (F.col("id") % 11).cast("double").alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    root = Path(q_sources._stage_predictions(spark, str(tmp_path), True).removeprefix("file:"))
    found = [*root.rglob("*.parquet")]
    folders = {p.parent for p in found if p.is_file()}
    # 2 operators, 2 windows, 4 models, the best and the last checkpoint
    assert len(folders) == 2 * 2 * 4 * 2 and {p.name for p in found if p.is_file()} == {"part-00000.parquet"}
    assert spark.read.option("recursiveFileLookup", True).parquet(str(root)).count() == 2 * 2 * 400 * 4 * 2
