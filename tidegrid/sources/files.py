"""CSV and Parquet readers with explicit schemas, and the writers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidegrid.functions.timeutil import parse_interval_columns
from tidegrid.operators.densify import complete_grid, series_bounds, upsert
from tidegrid.session import path_uri
from tidegrid.sources import codes

# sources


def csv_by_name(spark: SparkSession, path: str | Sequence[str], schema: str, positions: int = 0, **options) -> DataFrame:
    """Columns of a CSV with a header, found by name whatever their order; other columns are left out.

    The first ``positions`` columns are taken as they stand, under the schema's names. Files whose header differs fail.
    """
    wanted = StructType.fromDDL(schema)
    path = path if isinstance(path, str) else list(path)
    header = spark.read.csv(path, header=True, **options).columns
    by_name = {f.name: f.dataType for f in wanted}
    for i, f in enumerate(wanted.fields[:positions]):
        by_name[header[i]] = f.dataType
    full = StructType([StructField(h, by_name.get(h, StringType())) for h in header])
    rows = spark.read.csv(path, header=True, schema=full, enforceSchema=False, **options)
    renamed = {header[i]: f.name for i, f in enumerate(wanted.fields[:positions])}
    return rows.withColumnsRenamed(renamed).select(*[F.col(f"`{f.name}`") for f in wanted])


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def read_interventions(
    spark: SparkSession, path: str, tz: str = "Europe/Berlin", extra: Sequence[str] = (), translate: bool = True
) -> DataFrame:
    """Semicolon CSV with decimal commas and local wall times to typed UTC interventions.

    The region column is dropped; cells are translated by literal substrings.
    """
    names = [*codes.INTERVENTION_COLUMNS, *extra]
    schema = ", ".join(f"`{n}` STRING" for n in names)
    raw = csv_by_name(spark, path, schema, sep=";")
    df = raw.withColumnsRenamed(codes.INTERVENTION_COLUMNS).drop("region")
    if translate:
        for column, words in codes.INTERVENTION_VALUES.items():
            df = df.withColumn(column, translate_words(F.col(column), words))
    for c in ("mean_load", "max_load", "total_load"):
        df = df.withColumn(c, decimal_comma(F.col(c)))
    return parse_interval_columns(df, tz).drop("begin_time", "end_time")


def translate_words(text: Column, words: dict[str, str]) -> Column:
    """Literal substring replacement, one word after the other."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), words.items(), text)


def read_hourly_csv(
    spark: SparkSession, path: str, columns: Sequence[str], ts: str = "begin_date",
    fmt: str = "yyyy-MM-dd HH:mm:ss", long: bool = True, drop: Sequence[str] = ("end_date",),
) -> DataFrame:
    """Wide hourly CSV; by default unpivoted to (ts, metric, value)."""
    schema = ", ".join([f"`{ts}` TIMESTAMP", *[f"`{d}` STRING" for d in drop], *[f"`{c}` DOUBLE" for c in columns]])
    wide = csv_by_name(spark, path, schema, timestampFormat=fmt).drop(*drop)
    return wide.unpivot([ts], [f"`{c}`" for c in columns], "metric", "value") if long else wide


def read_futures(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Daily closing prices from a staged CSV; ``#N/A`` is null."""
    raw = spark.read.csv(path, header=True, schema="day STRING, price STRING", nullValue="#N/A N/A")
    return raw.select(
        F.col("day").try_cast("date").alias("day"),
        F.col("price").try_cast("double").alias(name),
    ).where("day IS NOT NULL")


def read_holidays(spark: SparkSession, path: str, operators: Sequence[str]) -> DataFrame:
    """(day, operator, is_holiday) from a table with one flag column per operator."""
    schema = "day DATE, states STRING, " + ", ".join(f"`{o}` INT" for o in operators)
    wide = csv_by_name(spark, path, schema, positions=2, ignoreTrailingWhiteSpace=True)
    return wide.unpivot(["day"], [f"`{o}`" for o in operators], "operator", "is_holiday")


def read_dataset(spark: SparkSession, path: str, direction: str | None = None) -> DataFrame:
    """Model dataset; the direction filter reaches the scan."""
    df = spark.read.parquet(path)
    return df if direction is None else df.where(F.col("direction") == direction)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "operator STRING, name STRING, rows LONG, columns ARRAY<STRING>, feature_sets ARRAY<STRING>, first TIMESTAMP, last TIMESTAMP"
    return spark.read.schema(schema).json(path)


def read_matching(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All datasets called ``name``, the operator taken from the path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.col("_metadata.file_path")
    pattern = rf"{name}_([^/]+?)(?:\.parquet)?/"
    return df.withColumn("operator", F.regexp_extract(path, pattern, 1)).where("operator <> ''")


# sinks


def write_dataset(df: DataFrame, path: str, name: str, feature_sets: Sequence[str], ts: str = "ts") -> str:
    """Parquet partitioned by operator, metadata as JSON lines and a summary CSV next to it.

    Returns the path of the data. The metadata is one aggregated row per
    operator, written by Spark.
    """
    data = f"{path}/{name}"
    # a folder gets one file a month, however many tasks hold rows of its operator
    dealt = df.repartition("operator", F.date_trunc("month", ts))
    dealt.write.mode("overwrite").partitionBy("operator").parquet(data)
    stored = df.sparkSession.read.parquet(data)
    cols = [c for c in df.columns if c != "operator"]
    meta = stored.groupBy("operator").agg(
        F.lit(name).alias("name"),
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        F.array(*[F.lit(s) for s in feature_sets]).alias("feature_sets"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
    )
    meta.write.mode("overwrite").json(f"{path}/{name}_metadata")
    meta.select("operator", "name", "rows", F.size("columns").alias("n_columns"), "first", "last").write.mode(
        "overwrite"
    ).option("header", True).csv(f"{path}/{name}_summary")
    return data


def write_folders(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """One Parquet file in each folder ``key=value/…`` below ``path``, named as Spark's own writer names them; the number of files.

    For tables of very many small files: Spark's writer takes tens of milliseconds a file. Rows are dealt by the first key; a task holds
    one file's rows at a time. A repeated task writes the same files again.
    """
    keys, uri = list(keys), path_uri(df.sparkSession, path)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in df.columns if c not in keys]
    # empty and null are one folder
    named = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys]
    place = F.to_json(F.array(*named)).alias("_place")
    # sorted, so that a folder's rows come one after another
    rows = df.select(*values, place, named[0].alias("_first")).repartition(n, "_first").sortWithinPartitions("_place").drop("_first")

    def folder(place: str) -> str:
        escaped = lambda v: re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda c: f"%{ord(c[0]):02X}", v)
        return "/".join(f"{k}={escaped(v) if v is not None else '__HIVE_DEFAULT_PARTITION__'}" for k, v in zip(keys, json.loads(place)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        place, held, count = None, [], 0

        def close() -> int:
            if not held:
                return 0
            at = f"{root}/{folder(place)}"
            system.create_dir(at, recursive=True)
            pq.write_table(pa.Table.from_batches(held), f"{at}/part-00000.parquet", filesystem=system)
            return 1

        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("_place")
            known = places.dictionary_encode().indices.to_numpy()
            ends = [*(np.flatnonzero(known[1:] != known[:-1]) + 1).tolist(), len(known)]
            data, begin = batch.select(values), 0
            for end in ends:
                if (own := places[begin].as_py()) != place:
                    count += close()
                    place, held = own, []
                held.append(data.slice(begin, end - begin))
                begin = end
        yield pa.RecordBatch.from_pydict({"n": pa.array([count + close()], pa.int64())})

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def merge_with_existing(old: DataFrame, new: DataFrame, keys: Sequence[str], ts: str = "begin_date", keep: str = "last") -> DataFrame:
    """Upsert by (keys, ts) and complete the hours again; write the result to a new path."""
    merged = upsert(old, new, [*keys, ts], keep)
    if not keys:
        merged = merged.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    out = complete_grid(merged, by, series_bounds(merged, by, ts), ts=ts)
    return out if keys else out.drop("_all")


def cached_table(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read the table if it is there, else compute, write and read it."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
