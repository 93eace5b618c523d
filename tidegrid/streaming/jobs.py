"""Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.operators.densify import upsert
from tidegrid.operators.intervals import split_hourly
from tidegrid.session import cut_lineage


def hourly_stream(stream: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", delay: str = "2 hours") -> DataFrame:
    """Hourly sums that close when the watermark passes; later rows are dropped."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour"), *keys)
        .agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias("ts"), value, "n")
    )


def _hours_of(begin: str = "begin_date", end: str = "end_date") -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(begin)) / 3600


def dead_letters(stream: DataFrame, longest_hours: int = 48) -> DataFrame:
    """Events that ``interval_energy_stream`` leaves aside, unchanged, with their ``reason``."""
    hours = _hours_of()
    reason = F.when(hours.isNull(), "no duration").when(hours > longest_hours, f"longer than {longest_hours} hours")
    return stream.withColumn("reason", reason).where(F.col("reason").isNotNull())


def interval_energy_stream(
    stream: DataFrame, keys: Sequence[str] = ("operator", "direction"), method="equal",
    delay_hours: int = 12, longest_hours: int = 48,
) -> DataFrame:
    """Events to hourly energy: the split is stateless, the hourly sum is watermarked on the hour.

    An event's last hour lies up to ``longest_hours`` after its begin, so the watermark waits that much longer: an event is late only
    if its begin is more than ``delay_hours`` behind. A longer event, or one without a duration, is a dead letter: it counts nowhere
    and doesn't hold up or advance the others.
    """
    rows = split_hourly(stream.where(_hours_of() <= longest_hours), method).withWatermark("hour_begin", f"{delay_hours + longest_hours} hours")
    return (
        rows.groupBy(F.window("hour_begin", "1 hour"), *keys)
        .agg(F.sum("hour_load").alias("total_load"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("window.start").alias("ts"), "total_load", "n")
    )


def run_energy(stream: DataFrame, path: str, checkpoint: str, longest_hours: int = 48, **settings) -> tuple[DataFrame, DataFrame]:
    """Energy and dead letters of everything available; each output has a checkpoint of its own."""
    aside = run_once(dead_letters(stream, longest_hours), f"{path}/dead_letters", f"{checkpoint}/dead_letters")
    return run_once(interval_energy_stream(stream, longest_hours=longest_hours, **settings), f"{path}/energy", f"{checkpoint}/energy"), aside


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available into Parquet and read it back."""
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BucketedTable:
    """Keep-last table in folders by key hash, with a manifest for each version.

    A version rewrites only the buckets its rows fall into; its manifest lists one folder for each bucket, new or old. The manifest is written last, so a
    reader sees whole versions only, and a repeated batch finds its version done or writes the same folders again. Folders
    that none of the last ``keep`` manifests names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 32, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path, list(keys), buckets, max(keep, 1)
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        done = lambda name: self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{name}/_SUCCESS"))
        return [int(n.removeprefix("v=")) for n in self._names("manifest") if done(n)]

    def manifest(self, version: int) -> dict[int, str]:
        """Folder of each bucket that has rows: at most ``buckets`` entries."""
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/manifest/v={version:010d}")
        return {r.bucket: r.folder for r in rows.collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, version: int) -> None:
        """New version: ``rows``, unique by key, replace or join those of the version before."""
        done = self.versions()
        if version in done:
            return
        earlier = [v for v in done if v < version]
        folders = self.manifest(earlier[-1]) if earlier else {}
        fresh = cut_lineage(rows.withColumn("_bucket", self._bucket()))
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        old = [folders[b] for b in touched if b in folders]
        if old:
            before = self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/{f}" for f in old])
            fresh = upsert(before.withColumn("_bucket", self._bucket()), fresh, self.keys)
        data = f"data/v={version:010d}"
        fresh.repartition(len(touched) or 1, "_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/{data}")
        named = folders | {b: f"{data}/_bucket={b}" for b in touched}
        manifest = self.spark.createDataFrame(sorted(named.items()), "bucket int, folder string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={version:010d}")
        self._expire([*earlier, version])

    def _expire(self, done: list[int]) -> None:
        kept = done[-self.keep :]
        used = {folder for v in kept for folder in self.manifest(v).values()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for v in self._names("data"):
            if int(v.removeprefix("v=")) >= kept[-1]:
                continue
            names = [n for n in self._names(f"data/{v}") if n.startswith("_bucket=")]
            unused = [n for n in names if f"data/{v}/{n}" not in used]
            for n in [f"data/{v}"] if len(unused) == len(names) else [f"data/{v}/{n}" for n in unused]:
                self.fs.delete(path(f"{self.path}/{n}"), True)
        for v in done[: -self.keep]:
            self.fs.delete(path(f"{self.path}/manifest/v={v:010d}"), True)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """Rows of a version, the last one by default; no rows before the first."""
        done = self.versions()
        folders = self.manifest(done[-1] if version is None else version) if done else {}
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])


def upsert_stream(
    spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], buckets: int = 32, keep: int = 2
) -> DataFrame:
    """Keep-last table maintained batch by batch in a ``BucketedTable``; the row with the greatest ``batch_order`` of a batch wins."""
    table = BucketedTable(spark, path, keys, buckets, keep)
    values = [c for c in stream.columns if c not in [*keys, "batch_order"]]

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct(*values), F.col("batch_order"))
        table.write(batch.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*"), batch_id)

    q = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return table.read(stream.select(*keys, *values).schema)
