"""Tables written to the shared folder and read again, so that lineage ends there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.session import staging_path


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``; survives the loss of executors. ``codec`` None: the session's."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one as a URI with its file system, for readers outside Spark's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_path(spark, name))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
