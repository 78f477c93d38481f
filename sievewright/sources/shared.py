"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sievewright-")
    return _own[app]


def application_dir(spark: SparkSession) -> str:
    """What this application stores lies here; ``clear`` removes it."""
    return f"{shared_dir(spark)}/sievewright-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path for tables that ``discard`` removes together."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{within or application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was stored within a folder; nothing that is still read may lie there."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def clear(spark: SparkSession) -> None:
    """Remove all that this application stored, results that are read lazily included; call it when they are no longer needed."""
    discard(spark, application_dir(spark))
