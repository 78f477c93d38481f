"""Small helpers of the operators; what they store goes to the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import application_dir, clear, discard, folder, shared_dir, stored  # noqa: F401

HOT_SHARE, HOT_ROWS = 10_000, 500


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def packed(docs: DataFrame, *leave_out: str) -> Column:
    """The caller's columns as one struct named ``row``: no column that an operator adds can clash with one of them."""
    names = [c for c in docs.columns if c.lower() not in leave_out]
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names)).alias("row")


def lookup(rows: DataFrame, key: str, found: DataFrame, within: str) -> DataFrame:
    """rows, left-joined with ``found`` (one row a key), however many rows share a key.

    Keys of more than one in ``HOT_SHARE`` rows (and of more than ``HOT_ROWS``) are at most ``HOT_SHARE``, so their part of
    ``found`` is broadcast; all other rows are joined by key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    size = counts.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    limit = max(HOT_ROWS, (size["all"] or 0) // HOT_SHARE)
    if (size["most"] or 0) <= limit:
        return rows.join(found, key, "left")
    hot = stored(counts.where(F.col("count") > limit).select(key), "hot", within)
    few = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(found.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return few.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(found, key, "left"))
