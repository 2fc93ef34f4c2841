"""Cutting lineage in the shared folder, and positions within ordered rows without gathering them in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def local_master(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The URI of a new folder below spark.checkpoint.dir, on the file system that Hadoop resolves it to. Where that
    setting is missing, a local master gets a temporary folder and any other an error. The folder goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not local_master(spark):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = getattr(shared_folder, "own", None)
        if base is None:
            local = tempfile.mkdtemp(prefix="termloom-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            shared_folder.own = base = f"file://{local}"
    at = _hadoop_path(spark, f"{base.rstrip('/')}/termloom-{uuid.uuid4().hex}")
    path = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def delete(spark: SparkSession, path: str) -> None:
    at = _hadoop_path(spark, path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df from a table in the shared folder, and where: lineage ends there, and an executor's loss costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df written in sorted ranges, with _range and _at, the rows' numbers that ascend in the order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(dealt).withColumn("_range", F.shiftright("_at", 33))


def with_rank(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """df with its position in the order. Rows are dealt by ranges, numbered within each, and shifted by the sizes of
    the ranges before: the one window without keys sees a row for each range, whose number is a setting."""
    placed = in_ranges(df, order)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(offsets), "_range")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + start).select(*df.columns, name)


def with_carried(placed: DataFrame, key: str, **totals: tuple[Column, Callable]) -> DataFrame:
    """Rows of ranges sorted by (key, ...) with totals (an aggregate and what combines it) over the key's rows in earlier
    ranges, null where there are none, and _split, whether the key lies in several ranges (null: it doesn't).

    Ranges are sorted by key, so only a range's first key can begin before it: at most two rows for each range are broadcast."""
    ends = placed.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    edge = placed.join(F.broadcast(ends), "_range").where((F.col(key) == F.col("_first")) | (F.col(key) == F.col("_last")))
    parts = edge.groupBy("_range", key).agg(*(agg.alias(name) for name, (agg, _) in totals.items()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = (F.count("*").over(Window.partitionBy(key)) > 1).alias("_split")
    known = parts.select("_range", key, split, *(combine(F.col(name)).over(before).alias(name) for name, (_, combine) in totals.items()))
    return placed.join(F.broadcast(known), ["_range", key], "left")
