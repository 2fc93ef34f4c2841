"""Streaming twins: postings of arriving documents, and a frontier fed by arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from termloom.operators import crawl
from termloom.operators.postings import tokens


def stream(spark: SparkSession, path: str, schema: str | StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n over all that has arrived."""
    return tokens(docs).groupBy("term").agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n; events later than the watermark are left out, and state is bounded by it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def feed_frontier(pages: DataFrame, table: str, checkpoint: str, most: int = crawl.PER_SITE) -> StreamingQuery:
    """Append each batch's new links to the frontier below `table`, capped by site over the whole crawl."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{table}/batch={batch_id}"
        try:
            seen = spark.read.parquet(table).where(F.col("batch") < batch_id)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = spark.createDataFrame([], "url string, netloc string")
        fresh = crawl.discovered(crawl.links(batch)).join(seen.select("url"), "url", "left_anti")
        capped = crawl.cap_sites(fresh, ["first_page", "url"], seen.groupBy("netloc").agg(F.count("*").alias("n")), most)
        capped.select("url", "netloc").write.mode("overwrite").parquet(target)  # a repeated batch replaces itself

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
