"""Text files of a search stack as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.codes import running_sums
from termloom.functions.text import BLANKS, header_url
from termloom.plans.materialize import with_rank

POSTINGS = "term string, doc_id long, freq long"


def trec(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """url, text of <TEXT> elements, whose first word is the address; with ordered also doc_id by place in the files.

    The closing tag divides records, so large files split over tasks."""
    raw = spark.read.option("lineSep", "</TEXT>").text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    body = raw.where(F.instr("value", "<TEXT>") > 0).withColumn("_at", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace(F.substring_index("value", "<TEXT>", -1), f"^{BLANKS}|{BLANKS}$", ""))
    docs = body.select("_file", "_at", F.regexp_extract("value", r"^[^ \t\n\x0B\f\r]*", 0).alias("url"), F.regexp_replace("value", rf"^[^ \t\n\x0B\f\r]*({BLANKS})?", "").alias("text"))
    return with_rank(docs, ["_file", "_at"], "doc_id").select("doc_id", "url", "text") if ordered else docs.select("url", "text")


def gov2(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """url, html of the <DOC> elements of (gzipped) files. A broken file ends the read, or with skip_broken is passed over
    as a missing one is; broken_files() names them."""
    reader = spark.read.option("lineSep", "</DOC>")
    if skip_broken:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    docs = reader.text(path).where(F.instr("value", "<DOC>") > 0)
    return docs.select(F.trim(header_url(F.col("value"))).alias("url"), F.regexp_extract("value", r"(?is)<html[^>]*>.*", 0).alias("html"))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of gzipped files that don't begin as one; a file cut short later fails when it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.where(F.substring("content", 1, 2) != F.unhex(F.lit("1F8B"))).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=POSTINGS)


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, df; of a term that stands twice the first line's, files in the order of their names."""
    rows = spark.read.csv(path, sep=" ", schema="term string, df long").select("term", "df", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    return rows.groupBy("term").agg(F.min_by("df", F.struct("_file", "_start", "_at")).alias("df"))


def document_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="doc_id long, url string")


def document_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="doc_id long, doc_len long")


def document_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="doc_id long, url string, word_count long, distinct_words long")


def term_edges(spark: SparkSession, path: str) -> DataFrame:
    """term, doc_id from lines `term df first gap gap ...`."""
    parts = spark.read.text(path).select(F.split("value", " +").alias("p")).select(F.col("p")[0].alias("term"), F.transform(F.slice("p", 3, F.size("p")), lambda x: x.cast("long")).alias("gaps"))
    return parts.select("term", F.explode(running_sums(F.col("gaps"))).alias("doc_id"))


def permutation(spark: SparkSession, path: str) -> DataFrame:
    """old_id, new_id: the n-th line holds the old number of n."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), F.col("value").cast("long").alias("old_id"))
    return with_rank(rows, ["_file", "_at"], "new_id").select("old_id", "new_id")
