"""From documents to packed sequences: five stages, each an operator of termloom.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm import decontam, packing, quality, secrets, simhash
from termloom.llm.entries import table, tokenizer_path
from termloom.llm.shared import stash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.7 and more, as op8 scores them.

    Each row is judged by itself, repeated ones alike. A null doc_id teaches nothing and is judged; null, empty and blank
    texts have a score like any other; with labels of one kind all rows stay or go, without any all stay; an empty
    table stays empty. The model doesn't read other columns, whatever their names; one named score is kept as it was."""
    text = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    scored = quality.score(text, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("score >= 0.7").select(*(F.col("_doc")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that op6 links, one row: that of the smallest doc_id, ties by a hash of the row. Different
    texts of one doc_id are rows of their own. Rows without a doc_id have no order and stay. Null, empty and blank texts are
    one group; of repeated rows one stays; an empty table stays empty; further columns go along."""
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64(*docs.columns).alias("_row"))
    found = simhash.components(simhash.fingerprints(marked, keep=("_row",)))
    first = found.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "_row")).alias("r")).select("r.*")
    one = F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy(F.lit(0)))
    kept = marked.join(first, ["doc_id", "_row"], "left_semi").withColumn("_one", one).where("_one = 1")
    return kept.select(*(F.col("_doc")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go, as op10 finds them; documents that consist of them by more than half go as a whole.

    Each row is judged by itself, repeated ones alike; null, empty and blank texts stay as they are, as does every text
    without a hit; with no items nothing goes; an empty table stays empty; further columns go along."""
    cut = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)
    return counted(docs, cut)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that op7 reports becomes a mark, and those beside identifiers and endpoints of either case.

    Each row is changed by itself, repeated ones alike; null, empty and blank texts stay as they are, as does every text
    without a finding; an empty table stays empty; further columns go along."""
    return counted(docs, secrets.redact(docs))


def counted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """changed with docs' columns, n_chars as texts are now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op9's pieces and places.

    Each row is packed by itself, with or without a doc_id; a null, empty or blank text still has its end token; an empty
    table gives none; further columns are left out."""
    return packing.pack(packing.tokenize_pieces(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: A trained classifier takes part, which SQL can't express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
