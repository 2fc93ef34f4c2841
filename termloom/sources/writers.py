"""Sinks: the persisted index and text files that the readers understand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(posts: DataFrame, lengths: DataFrame, path: str, partitions: int | None = None) -> None:
    """postings in ranges of (term, doc_id), so that a term's row groups are found by their statistics; lengths by doc_id."""
    keys = ["term", "doc_id"]
    dealt = posts.repartitionByRange(partitions, *keys) if partitions else posts.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def _lines(df: DataFrame, path: str, *columns: str) -> None:
    df.select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)


def postings(posts: DataFrame, path: str) -> None:
    _lines(posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), path, "term", "doc_id", "freq")


def lexicon(terms: DataFrame, path: str) -> None:
    _lines(terms, path, "term", "df")


def document_map(docs: DataFrame, path: str) -> None:
    _lines(docs, path, "doc_id", "url")


def document_lengths(lengths: DataFrame, path: str) -> None:
    _lines(lengths, path, "doc_id", "doc_len")


def document_info(info: DataFrame, path: str) -> None:
    _lines(info, path, "doc_id", "url", "word_count", "distinct_words")


def term_edges(edges: DataFrame, path: str) -> None:
    """Lines `term df first gap gap ...` of edges (term, df, pos, gap): the format wants a term's list in one line, so in one row."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "gap"))), lambda x: x["gap"].cast("string"))
    _lines(edges.groupBy("term", "df").agg(F.array_join(listed, " ").alias("gaps")), path, "term", "df", "gaps")


def permutation(perm: DataFrame, path: str) -> None:
    _lines(perm.repartitionByRange("new_id").sortWithinPartitions("new_id"), path, "old_id")


def trec(docs: DataFrame, path: str) -> None:
    """docs (url, text) as <TEXT> elements; a null text is empty."""
    element = F.concat(F.lit("<TEXT>\n"), "url", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>"))
    docs.select(element.alias("value")).write.mode("overwrite").text(path)


def gov2(pages: DataFrame, path: str) -> None:
    """pages (url, html) as gzipped <DOC> elements with their address in the header; null html is empty."""
    element = F.concat(F.lit("<DOC>\n<DOCHDR>\n"), "url", F.lit("\n</DOCHDR>\n"), F.coalesce("html", F.lit("")), F.lit("\n</DOC>"))
    pages.select(element.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def report(shown: DataFrame) -> DataFrame:
    """doc_id, line of hits (doc_id, score, doc_len, terms, snippet)."""
    each = F.array_join(F.transform("terms", lambda x: F.format_string("%s freq:%d total_posting:%d", x["term"], x["freq"], x["df"])), ", ")
    return shown.select("doc_id", F.format_string("docID:%d score:%.4f docLength:%d %s | %s", "doc_id", "score", "doc_len", each, "snippet").alias("line"))
