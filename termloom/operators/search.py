"""Boolean queries with BM25 over postings and document lengths."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scores import bm25
from termloom.operators.postings import lexicon
from termloom.plans.materialize import written
from termloom.plans.queryparse import Query

DIGITS = 6
#: Queries of a batch above this size are not broadcast.
BROADCAST_BYTES = 32 << 20


def scored(posts: DataFrame, lengths: DataFrame, terms: tuple[str, ...], n_docs: int | None = None, average: float | None = None) -> DataFrame:
    """term, doc_id, freq, df, score of every posting of the terms. A repeated query term counts as often as it is named.

    The filter on term reaches the postings' scan or tokens; df has a row for each term and is broadcast, as is the
    corpus' single row. Lengths join by doc_id."""
    found = posts.where(F.col("term").isin(*terms)) if terms else posts.where(F.lit(False))
    corpus = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("doc_len").alias("a")).select(F.lit(float(n_docs)).alias("n") if n_docs else "n", F.lit(float(average)).alias("a") if average else "a")
    rows = found.join(F.broadcast(lexicon(found)), "term").join(lengths, "doc_id").join(F.broadcast(corpus))
    times = Counter(terms)
    weight = reduce(lambda acc, kv: acc.when(F.col("term") == kv[0], kv[1]), ((t, n) for t, n in times.items() if n > 1), F.when(F.lit(False), 1)).otherwise(1)
    return rows.select("term", "doc_id", "freq", "df", (bm25(F.col("n"), F.col("df"), F.col("freq"), F.col("doc_len"), F.col("a")) * weight).alias("score"))


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "doc_id").limit(k)


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.count("*").alias("_n"))


def conjunctive(posts: DataFrame, lengths: DataFrame, terms: tuple[str, ...], k: int | None = 10, **corpus) -> DataFrame:
    """doc_id, score of documents with all terms; none where a term is unknown or the query is empty."""
    hits = _sum(scored(posts, lengths, terms, **corpus)).where(F.col("_n") == len(set(terms))).where(F.lit(bool(terms))).drop("_n")
    return top(hits, k) if k else hits


def disjunctive(posts: DataFrame, lengths: DataFrame, terms: tuple[str, ...], k: int | None = 10, positive: bool = False, **corpus) -> DataFrame:
    """doc_id, score of documents with any term; scores of exactly zero, or with positive all up to it, are left out."""
    hits = _sum(scored(posts, lengths, terms, **corpus)).drop("_n")
    hits = hits.where("score > 0") if positive else hits.where("score <> 0")
    return top(hits, k) if k else hits


def alternatives(posts: DataFrame, lengths: DataFrame, groups: tuple[tuple[str, ...], ...], k: int = 10, **corpus) -> DataFrame:
    """group_no, doc_id, score: the best k of each conjunction, then the best k of all. A document may come from several groups."""
    parts = [conjunctive(posts, lengths, g, k, **corpus).select(F.lit(i).alias("group_no"), "doc_id", "score") for i, g in enumerate(groups)]
    if not parts:
        return conjunctive(posts, lengths, (), None).select(F.lit(0).alias("group_no"), "doc_id", "score")
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "doc_id", "group_no").limit(k)


def details(posts: DataFrame, lengths: DataFrame, hits: DataFrame, terms: tuple[str, ...], **corpus) -> DataFrame:
    """hits with terms: array of (term, freq, df) in query order."""
    order = {t: i for i, t in reversed(list(enumerate(terms)))}
    place = reduce(lambda acc, kv: acc.when(F.col("term") == kv[0], kv[1]), order.items(), F.when(F.lit(False), 0))
    rows = scored(posts, lengths, terms, **corpus).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("i"), "term", "freq", "df"))), lambda x: F.struct(x["term"].alias("term"), x["freq"].alias("freq"), x["df"].alias("df")))
    return hits.join(rows.groupBy("doc_id").agg(listed.alias("terms")), "doc_id")


def documents_with_all(posts: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    return posts.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")


def documents_with_any(posts: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    return posts.where(F.col("term").isin(*terms)).select("doc_id").distinct()


def run(posts: DataFrame, lengths: DataFrame, query: Query, k: int = 10, dnf: bool = False, **corpus) -> DataFrame:
    """doc_id, score of a parsed query. One OR makes all terms alternatives; with dnf it divides conjunctions."""
    if not query.disjunctive:
        return conjunctive(posts, lengths, query.terms, k, **corpus)
    if dnf:
        return alternatives(posts, lengths, query.groups, k, **corpus).select("doc_id", "score")
    return disjunctive(posts, lengths, query.terms, k, **corpus)


def rank_batch(posts: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10, disjunctive: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank of many conjunctions (or disjunctions, as of disjunctive()) at once; queries (query_id, term) are joined, not looped over.

    Postings without a wanted term go before they are shuffled; the rest is dealt by doc_id once. Up to BROADCAST_BYTES the
    queries come to every task, so a document's scores are summed where it lies, and only k hits of a query leave a task.
    More queries are joined by term. Postings without a term or doc_id count nowhere."""
    wanted = written(queries.select("query_id", "term").distinct())
    size = wanted.agg(F.count("*") * 64 + F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    sent = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    corpus = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("doc_len").alias("a"))
    # Both uses of the postings need the same rows and columns, or they would not share one exchange: hence the filter, and
    # df by freq, which is never 0.
    found = posts.where("doc_id is not null and term is not null").join(sent(wanted.select("term").distinct()), "term", "left_semi")
    known = found.groupBy("term").agg(F.count_if(F.col("freq") > 0).alias("df"))
    weights = wanted.join(known, "term").join(need, "query_id")
    rows = found.join(lengths.hint("merge"), "doc_id").join(sent(weights), "term").join(F.broadcast(corpus))
    rows = rows.withColumn("score", bm25(F.col("n"), F.col("df"), F.col("freq"), F.col("doc_len"), F.col("a")))
    hits = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.count("*").alias("have"), F.max("need").alias("need"))
    hits = hits.where("score <> 0" if disjunctive else "have = need")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.select("query_id", "doc_id", "score", best.alias("rank")).where(F.col("rank") <= k)
