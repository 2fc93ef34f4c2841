"""A search engine over a persisted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import postings as P
from termloom.operators import search, snippets
from termloom.plans.queryparse import Query, parse
from termloom.sources import writers


class SearchEngine:
    """Postings and lengths as DataFrames; documents, if given, for snippets."""

    def __init__(self, posts: DataFrame, lengths: DataFrame, docs: DataFrame | None = None, whole: DataFrame | None = None):
        """whole: the rows of posts by a plan made for reading all of them."""
        self.posts, self.lengths, self.docs, self.whole = posts, lengths, docs, whole or posts

    @classmethod
    def from_documents(cls, docs: DataFrame, tokenizer: str = "alnum") -> SearchEngine:
        return cls(P.postings(docs, tokenizer), P.document_lengths(docs), docs, P.whole_postings(docs, tokenizer))

    @classmethod
    def open(cls, spark: SparkSession, path: str, docs: DataFrame | None = None) -> SearchEngine:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), docs)

    def save(self, path: str) -> SearchEngine:
        writers.index(self.whole, self.lengths, path)
        return SearchEngine.open(self.posts.sparkSession, path, self.docs)

    def search(self, query: str | Query, k: int = 10, dnf: bool = False, strip: bool = False) -> DataFrame:
        return search.run(self.posts, self.lengths, parse(query, strip) if isinstance(query, str) else query, k, dnf)

    def show(self, query: str | Query, k: int = 10) -> DataFrame:
        """doc_id, score, doc_len, terms, lp, rp, snippet of the best hits; texts are read for these alone."""
        if self.docs is None:
            raise ValueError("snippets need documents: open the index with docs")
        query = parse(query) if isinstance(query, str) else query
        hits = self.search(query, k)
        told = search.details(self.posts, self.lengths, hits, query.terms).join(self.lengths, "doc_id")
        return told.join(snippets.snippets(self.docs, query.terms, hits), "doc_id")
