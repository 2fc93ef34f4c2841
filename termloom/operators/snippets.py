"""The shortest span of words that holds all query terms, and its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.operators.postings import positions

AROUND, LONGEST = 10, 50


def windows(docs: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """doc_id, lp, rp (exclusive) of the first shortest span with all terms; documents without one are left out.

    For each place, the last place of every term up to it is a running maximum; the least of these starts the span."""
    wanted = tuple(dict.fromkeys(terms))
    if not wanted:
        return docs.select("doc_id", F.lit(0).cast("long").alias("lp"), F.lit(0).cast("long").alias("rp")).where(F.lit(False))
    hits = positions(docs).where(F.col("term").isin(*wanted))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(so_far).alias(f"a{i}") for i, t in enumerate(wanted)]
    seen = hits.select("doc_id", "pos", *last)
    there = reduce(lambda a, b: a & b, (F.col(f"a{i}").isNotNull() for i in range(len(wanted))))
    left = F.least(*(f"a{i}" for i in range(len(wanted)))) if len(wanted) > 1 else F.col("a0")
    spans = seen.where(there).select("doc_id", left.alias("lp"), (F.col("pos") + 1).alias("rp"))
    best = spans.groupBy("doc_id").agg(F.min(F.struct((F.col("rp") - F.col("lp")).alias("len"), "rp", "lp")).alias("s"))
    return best.select("doc_id", F.col("s.lp").alias("lp"), F.col("s.rp").alias("rp"))


def occurrence(docs: DataFrame, term: str, last: bool = False) -> DataFrame:
    """doc_id, pos of a term's first (or last) word."""
    return positions(docs).where(F.col("term") == term).groupBy("doc_id").agg((F.max if last else F.min)("pos").alias("pos"))


def snippets(docs: DataFrame, terms: tuple[str, ...], hits: DataFrame | None = None) -> DataFrame:
    """doc_id, lp, rp, snippet: ten words around the span, each followed by a blank; of a span of more than fifty words its ends.

    With hits, only their documents are read into words; a limit on hits lets the planner broadcast them."""
    if hits is not None:
        docs = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    spans = docs.select("doc_id", text.words(F.col("text")).alias("w")).join(windows(docs, terms), "doc_id", "left")
    n = F.size("w")
    cut = lambda s, e: F.concat(F.array_join(F.slice("w", s + 1, F.greatest(e - s, F.lit(0))), " "), F.lit(" "))
    start, stop = F.greatest(F.col("lp") - AROUND, F.lit(0)).cast("int"), F.least(F.col("rp") + AROUND, n).cast("int")
    one = cut(start, stop)
    two = F.concat(cut(start, F.least(F.col("lp") + AROUND, n).cast("int")), F.lit("...... "), cut((F.col("rp") - AROUND).cast("int"), stop))
    shown = F.when(F.col("lp").isNull(), "snippet unavailable").when(F.col("rp") - F.col("lp") <= LONGEST, one).otherwise(two)
    return spans.select("doc_id", "lp", "rp", shown.alias("snippet"))
