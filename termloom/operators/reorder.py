"""New document numbers: by address, by distinct words, by a permutation, by bisection of the term graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scores import move_gain, rounded
from termloom.operators.postings import within_blocks
from termloom.functions.codes import gamma_length
from termloom.plans.materialize import with_rank, written


def permutation(docs: DataFrame, order: list[str | Column], key: str = "doc_id") -> DataFrame:
    """old_id, new_id: the place in the order, from 0."""
    return with_rank(docs, [*order, key] if key not in order else order, "new_id").select(F.col(key).alias("old_id"), "new_id")


def reassign(posts: DataFrame, perm: DataFrame) -> DataFrame:
    """term, doc_id (new), freq; postings of documents outside the permutation go."""
    return posts.join(perm, posts.doc_id == perm.old_id).select("term", F.col("new_id").alias("doc_id"), "freq")


def unmatched(posts: DataFrame, perm: DataFrame) -> DataFrame:
    """doc_id, postings of documents outside the permutation."""
    return posts.join(perm, posts.doc_id == perm.old_id, "left_anti").groupBy("doc_id").agg(F.count("*").alias("postings"))


def gap_bits(posts: DataFrame) -> DataFrame:
    """n_postings, bits: gamma bits of all gaps within blocks."""
    return within_blocks(posts).agg(F.count("*").alias("n_postings"), F.sum(gamma_length(F.col("gap"))).cast("long").alias("bits"))


def halves(perm: DataFrame) -> DataFrame:
    """doc_id, side: the first and the second half by new_id; of an odd number the last stays out."""
    n = perm.agg(F.count("*").alias("_n"))
    half = F.floor(F.col("_n") / 2)
    return perm.join(F.broadcast(n)).where(F.col("new_id") < 2 * half).select(F.col("old_id").alias("doc_id"), F.when(F.col("new_id") < half, 0).otherwise(1).alias("side"))


def degrees(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """term, deg_a, deg_b."""
    count = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).cast("long")
    return edges.join(sides, "doc_id").groupBy("term").agg(count(0).alias("deg_a"), count(1).alias("deg_b"))


def gains(edges: DataFrame, sides: DataFrame, first_term_only: bool = False) -> DataFrame:
    """doc_id, side, gain of moving the document to the other half; documents without a frequent term gain 0."""
    sizes = sides.agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("double").alias("na"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).cast("double").alias("nb"))
    a, b, na, nb = (F.col(c) for c in ("deg_a", "deg_b", "na", "nb"))
    each = degrees(edges, sides).join(F.broadcast(sizes)).select("term", move_gain(a, b, na, nb, first_term_only).alias("gain_a"), move_gain(b, a, nb, na, first_term_only).alias("gain_b"))
    rows = edges.join(sides, "doc_id").join(each, "term")
    summed = rows.groupBy("doc_id").agg(F.sum(F.when(F.col("side") == 0, F.col("gain_a")).otherwise(F.col("gain_b"))).alias("g"))
    return sides.join(summed, "doc_id", "left").select("doc_id", "side", (rounded(F.coalesce("g", F.lit(0.0)), 6) + F.lit(0.0)).alias("gain"))


def swaps(gained: DataFrame) -> DataFrame:
    """rn, a_doc, b_doc, total: the i-th best of each half while both together gain."""
    ranked = [with_rank(gained.where(F.col("side") == s).select("doc_id", "gain"), [F.desc("gain"), "doc_id"], "rn", 1) for s in (0, 1)]
    a, b = (r.select("rn", F.col("doc_id").alias(f"{n}_doc"), F.col("gain").alias(f"{n}_gain")) for n, r in zip("ab", ranked))
    return a.join(b, "rn").select("rn", "a_doc", "b_doc", rounded(F.col("a_gain") + F.col("b_gain"), 6).alias("total")).where("total > 0")


def bisect_once(edges: DataFrame, perm: DataFrame, first_term_only: bool = False) -> DataFrame:
    """old_id, new_id after one round: swapped documents take each other's place."""
    swapped = swaps(gains(edges, halves(perm), first_term_only))
    partner = swapped.select(F.col("a_doc").alias("old_id"), F.col("b_doc").alias("other")).union(swapped.select("b_doc", "a_doc"))
    places = perm.select(F.col("old_id").alias("other"), F.col("new_id").alias("taken"))
    moved = perm.join(partner, "old_id", "left").join(places, "other", "left")
    return moved.select("old_id", F.coalesce("taken", "new_id").alias("new_id"))


def bisect(edges: DataFrame, perm: DataFrame, levels: int, rounds: int = 5) -> DataFrame:
    """Recursive graph bisection (Dhulipala et al., 2016): all parts of a level are worked on at once, by (part, term).

    Each round is written to the shared folder; parts of fewer than two documents rest."""
    now = perm.select("old_id", "new_id", F.lit(0).cast("long").alias("part"))
    for _ in range(levels):
        for _ in range(rounds):
            now = written(_round(edges, now))
        size = Window.partitionBy("part")
        place = F.col("new_id") - F.min("new_id").over(size)
        now = written(now.withColumn("part", F.col("part") * 2 + F.when(place < F.floor(F.count("*").over(size) / 2), 0).otherwise(1)))
    return now.select("old_id", "new_id")


def _round(edges: DataFrame, now: DataFrame) -> DataFrame:
    sizes = now.groupBy("part").agg(F.min("new_id").alias("low"), F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    at = F.col("new_id") - F.col("low")
    sided = now.join(sizes, "part").where(at < 2 * half).select(F.col("old_id").alias("doc_id"), "new_id", "part", F.when(at < half, 0).otherwise(1).alias("side"), half.cast("double").alias("size"))
    linked = edges.join(sided, "doc_id")
    count = lambda s: F.sum(F.when(F.col("side") == s, 1.0).otherwise(0.0))
    a, b, size = (F.col(c) for c in ("a", "b", "size"))
    each = linked.groupBy("part", "term", "size").agg(count(0).alias("a"), count(1).alias("b")).select("part", "term", move_gain(a, b, size, size).alias("gain_a"), move_gain(b, a, size, size).alias("gain_b"))
    own = F.when(F.col("side") == 0, F.col("gain_a")).otherwise(F.col("gain_b"))
    gained = linked.join(each, ["part", "term"]).groupBy("doc_id").agg(rounded(F.sum(own), 6).alias("gain"))
    ranked = sided.join(gained, "doc_id", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("part", "side").orderBy(F.desc("gain"), "doc_id")))
    a, b = (ranked.where(F.col("side") == s).select("part", "rn", F.col("doc_id").alias(f"{n}_doc"), F.col("new_id").alias(f"{n}_at"), F.col("gain").alias(f"{n}_gain")) for s, n in ((0, "a"), (1, "b")))
    pairs = a.join(b, ["part", "rn"]).where("a_gain + b_gain > 0")
    taken = pairs.select(F.col("a_doc").alias("old_id"), F.col("b_at").alias("taken")).union(pairs.select("b_doc", "a_at"))
    return now.join(taken, "old_id", "left").select("old_id", F.coalesce("taken", "new_id").alias("new_id"), "part")
