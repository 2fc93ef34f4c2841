"""Ranking and gain formulas."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25(n_docs: Column, df: Column, freq: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Its logarithm is negative for terms in more than half of the documents; nothing is clamped."""
    scale = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average)
    return F.ln((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5))) * F.lit(k1 + 1.0) * freq / (scale + freq)


def _log2(x: float) -> float:
    return math.log2(x) if x > 0 else math.nan


def move_gain(own: Column, other: Column, own_size: Column, other_size: Column, first_term_only: bool = False) -> Column:
    """What moving a document away saves for one term, whose degrees in its own and the other half are given; null if there is none to move.

    first_term_only subtracts just the first of the two costs after the move and adds the second. The C library's log2 is
    taken, as databases take it: Spark's, a quotient of natural logarithms, is off by a bit in a third of all cases, and
    degrees multiply that until sixth decimals differ."""

    def gain(o: float, r: float, no: float, nr: float) -> float:
        before = o * _log2(no / (o + 1)) + r * _log2(nr / (r + 1))
        left, joined = (o - 1) * _log2(no / o), (r + 1) * _log2(nr / (r + 2))
        return before - left + joined if first_term_only else before - (left + joined)

    @F.pandas_udf("double")
    def gains(own: pd.Series, other: pd.Series, own_size: pd.Series, other_size: pd.Series) -> pd.Series:
        found = (gain(*x) if x[0] >= 1 and x == x else math.nan for x in zip(own, other, own_size, other_size))
        return pd.Series([None if math.isnan(g) else g for g in found], dtype="Float64")

    return gains(*(c.cast("double") for c in (own, other, own_size, other_size)))


def rounded(x: Column, places: int) -> Column:
    """x times a power of ten, rounded half away from zero and divided again, as databases round doubles."""
    scaled = x * F.lit(10.0**places)
    whole = F.floor(F.abs(scaled)).cast("double")
    return F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**places)


def priority(importance: Column, seen_of_site: Column) -> Column:
    return F.lit(5.0) / seen_of_site + importance
