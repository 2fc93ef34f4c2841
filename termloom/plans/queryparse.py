"""Keyword queries: words with the optional operators AND and OR."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    """groups are alternatives, each a conjunction of terms in query order."""

    groups: tuple[tuple[str, ...], ...]
    disjunctive: bool = False

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(t for g in self.groups for t in g)


def query_terms(word: str, strip: bool = False) -> list[str]:
    """Tokenised as documents are; or, with strip, lowered without , . ! ? and quotes."""
    if strip:
        word = word.translate(str.maketrans("", "", ',.!?"'))
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)] if word else []
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", word)]


def parse(line: str, strip: bool = False) -> Query:
    """`AND` changes nothing, `OR` starts another group; both in capitals only."""
    groups: list[list[str]] = [[]]
    seen_or = False
    for word in line.split():
        if word == "OR":
            seen_or = True
            groups.append([])
        elif word != "AND":
            groups[-1] += query_terms(word, strip)
    return Query(tuple(tuple(g) for g in groups if g), seen_or)
