"""Tokenizers, query-side normalisation and document parsing as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]+"


def _non_empty(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def letters(text: Column) -> Column:
    """Runs of ASCII letters, case kept."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def prefixes(text: Column, lower: bool = False) -> Column:
    """Of each word between blanks and newlines the alphanumeric beginning; words without one are dropped."""
    starts = _non_empty(F.transform(F.split(text, "[ \n]+"), lambda w: F.regexp_extract(w, "^[A-Za-z0-9]+", 0)))
    return F.transform(starts, F.lower) if lower else starts


def alnum(text: Column) -> Column:
    """All alphanumeric ASCII runs, then lowered: lowering first would turn other letters into ASCII."""
    return F.transform(alnum_runs(text), F.lower)


def strip_html(html: Column) -> Column:
    """Text inside <html>, without scripts and tags; empty where the document has no such element."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "(?s)<[^>]*>", " ")
    return F.when(html.rlike("(?i)<html[^>]*>"), bare).otherwise(F.lit(""))


def html_alnum(html: Column) -> Column:
    return alnum(strip_html(html))


TOKENIZERS = {"letters": letters, "prefix": prefixes, "prefix_lower": lambda t: prefixes(t, True), "alnum": alnum, "html": html_alnum}


def alnum_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


#: Tokenizers whose tokens are lowered last: exploded first, they are lowered in generated code, not in a lambda.
LOWERED_LAST = {"prefix_lower": prefixes, "alnum": alnum_runs, "html": lambda h: alnum_runs(strip_html(h))}


#: Of each tokenizer what is done to the text first, the tokens' pattern, and whether they are lowered last.
PATTERNS = {
    "letters": (None, "[A-Za-z]+", False),
    "prefix": (None, r"(?:^|[ \n])([A-Za-z0-9]+)", False),
    "prefix_lower": (None, r"(?:^|[ \n])([A-Za-z0-9]+)", True),
    "alnum": (None, "[A-Za-z0-9]+", True),
    "html": (strip_html, "[A-Za-z0-9]+", True),
}


def finder(tokenizer: str) -> Callable[[str], list[str]]:
    """The tokenizer in Python, for a text that has been through what PATTERNS does first."""
    _, pattern, lower = PATTERNS[tokenizer]
    find = re.compile(pattern).findall
    return (lambda t: [w.lower() for w in find(t)]) if lower else find


def words(text: Column) -> Column:
    """Words between any white space."""
    return _non_empty(F.split(text, BLANKS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def normalise_query_word(word: Column) -> Column:
    """Lowered, without , . ! ? and quotes."""
    return F.translate(F.lower(word), ',.!?"', "")


def header_url(raw: Column) -> Column:
    """The line after a document header's tag."""
    return F.regexp_extract(raw, r"<DOCHDR>\n([^\n]*)", 1)
