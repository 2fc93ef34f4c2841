"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by themselves. Weak parts (short assigned values, account names, endpoints, opaque keys) are
candidates: an interval join over the document's parts, a window with a range frame of `scope` code points, tells
which complementary parts start within their scope, and only those with a partner are reported:
a weak secret or opaque key beside an identifier, an identifier beside a secret, an endpoint beside both.

Each pattern runs once over a text, and not at all where a word that it needs is missing: one replacement puts marks
around matches, the text is cut at these, and places follow from the lengths of what lies between, summed along the
document. One scan and one shuffle of a narrow row for each part; texts are not moved.

Cases: null text is empty; documents of nothing have zero counts and an empty list; each row is judged by itself,
so equal doc_ids and repeated rows keep their rows; texts may hold the marks' characters; spans that start together are ordered by kind; further columns are
ignored; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.shared import stash

VALUE = r"[A-Za-z0-9+/_.=-]+"
SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group whose length counts; the order of kinds is that of spans which start together
KINDS = (
    ("assign", rf"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]){SET}({VALUE})", 1),
    ("access", r"AKIA[A-Z0-9]+", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    ("id", rf"(?:client_?id|access_?key_?id|account|username|user|login){SET}([A-Za-z0-9@_.-]+)", 1),
    ("endpoint", r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+""", 0),
    ("opaque", r"[A-Za-z0-9+/]{40,}", 0),
)
#: Words, in lower case, of which a match holds one.
NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "id": ("client", "access", "account", "user", "login"), "endpoint": ("://",)}
#: Marks behind a match, and before it and its group: code points that are no characters.
CUT, PART = "\ufdd0", "\ufdd1"
#: kind's number, pattern, group: identifiers and endpoints in either case, which redact() finds beside KINDS
ANY_CASE = tuple((n, f"(?i){KINDS[n][1]}", KINDS[n][2]) for n in (3, 4))
STRONG = "(kind = 0 and size >= 12 or kind = 1 and size >= 18 or kind = 2 and size >= 16)"
WEAK = f"(not {STRONG} and (kind = 0 and size between 6 and 11 or kind = 3 and size >= 3 or kind = 4 or kind = 5 and size = 40))"
NAMES = [k for k, _, _ in KINDS]


def _part(slot: int, number: int):
    """Of "gap PART match PART group" the lengths."""
    cut = lambda x, n: F.length(F.substring_index(x, PART, n))
    return lambda x, no: F.struct(
        F.lit(slot).alias("slot"),
        F.lit(number).alias("kind"),
        no.cast("int").alias("no"),
        cut(x, 1).cast("long").alias("gap"),
        F.length(F.substring_index(F.substring_index(x, PART, 2), PART, -1)).cast("long").alias("len"),
        cut(x, -1).alias("size"),
    )


def _parts(text: Column, low: Column, any_case: bool) -> list[Column]:
    """For each pattern, its matches with the gap before each. text is without the marks, low its lower case."""
    none = F.expr("cast(array() as array<struct<slot:int,kind:int,no:int,gap:bigint,len:bigint,size:int>>)")
    out = []
    patterns = [(n, p, g) for n, (_, p, g) in enumerate(KINDS)] + list(ANY_CASE if any_case else ())
    for slot, (number, pattern, group) in enumerate(patterns):
        pieces = F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{PART}$1{PART}${group + 1}{CUT}")), CUT, -1)
        rows = F.transform(F.filter(pieces, lambda x: F.contains(x, F.lit(PART))), _part(slot, number))
        needed = [F.contains(low, F.lit(w)) for w in NEEDS.get(NAMES[number], ())]
        out.append(F.when(reduce(lambda a, b: a | b, needed), rows).otherwise(none) if needed else rows)
    return out


def find_spans(docs: DataFrame, scope: int = 200, any_case: bool = False) -> DataFrame:
    """row long, doc_id and spans: sorted array of (start, kind, end, strong). One row for each row of docs (doc_id, text).

    With any_case identifiers and endpoints count in either case, and a span found in both ways is listed twice. row is monotonically_increasing_id() over docs."""
    return _spans(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), scope, any_case)


def _spans(rows: DataFrame, scope: int, any_case: bool) -> DataFrame:
    """find_spans of rows (row, doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(CUT)) | F.contains(text, F.lit(PART))
    plain = rows.select("row", "doc_id", F.when(marked, F.translate(text, CUT + PART, "??")).otherwise(text).alias("t"))
    rows = plain.withColumn("low", F.lower("t")).select("row", "doc_id", F.concat(*_parts(F.col("t"), F.col("low"), any_case)).alias("parts"))
    each = rows.select("row", "doc_id", F.explode_outer("parts").alias("p")).select("row", "doc_id", "p.*").repartition("row")
    along = Window.partitionBy("row", "slot").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len"))
    placed = placed.withColumn("strong", F.coalesce(F.expr(STRONG), F.lit(False))).withColumn("weak", F.coalesce(F.expr(WEAK), F.lit(False)))
    part = placed.withColumn("is_id", F.col("strong") & (F.col("kind") == 1) | F.col("weak") & (F.col("kind") == 3))
    part = part.withColumn("is_secret", F.col("strong") & F.col("kind").isin(0, 2) | F.col("weak") & F.col("kind").isin(0, 5))
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    part = part.withColumn("by_id", F.max("is_id").over(near)).withColumn("by_secret", F.max("is_secret").over(near))
    linked = F.when(F.col("kind").isin(0, 5), F.col("by_id")).when(F.col("kind") == 3, F.col("by_secret")).otherwise(F.col("by_id") & F.col("by_secret"))
    kept = part.select("row", "doc_id", F.when(F.col("strong") | F.col("weak") & linked, F.struct("start", "kind", "end", "strong")).alias("s"))
    return kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def digest(spans: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["strong"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """docs with every reported span of text replaced, and those of identifiers and endpoints in either case; overlapping spans become one mark. Null texts stay null.

    Rows are numbered once, in a written table that both the search and the join read: however the input is planned again,
    a number means one row. Documents without a finding need no more than the join's probe."""
    rows = stash(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")))
    given = rows.select(F.col("_row").alias("row"), F.lit(0).alias("doc_id"), F.col("_doc.text").alias("text"))
    spans = _spans(given, scope, any_case=True).where(F.size("spans") > 0).select(F.col("row").alias("_row"), F.col("spans").alias("_spans"))
    state = "cast(struct('' as out, 0 as pos) as struct<out:string,pos:bigint>)"
    step = f"""(a, x) -> if(x.end <= a.pos, a, struct(
        concat(a.out, if(x.start >= a.pos, concat(substring(_doc.text, int(a.pos) + 1, int(x.start - a.pos)), '{mark}'), '')) as out, x.end as pos))"""
    cleaned = F.expr(f"aggregate(_spans, {state}, {step}, a -> concat(a.out, substring(_doc.text, int(a.pos) + 1)))")
    joined = rows.join(spans, "_row", "left")
    text = F.when(F.col("_spans").isNotNull(), cleaned).otherwise(F.col("_doc.text"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns))
