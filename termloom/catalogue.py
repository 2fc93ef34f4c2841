"""Registered queries of the search stack, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import codes, text, urls
from termloom.operators import crawl, postings, reorder, search, snippets
from termloom.plans.engine import SearchEngine
from termloom.plans.materialize import shared_folder
from termloom.plans.queryparse import parse
from termloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THREE = ("with", "this", "by")
OFTEN = 100


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.postings(docs(spark, sf_dir))


def all_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, for queries that read them all."""
    return postings.whole_postings(docs(spark, sf_dir))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.document_lengths(docs(spark, sf_dir))


# -- pieces of SQL ------------------------------------------------------------------------------------------------------

BLANK = r"[ \t\n\x0b\f\r]+"
TOKENS = "tokens as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) as term from documents)"
POSTS = f"{TOKENS}, posts as (select term, doc_id, count(*) as freq from tokens group by term, doc_id)"
LENGTHS = f"lengths as (select doc_id, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')) as bigint) as doc_len from documents)"
LEXICON = "lexicon as (select term, count(*) as df from posts group by term)"


def scored_sql(terms: tuple[str, ...]) -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""with {POSTS}, {LENGTHS}, {LEXICON},
wanted as (select * from (values {wanted}) as v(term)),
corpus as (select count(*)::double as n, avg(doc_len) as a from lengths),
scored as (select p.doc_id, p.term, p.freq, l.df, ln((n - df + 0.5::double) / (df + 0.5::double)) * 2.2::double * freq / (1.2::double * (0.25::double + 0.75::double * doc_len / a) + freq) as score
  from posts p join wanted using (term) join lexicon l using (term) join lengths using (doc_id), corpus)"""


def and_sql(terms: tuple[str, ...]) -> str:
    return f"""{scored_sql(terms)} select doc_id, round(sum(score), 6) as score from scored group by doc_id
having count(distinct term) = {len(set(terms))} order by score desc, doc_id limit 10"""


def or_sql(terms: tuple[str, ...], keep: str) -> str:
    return f"""{scored_sql(terms)}, summed as (select doc_id, round(sum(score), 6) as score from scored group by doc_id)
select * from summed where score {keep} order by score desc, doc_id limit 10"""


# -- tokens, documents, lexicon -------------------------------------------------------------------------------------------


@query("select t as term, doc_id, count(*) as freq from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as t from documents) group by all")
def tok_letters(spark, sf_dir):
    return postings.whole_postings(docs(spark, sf_dir), "letters")


@query("""select t as term, doc_id, count(*) as freq from (select doc_id, regexp_extract(w, '^[A-Za-z0-9]+') as t
from (select doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) as w from documents)) where t <> '' group by all""")
def tok_prefix(spark, sf_dir):
    return postings.whole_postings(docs(spark, sf_dir), "prefix")


@query("""select lower(t) as term, doc_id, count(*) as freq from (select doc_id, regexp_extract(w, '^[A-Za-z0-9]+') as t
from (select doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) as w from documents)) where t <> '' group by all""")
def tok_prefix_lower(spark, sf_dir):
    return postings.whole_postings(docs(spark, sf_dir), "prefix_lower")


@query(f"with {POSTS} select term, doc_id, freq from posts")
def tok_alnum(spark, sf_dir):
    return posts(spark, sf_dir)


HTML = "html_tokens as (select page_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[A-Za-z0-9]+'))) as term from pages where regexp_matches(html, '(?i)<html[^>]*>'))"


@query(f"with {HTML} select term, page_id as doc_id, count(*) as freq from html_tokens group by all")
def tok_html(spark, sf_dir):
    return postings.postings(table(spark, sf_dir, "pages"), "html", "page_id", "html")


@query("select unnest(list_transform(regexp_split_to_array(name, ' '), lambda w: translate(lower(w), ',.!?\"', ''))) as word, key from (select p_partkey as key, p_name as name from part)")
def query_words(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w"), F.col("p_partkey").alias("key"))
    return named.select(text.normalise_query_word(F.col("w")).alias("word"), "key")


@query(f"with {LENGTHS} select * from lengths")
def doc_len(spark, sf_dir):
    return lengths(spark, sf_dir)


@query(f"with {LENGTHS} select count(*) as n_docs, cast(sum(doc_len) as bigint) as total_len, cast(sum(doc_len) // count(*) as bigint) as avg_len from lengths")
def corpus_stats(spark, sf_dir):
    return postings.corpus_stats(lengths(spark, sf_dir))


@query(f"with {TOKENS} select d.doc_id, count(term) as word_count, count(distinct term) as distinct_words from documents d left join tokens t on d.doc_id = t.doc_id group by d.doc_id")
def doc_info(spark, sf_dir):
    return postings.document_info(docs(spark, sf_dir))


@query("select row_number() over (order by url, page_id) - 1 as doc_id, url from pages")
def doc_map(spark, sf_dir):
    return reorder.permutation(table(spark, sf_dir, "pages").select("page_id", "url"), ["url"], "page_id").join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("old_id"), "url"), "old_id").select(F.col("new_id").alias("doc_id"), "url")


@query(f"with {POSTS}, {LEXICON} select * from lexicon")
def lexicon_df(spark, sf_dir):
    return postings.lexicon(posts(spark, sf_dir))


@query(f"with {POSTS} select term, count(*) as df, list(doc_id order by doc_id) as doc_ids, list(freq order by doc_id) as freqs from posts group by term")
def posting_lists(spark, sf_dir):
    return postings.posting_lists(posts(spark, sf_dir))


# -- search -----------------------------------------------------------------------------------------------------------------


def _and(terms: tuple[str, ...]):
    return lambda spark, sf_dir: search.conjunctive(posts(spark, sf_dir), lengths(spark, sf_dir), terms)


for _name, _terms in {"bm25_and": THREE, "bm25_and_single": ("haing",), "bm25_and_missing": ("with", "zzzzqq"), "bm25_and_repeat": ("with", "with", "by"), "bm25_and_negative": ("en", "the", "in")}.items():
    QUERIES[_name], SQL[_name] = _and(_terms), and_sql(_terms)


@query(or_sql(THREE, "<> 0"))
def bm25_or_flat(spark, sf_dir):
    return search.run(posts(spark, sf_dir), lengths(spark, sf_dir), parse("with this OR by"))


@query(or_sql(("the", "haing", "les"), "> 0"))
def bm25_or_positive(spark, sf_dir):
    return search.disjunctive(posts(spark, sf_dir), lengths(spark, sf_dir), ("the", "haing", "les"), positive=True)


@query(f"""{scored_sql(("with", "this", "by", "haing"))},
g as (select * from (values (0, 'with'), (0, 'this'), (1, 'by'), (1, 'haing')) as v(group_no, term)),
hits as (select group_no, doc_id, round(sum(score), 6) as score from scored join g using (term) group by group_no, doc_id having count(*) = 2),
best as (select *, row_number() over (partition by group_no order by score desc, doc_id) as rn from hits)
select group_no, doc_id, score from best where rn <= 10 order by score desc, doc_id, group_no limit 10""")
def bm25_or_dnf(spark, sf_dir):
    return search.alternatives(posts(spark, sf_dir), lengths(spark, sf_dir), parse("with this OR by haing").groups)


@query(f"""{scored_sql(THREE)}, best as (select doc_id, round(sum(score), 6) as score from scored group by doc_id having count(*) = 3 order by score desc, doc_id limit 10)
select b.doc_id, b.score, s.term, s.freq, s.df from best b join scored s on b.doc_id = s.doc_id""")
def hit_details(spark, sf_dir):
    p, n = posts(spark, sf_dir), lengths(spark, sf_dir)
    told = search.details(p, n, search.conjunctive(p, n, THREE), THREE)
    return told.select("doc_id", "score", F.explode("terms").alias("t")).select("doc_id", "score", "t.term", "t.freq", "t.df")


@query(f"""{scored_sql(THREE)}, best as (select doc_id, round(sum(score), 6) as score from scored group by doc_id having count(*) = 3 order by score desc, doc_id limit 10),
told as (select doc_id, string_agg(format('{{}} freq:{{}} total_posting:{{}}', term, freq, df), ', ' order by case term when 'with' then 0 when 'this' then 1 else 2 end) as t from scored group by doc_id)
select b.doc_id, printf('docID:%d score:%.4f docLength:%d %s', b.doc_id, b.score, doc_len, t) as line from best b join told using (doc_id) join lengths using (doc_id)""")
def result_report(spark, sf_dir):
    p, n = posts(spark, sf_dir), lengths(spark, sf_dir)
    told = search.details(p, n, search.conjunctive(p, n, THREE), THREE).join(n, "doc_id").withColumn("snippet", F.lit(""))
    return writers.report(told).select("doc_id", F.regexp_replace("line", r" \| $", "").alias("line"))


@query(f"""with {POSTS}, {LENGTHS}, wanted as (select distinct item_id as query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) as term from benchmark),
need as (select query_id, count(*) as need from wanted group by query_id),
found as (select p.* from posts p where term in (select term from wanted)), lexicon as (select term, count(*) as df from found group by term),
corpus as (select count(*)::double as n, avg(doc_len) as a from lengths),
scored as (select w.query_id, p.doc_id, ln((n - df + 0.5::double) / (df + 0.5::double)) * 2.2::double * freq / (1.2::double * (0.25::double + 0.75::double * doc_len / a) + freq) as score
  from found p join wanted w using (term) join lexicon using (term) join lengths using (doc_id), corpus),
hits as (select query_id, doc_id, round(sum(score), 6) as score from scored join need using (query_id) group by query_id, doc_id, need having count(*) = need),
best as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits)
select query_id, doc_id, score, rank from best where rank <= 10""")
def bm25_batch(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.alnum(F.col("text"))).alias("term"))
    return search.rank_batch(posts(spark, sf_dir), lengths(spark, sf_dir), wanted)


@query(f"""with {POSTS}, {LENGTHS}, wanted as (select distinct item_id as query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) as term from benchmark),
found as (select p.* from posts p where term in (select term from wanted)), lexicon as (select term, count(*) as df from found group by term),
corpus as (select count(*)::double as n, avg(doc_len) as a from lengths),
scored as (select w.query_id, p.doc_id, ln((n - df + 0.5::double) / (df + 0.5::double)) * 2.2::double * freq / (1.2::double * (0.25::double + 0.75::double * doc_len / a) + freq) as score
  from found p join wanted w using (term) join lexicon using (term) join lengths using (doc_id), corpus),
hits as (select query_id, doc_id, round(sum(score), 6) as score from scored group by query_id, doc_id having round(sum(score), 6) <> 0),
best as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits)
select query_id, doc_id, score, rank from best where rank <= 10""")
def bm25_batch_whole(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.alnum(F.col("text"))).alias("term"))
    return search.rank_batch(posts(spark, sf_dir), lengths(spark, sf_dir), wanted, disjunctive=True)


@query(f"with {POSTS} select term, min(doc_id) as doc_id from posts where term = 'haing' and doc_id >= 300 group by term")
def next_geq(spark, sf_dir):
    return postings.next_at_least(posts(spark, sf_dir), "haing", 300)


@query(f"with {POSTS} select term, doc_id, freq from posts where term >= 'haing' and exists (select 1 from posts where term = 'haing') order by term, doc_id limit 201")
def term_seek(spark, sf_dir):
    return postings.from_term(posts(spark, sf_dir), "haing")


@query(f"with {POSTS} select term, doc_id, freq from posts order by term, doc_id limit 1000")
def posting_head(spark, sf_dir):
    return all_posts(spark, sf_dir).orderBy("term", "doc_id").limit(1000)


@query(f"with {POSTS} select doc_id from posts where term in ('with', 'this', 'by') group by doc_id having count(*) = 3")
def intersect_docs(spark, sf_dir):
    return search.documents_with_all(posts(spark, sf_dir), THREE)


@query(f"with {POSTS} select distinct doc_id from posts where term in ('haing', 'les')")
def union_docs(spark, sf_dir):
    return search.documents_with_any(posts(spark, sf_dir), ("haing", "les"))


# -- snippets ---------------------------------------------------------------------------------------------------------------

WORDS = f"words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') as w from documents)"
PLACES = f"{WORDS}, numbered as (select doc_id, i - 1 as pos, w[i] as word from words, unnest(range(1, len(w) + 1)) as t(i)), places as (select doc_id, pos, lower(unnest(regexp_extract_all(word, '[A-Za-z0-9]+'))) as term from numbered)"
SPANS = f"""{PLACES}, hits as (select * from places where term in ('with', 'this', 'by')),
seen as (select doc_id, pos, max(case when term = 'with' then pos end) over w as a, max(case when term = 'this' then pos end) over w as b, max(case when term = 'by' then pos end) over w as c
  from hits window w as (partition by doc_id order by pos)),
spans as (select doc_id, least(a, b, c) as lp, pos + 1 as rp from seen where a is not null and b is not null and c is not null),
best as (select *, row_number() over (partition by doc_id order by rp - lp, rp) as rn from spans),
spanned as (select distinct doc_id, lp, rp from best where rn = 1)"""


@query(f"with {SPANS} select doc_id, lp, rp from spanned")
def snippet_window(spark, sf_dir):
    return snippets.windows(docs(spark, sf_dir), THREE)


@query(f"with {PLACES} select doc_id, min(pos) as pos from places where term = 'haing' group by doc_id")
def snippet_first(spark, sf_dir):
    return snippets.occurrence(docs(spark, sf_dir), "haing")


@query(f"with {PLACES} select doc_id, max(pos) as pos from places where term = 'haing' group by doc_id")
def snippet_last(spark, sf_dir):
    return snippets.occurrence(docs(spark, sf_dir), "haing", last=True)


@query(f"""with {SPANS}, ends as (select w.doc_id, w, lp, rp, greatest(lp - 10, 0) as s, least(rp + 10, len(w)) as e from words w left join spanned using (doc_id))
select doc_id, lp, rp, case when lp is null then 'snippet unavailable' when rp - lp <= 50 then array_to_string(w[s + 1 : e], ' ') || ' '
  else array_to_string(w[s + 1 : least(lp + 10, len(w))], ' ') || ' ...... ' || array_to_string(w[rp - 9 : e], ' ') || ' ' end as snippet from ends""")
def snippet_text(spark, sf_dir):
    return snippets.snippets(docs(spark, sf_dir), THREE)


# -- blocks and codes ---------------------------------------------------------------------------------------------------------

VB = lambda x: f"greatest(1, cast(ceil(length(ltrim(bin({x}), '0')) / 7.0) as bigint))"
BITS = lambda x: f"length(ltrim(bin({x}), '0'))"
NUMBERED = f"{POSTS}, numbered as (select *, row_number() over (partition by term order by doc_id) as rn, (row_number() over (partition by term order by doc_id) - 1) // 64 as block_no from posts)"
GAPPED = f"{NUMBERED}, gapped as (select *, doc_id - coalesce(lag(doc_id) over (partition by term, block_no order by rn), -1) as gap from numbered)"


@query(f"""with {GAPPED} select term, block_no, count(*) as n, max(doc_id) as last_doc_id, cast(sum({VB("doc_id")}) as bigint) as docid_bytes, cast(sum({VB("freq")}) as bigint) as freq_bytes,
cast(sum(2 * {BITS("gap")} - 1) as bigint) as gap_bits, cast(sum(2 * {BITS("freq")} - 1) as bigint) as freq_bits from gapped group by term, block_no""")
def posting_blocks(spark, sf_dir):
    return postings.blocks(all_posts(spark, sf_dir))


@query(f"with {NUMBERED} select term, block_no, list(doc_id order by doc_id) as doc_ids, list(freq order by doc_id) as freqs from numbered group by term, block_no")
def block_lists(spark, sf_dir):
    return postings.block_lists(all_posts(spark, sf_dir))


@query(f"""with {NUMBERED}, coded as (select *, {VB("doc_id")} as k from numbered)
select term, block_no, string_agg(array_to_string(list_transform(range(k), lambda i: printf('%02X', ((doc_id >> (7 * i)) & 127) + case when i = k - 1 then 128 else 0 end)), ''), '' order by doc_id) as payload
from coded group by term, block_no""")
def blocks_absolute(spark, sf_dir):
    return postings.block_lists(all_posts(spark, sf_dir)).select("term", "block_no", F.hex(codes.varbyte_list(F.col("doc_ids"))).alias("payload"))


VH = lambda x: f"array_to_string(list_transform(range({VB(x)}), lambda i: printf('%02X', (({x} >> (7 * i)) & 127) + case when i = {VB(x)} - 1 then 128 else 0 end)), '')"
GAMMA = lambda x: f"repeat('0', {BITS(x)} - 1) || ltrim(bin({x}), '0')"
PACKED = "array_to_string(list_transform(range((len(fb) + 7) // 8), lambda i: printf('%02X', cast(list_sum(list_transform(range(8), lambda k: case when substr(fb, 8 * i + k + 1, 1) = '1' then 1 << k else 0 end)) as bigint))), '')"
FIRST = f"case when block_no = 0 then {VH('df')} else '' end"


@query(f"""with {NUMBERED}, {LEXICON}, lists as (select term, block_no, max(doc_id) as last, string_agg({VH("doc_id")}, '' order by doc_id) as d, string_agg({VH("freq")}, '' order by doc_id) as f from numbered group by term, block_no)
select term, block_no, concat({FIRST}, {VH("last")}, {VH("(len(d) // 2)")}, {VH("(len(f) // 2)")}, d, f) as payload from lists join lexicon using (term)""")
def index_varbyte(spark, sf_dir):
    return postings.varbyte_blocks(all_posts(spark, sf_dir)).withColumn("payload", F.hex("payload"))


@query(f"""with {NUMBERED}, {LEXICON}, gapped as (select *, doc_id - coalesce(lag(doc_id) over (partition by term, block_no order by rn), 0) as gap from numbered),
bits as (select term, block_no, max(doc_id) as last, string_agg({VH("gap")}, '' order by doc_id) as d, string_agg({GAMMA("freq")}, '' order by doc_id) as fb from gapped group by term, block_no),
lists as (select *, {PACKED} as f from bits)
select term, block_no, concat({FIRST}, {VH("last")}, {VH("((len(d) + len(f)) * 4)")}, d, f) as payload from lists join lexicon using (term)""")
def index_gamma(spark, sf_dir):
    return postings.gamma_blocks(all_posts(spark, sf_dir)).select("term", "block_no", F.hex("payload").alias("payload"))


READ_BACK = f"with {NUMBERED}, {LEXICON} select term, block_no, any_value(case when block_no = 0 then df end) as df, max(doc_id) as last_doc_id, list(doc_id order by doc_id) as doc_ids, list(freq order by doc_id) as freqs from numbered join lexicon using (term) group by term, block_no"


@query(READ_BACK)
def index_varbyte_read(spark, sf_dir):
    return postings.read_varbyte_blocks(postings.varbyte_blocks(all_posts(spark, sf_dir)))


@query(READ_BACK)
def index_gamma_read(spark, sf_dir):
    return postings.read_gamma_blocks(postings.gamma_blocks(all_posts(spark, sf_dir)))


@query(f"""with {POSTS}, coded as (select *, {VH("doc_id")} as h from posts)
select term, doc_id, array_to_string(list_transform(range(len(h) // 2), lambda i: reverse(lpad(ltrim(bin(cast('0x' || substr(h, 2 * i + 1, 2) as integer)), '0'), 8, '0'))), '') as bits from coded""")
def varbyte_bits(spark, sf_dir):
    return all_posts(spark, sf_dir).select("term", "doc_id", codes.varbyte_bits(F.col("doc_id")).alias("bits"))


@query(f"with {POSTS} select term, doc_id, doc_id - coalesce(lag(doc_id) over w, 0) as gap, row_number() over w as pos from posts window w as (partition by term order by doc_id)")
def dgaps(spark, sf_dir):
    return postings.gaps(all_posts(spark, sf_dir))


@query(f"with {POSTS} select term, row_number() over (partition by term order by doc_id) as pos, doc_id from posts")
def gap_decode(spark, sf_dir):
    return postings.gap_decode(postings.gaps(all_posts(spark, sf_dir)).select("term", "pos", "gap"))


@query(f"with {GAPPED} select term, doc_id, repeat('0', {BITS('gap')} - 1) || ltrim(bin(gap), '0') as gap_code, repeat('0', {BITS('freq')} - 1) || ltrim(bin(freq), '0') as freq_code, repeat('0', freq - 1) || '1' as unary_freq from gapped")
def gamma_codes(spark, sf_dir):
    gapped = postings.within_blocks(all_posts(spark, sf_dir))
    return gapped.select("term", "doc_id", codes.gamma(F.col("gap")).alias("gap_code"), codes.gamma(F.col("freq")).alias("freq_code"), codes.unary(F.col("freq")).alias("unary_freq"))


@query(f"""with {POSTS}, coded as (select *, {VB("doc_id")} as k from posts)
select term, doc_id, array_to_string(list_transform(range(k), lambda i: printf('%02X', ((doc_id >> (7 * i)) & 127) + case when i = k - 1 then 128 else 0 end)), '') as stop_code,
array_to_string(list_transform(range(k), lambda i: printf('%02X', ((doc_id >> (7 * i)) & 127) + case when i < k - 1 then 128 else 0 end)), '') as more_code, doc_id as decoded from coded""")
def varbyte_codes(spark, sf_dir):
    coded = all_posts(spark, sf_dir).select("term", "doc_id", codes.varbyte_hex(F.col("doc_id")).alias("stop_code"), codes.varbyte_hex(F.col("doc_id"), False).alias("more_code"))
    return coded.withColumn("decoded", codes.varbyte_decode(F.col("stop_code"))[0])


IPC = f"""with recursive {NUMBERED}, blocks as (select term, block_no, list(doc_id order by doc_id) as a from numbered group by term, block_no),
steps as (select term, block_no, a, cast(0 as bigint) as pos, cast(len(a) as bigint) as n, a[1] as lo, a[-1] as hi from blocks
  union all select term, block_no, a, case when k = 0 then pos else pos + n // 2 + 1 end, case when k = 0 then n // 2 else n - n // 2 - 1 end,
    case when k = 0 then lo else a[pos + n // 2 + 1] + 1 end, case when k = 0 then a[pos + n // 2 + 1] - 1 else hi end
  from steps, (values (0), (1)) as v(k) where n > 0)
select term, block_no, cast(sum(case when n > 0 and hi - lo - n + 1 > 0 then {BITS("hi - lo - n + 1")} else 0 end) as bigint) as bits"""


@query(f"{IPC} from steps group by term, block_no")
def ipc_bits(spark, sf_dir):
    return postings.block_lists(all_posts(spark, sf_dir)).select("term", "block_no", codes.interpolative_length(F.col("doc_ids")).alias("bits"))


@query(f"{IPC}, true as same from steps group by term, block_no")
def ipc_roundtrip(spark, sf_dir):
    lists = postings.block_lists(all_posts(spark, sf_dir)).select("term", "block_no", "doc_ids", codes.interpolative_length(F.col("doc_ids")).alias("bits"), codes.interpolative_encode(F.col("doc_ids")).alias("payload"))
    back = codes.interpolative_decode(F.col("payload"), F.size("doc_ids"), F.col("doc_ids")[0], F.element_at("doc_ids", -1))
    return lists.select("term", "block_no", "bits", ((back == F.col("doc_ids")) & (F.octet_length("payload") == F.ceil(F.col("bits") / 8))).alias("same"))


# -- files: written to the shared folder and read back -----------------------------------------------------------------------------


def through(spark: SparkSession, write: Callable, read: Callable) -> DataFrame:
    path = shared_folder(spark)
    write(path)
    return read(spark, path)


@query(r"select 'http://doc.example/' || doc_id as url, regexp_replace(coalesce(text, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') as text from documents")
def file_trec(spark, sf_dir):
    given = docs(spark, sf_dir).select(F.concat(F.lit("http://doc.example/"), "doc_id").alias("url"), "text")
    return through(spark, lambda at: writers.trec(given, at), lambda s, at: readers.trec(s, at, ordered=False))


@query("select url, regexp_extract(html, '(?is)<html[^>]*>.*') || chr(10) as html from pages")
def file_gov2(spark, sf_dir):
    return through(spark, lambda at: writers.gov2(table(spark, sf_dir, "pages"), at), readers.gov2)


@query(f"with {POSTS} select term, doc_id, freq from posts")
def file_postings(spark, sf_dir):
    return through(spark, lambda at: writers.postings(all_posts(spark, sf_dir), at), readers.postings)


@query(f"with {POSTS}, {LEXICON} select * from lexicon")
def file_lexicon(spark, sf_dir):
    return through(spark, lambda at: writers.lexicon(postings.lexicon(all_posts(spark, sf_dir)), at), readers.lexicon)


@query(f"with {LENGTHS} select * from lengths")
def file_document_lengths(spark, sf_dir):
    return through(spark, lambda at: writers.document_lengths(lengths(spark, sf_dir), at), readers.document_lengths)


@query("select page_id as doc_id, url from pages")
def file_document_map(spark, sf_dir):
    return through(spark, lambda at: writers.document_map(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), at), readers.document_map)


@query(f"with {HTML} select p.page_id as doc_id, any_value(url) as url, count(term) as word_count, count(distinct term) as distinct_words from pages p left join html_tokens t on p.page_id = t.page_id group by p.page_id")
def file_document_info(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    info = postings.document_info(pages, "html", "page_id", "html").join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    return through(spark, lambda at: writers.document_info(info, at), readers.document_info)


@query(f"with {POSTS}, {LEXICON} select term, doc_id from posts join lexicon using (term) where df > {OFTEN}")
def file_term_edges(spark, sf_dir):
    return through(spark, lambda at: writers.term_edges(postings.term_edges(all_posts(spark, sf_dir), OFTEN), at), readers.term_edges)


@query("select doc_id as old_id, row_number() over (order by source, doc_id) - 1 as new_id from documents")
def file_permutation(spark, sf_dir):
    return through(spark, lambda at: writers.permutation(by_source(spark, sf_dir), at), readers.permutation)


def engine(spark, sf_dir):
    return SearchEngine.from_documents(docs(spark, sf_dir)).save(shared_folder(spark))


@query(f"with {POSTS} select term, doc_id, freq from posts where term = 'haing'")
def index_seek(spark, sf_dir):
    return engine(spark, sf_dir).posts.where("term = 'haing'")


@query(f"""{scored_sql(THREE)}, {SPANS}, top as (select doc_id, round(sum(score), 6) as score from scored group by doc_id having count(*) = 3 order by score desc, doc_id limit 10),
ends as (select w.doc_id, w, lp, rp, greatest(lp - 10, 0) as s, least(rp + 10, len(w)) as e from words w join spanned using (doc_id))
select t.doc_id, t.score, doc_len, lp, rp, case when rp - lp <= 50 then array_to_string(w[s + 1 : e], ' ') || ' '
  else array_to_string(w[s + 1 : least(lp + 10, len(w))], ' ') || ' ...... ' || array_to_string(w[rp - 9 : e], ' ') || ' ' end as snippet
from top t join lengths using (doc_id) join ends using (doc_id)""")
def index_show(spark, sf_dir):
    return engine(spark, sf_dir).show("with this by").drop("terms")


# -- new numbers ----------------------------------------------------------------------------------------------------------------

PERM = "perm as (select doc_id as old_id, row_number() over (order by source, doc_id) - 1 as new_id from documents)"


def by_source(spark, sf_dir):
    """Documents have no address: source and doc_id stand for it."""
    return reorder.permutation(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"])


@query(f"with {HTML}, hp as (select term, page_id, count(*) as freq from html_tokens group by all), perm as (select page_id, row_number() over (order by url, page_id) - 1 as new_id from pages) select term, new_id as doc_id, freq from hp join perm using (page_id)")
def reassign_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return reorder.reassign(postings.postings(pages, "html", "page_id", "html"), reorder.permutation(pages.select("page_id", "url"), ["url"], "page_id"))


@query(f"""with {POSTS}, info as (select d.doc_id, count(distinct term) as k from documents d left join posts p on d.doc_id = p.doc_id group by d.doc_id)
select doc_id as old_id, row_number() over (order by k, doc_id) - 1 as new_id from info""")
def reassign_distinct(spark, sf_dir):
    return reorder.permutation(postings.document_info(docs(spark, sf_dir)), ["distinct_words"])


@query(f"with {POSTS}, {PERM} select term, new_id as doc_id, freq from posts join perm on doc_id = old_id")
def reassign_perm(spark, sf_dir):
    return reorder.reassign(all_posts(spark, sf_dir), by_source(spark, sf_dir))


@query(f"with {POSTS} select doc_id, count(*) as postings from posts where doc_id not in (select doc_id from labels) group by doc_id")
def reassign_unmatched(spark, sf_dir):
    return reorder.unmatched(all_posts(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("old_id")))


@query(f"""with {POSTS}, {PERM}, moved as (select term, new_id as doc_id from posts join perm on doc_id = old_id),
numbered as (select *, (row_number() over (partition by term order by doc_id) - 1) // 64 as block_no from moved),
gapped as (select doc_id - coalesce(lag(doc_id) over (partition by term, block_no order by doc_id), -1) as gap from numbered)
select count(*) as n_postings, cast(sum(2 * {BITS("gap")} - 1) as bigint) as bits from gapped""")
def reorder_gap_bits(spark, sf_dir):
    return reorder.gap_bits(reorder.reassign(all_posts(spark, sf_dir), by_source(spark, sf_dir)))


@query(f"""with {POSTS}, {LEXICON} select term, df, row_number() over w as pos, doc_id - coalesce(lag(doc_id) over w, 0) as gap from posts join lexicon using (term) where df > {OFTEN} window w as (partition by term order by doc_id)""")
def term_edges(spark, sf_dir):
    return postings.term_edges(all_posts(spark, sf_dir), OFTEN)


@query(f"with {POSTS}, {LEXICON} select count(*) as terms, cast(sum(df) as bigint) as edges from lexicon where df > {OFTEN}")
def frequent_totals(spark, sf_dir):
    return postings.lexicon(all_posts(spark, sf_dir)).where(F.col("df") > OFTEN).agg(F.count("*").alias("terms"), F.sum("df").cast("long").alias("edges"))


GRAPH = f"""with {POSTS}, {LEXICON}, {PERM}, edges as (select term, doc_id from posts join lexicon using (term) where df > {OFTEN}),
sides as (select old_id as doc_id, case when new_id < (select count(*) // 2 from perm) then 0 else 1 end as side from perm where new_id < 2 * (select count(*) // 2 from perm)),
deg as (select term, cast(sum(1 - side) as bigint) as deg_a, cast(sum(side) as bigint) as deg_b from edges join sides using (doc_id) group by term),
sizes as (select sum(1 - side)::double as na, sum(side)::double as nb from sides),
pairs as (select doc_id, side, case side when 0 then deg_a else deg_b end::double as o, case side when 0 then deg_b else deg_a end::double as r, case side when 0 then na else nb end as no, case side when 0 then nb else na end as nr
  from edges join sides using (doc_id) join deg using (term), sizes),
summed as (select doc_id, sum(o * log2(no / (o + 1)) + r * log2(nr / (r + 1)) - ((o - 1) * log2(no / o) + (r + 1) * log2(nr / (r + 2)))) as g from pairs group by doc_id),
gained as (select doc_id, side, round(coalesce(g, 0), 6) + 0.0::double as gain from sides left join summed using (doc_id))"""


def graph(spark, sf_dir):
    return postings.frequent_edges(all_posts(spark, sf_dir), OFTEN), reorder.halves(by_source(spark, sf_dir))


@query(f"{GRAPH} select * from deg")
def bp_degrees(spark, sf_dir):
    return reorder.degrees(*graph(spark, sf_dir))


@query(f"{GRAPH} select * from gained")
def bp_gain(spark, sf_dir):
    return reorder.gains(*graph(spark, sf_dir))


SWAPS = f"""{GRAPH}, a as (select row_number() over (order by gain desc, doc_id) as rn, doc_id as a_doc, gain from gained where side = 0),
b as (select row_number() over (order by gain desc, doc_id) as rn, doc_id as b_doc, gain from gained where side = 1),
swaps as (select rn, a_doc, b_doc, round(a.gain + b.gain, 6) as total from a join b using (rn) where round(a.gain + b.gain, 6) > 0)"""


@query(f"{SWAPS} select * from swaps")
def bp_swap(spark, sf_dir):
    return reorder.swaps(reorder.gains(*graph(spark, sf_dir)))


@query(f"""{SWAPS}, partner as (select a_doc as old_id, b_doc as other from swaps union all select b_doc, a_doc from swaps)
select p.old_id, coalesce(q.new_id, p.new_id) as new_id from perm p left join partner using (old_id) left join perm q on q.old_id = other""")
def bp_permutation(spark, sf_dir):
    return reorder.bisect_once(postings.frequent_edges(all_posts(spark, sf_dir), OFTEN), by_source(spark, sf_dir))


# -- links and frontier -----------------------------------------------------------------------------------------------------------

UNWANTED = ", ".join(f"'{x}'" for x in urls.UNWANTED)
PATH = lambda x: f"regexp_extract(regexp_replace({x}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?', ''), '^[^?#]*')"
HOST = lambda x: f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
RAW = r"""raw as (select page_id, url, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) as href from pages)"""
ALLOWED = f"allowed as (select * from raw where href <> '' and not (instr({PATH('href')}, '.') > 0 and lower(list_last(string_split({PATH('href')}, '.'))) in ({UNWANTED})) and regexp_matches(href, '^(/|#|http)'))"
LINKS = f"""{RAW}, {ALLOWED}, links as (select distinct page_id, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when {PATH("href")} = '' then url
  else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || {PATH("href")} end as link from allowed)"""
FRONTIER = f"""{LINKS}, start as (select page_id, url from pages order by page_id limit 10),
hosts as (select {HOST("url")} as netloc, count(*) as n from (select distinct url from start) group by 1),
found as (select link as url, {HOST("link")} as netloc, min(l.page_id) as first_page, count(distinct l.page_id) - 1 as importance from links l join start s on l.page_id = s.page_id group by link),
fresh as (select *, row_number() over (partition by netloc order by first_page, url) as rn from found where url not in (select url from start)),
frontier as (select url, f.netloc, first_page, importance from fresh f left join hosts h on f.netloc = h.netloc where rn + coalesce(n, 0) <= 10)"""


@query(f"with {RAW} select * from raw")
def links(spark, sf_dir):
    return crawl.raw_links(table(spark, sf_dir, "pages")).select("page_id", "url", "href")


@query(f"with {RAW}, {ALLOWED} select * from allowed")
def links_allowed(spark, sf_dir):
    return links(spark, sf_dir).where(urls.wanted(F.col("href")))


@query(f"with {LINKS} select page_id, link, {HOST('link')} as netloc from links")
def links_resolved(spark, sf_dir):
    return crawl.links(table(spark, sf_dir, "pages"))


ROBOTS = f"robots as (select distinct {HOST('url')} as site, '/a' as prefix from pages where url like 'https:%')"


@query(f"with {LINKS}, {ROBOTS} select page_id, link, {HOST('link')} as netloc from links where not exists (select 1 from robots where site = {HOST('link')} and starts_with({PATH('link')}, prefix))")
def links_robots(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = pages.where(F.col("url").startswith("https:")).select(urls.netloc(F.col("url")).alias("netloc"), F.lit("/a").alias("prefix")).distinct()
    return crawl.links(pages, rules)


BASED = LINKS.replace("from pages)", "from based)")


@query(f"""with based as (select page_id, 'https://base.example/d/p' as url, html from pages where page_id % 3 <> 0), {BASED} select page_id, link, {HOST("link")} as netloc from links""")
def links_base(spark, sf_dir):
    """A third of the pages has a <base> that is no address, the rest one that is."""
    base = F.when(F.col("page_id") % 3 == 0, "nonsense").otherwise("https://base.example/d/p")
    return crawl.links(table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<base href="'), base, F.lit('">'), "html")))


@query(f"select {HOST('url')} as netloc, count(*) as n from pages group by 1")
def netloc_counts(spark, sf_dir):
    return crawl.site_counts(table(spark, sf_dir, "pages"))


@query(f"select page_id, url, netloc from (select page_id, url, {HOST('url')} as netloc, row_number() over (partition by {HOST('url')} order by page_id) as rn from pages) where rn <= 10")
def netloc_cap(spark, sf_dir):
    return crawl.cap_sites(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"])


@query(f"with {FRONTIER} select url, netloc, first_page from frontier")
def frontier_bfs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl.frontier(pages, crawl.seeds(pages))


@query(f"with {LINKS} select link as url, count(distinct page_id) - 1 as importance from links group by link")
def link_importance(spark, sf_dir):
    return crawl.link_importance(crawl.links(table(spark, sf_dir, "pages")))


RATED = f"""{FRONTIER}, made as (select netloc, count(*) as novelty from (select netloc from frontier union all select {HOST("url")} from (select distinct url from start)) group by netloc),
rated as (select url, netloc, importance, novelty, round(5.0::double / novelty + importance, 6) as score from frontier join made using (netloc))"""


@query(f"with {RATED} select * from rated")
def frontier_priority(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl.prioritised(pages, crawl.seeds(pages))


@query(f"with {RATED} select * from rated order by score desc, url limit 10")
def frontier_batch(spark, sf_dir):
    return crawl.next_batch(frontier_priority(spark, sf_dir))


@query("select page_id, printf('%d %s Size: %.2fkb Return code:200', page_id, url, strlen(html) / 1024.0) as line from pages")
def crawl_log(spark, sf_dir):
    return crawl.crawl_log(table(spark, sf_dir, "pages"))


@query("select count(*) as files, round(sum(strlen(html)) / (1024.0::double * 1024.0::double), 2) as megabytes from pages")
def crawl_size(spark, sf_dir):
    return crawl.crawl_size(table(spark, sf_dir, "pages"))


@query("""select page_id, case page_id % 5 when 0 then printf('%d %s connection time out', page_id, url) when 1 then printf('%d %s ErrorCode:%d', page_id, url, 400 + page_id % 7)
when 2 then printf('%d %s URLError', page_id, url) when 3 then printf('%d %s Other weird Error', page_id, url) else printf('%d %s Size: %.2fkb Return code:200', page_id, url, strlen(html) / 1024.0) end as line from pages""")
def crawl_log_failures(spark, sf_dir):
    """Outcomes of fetches, dealt over all pages: four kinds of failures and stored pages."""
    kinds = F.element_at(F.array(*map(F.lit, ("timeout", "http", "url", "other", "stored"))), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").withColumn("kind", kinds).withColumn("code", (F.col("page_id") % 7 + 400).cast("int"))
    return crawl.crawl_log(pages.where("kind = 'stored'"), failures=pages.where("kind <> 'stored'"))


# The stored pages name no other stored page. Over a few hosts, with an anchor's path as address, they do.
WEB = """web as (select page_id, concat('http://w', page_id % 5, '.example', coalesce(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)[page_id % 3 + 1], '/')) as url, html from pages)"""


def web(spark, sf_dir):
    path = F.coalesce(F.get(urls.anchors(F.col("html")), (F.col("page_id") % 3).cast("int")), F.lit("/"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://w"), F.col("page_id") % 5, F.lit(".example"), path).alias("url"), "html")


def _levels_sql(levels: int) -> str:
    parts = [f"with {WEB}", LINKS.replace("from pages)", "from web)"), """first as (select url, min(page_id) as first_page from (select page_id, url from web order by page_id limit 10) group by url)""", f"""seen0 as (select url, netloc, 0 as level from (select url, {HOST("url")} as netloc, row_number() over (partition by {HOST("url")} order by first_page) as rn from first) where rn <= 10)"""]
    for k in range(1, levels + 1):
        parts.append(f"""found{k} as (select link as url, {HOST("link")} as netloc, min(page_id) as first_page from links where page_id in (select page_id from web where url in (select url from seen{k - 1} where level = {k - 1})) and link not in (select url from seen{k - 1}) group by link),
seen{k} as materialized (select * from seen{k - 1} union all select url, f.netloc, {k} from (select *, row_number() over (partition by netloc order by first_page, url) as rn from found{k}) f left join (select netloc, count(*) as n from seen{k - 1} group by netloc) h on f.netloc = h.netloc where rn + coalesce(n, 0) <= 10)""")
    return ",\n".join(parts) + f" select url, netloc, level from seen{levels}"


@query(_levels_sql(3))
def crawl_levels(spark, sf_dir):
    return crawl.crawl_bfs(web(spark, sf_dir), 3)


def crawl_batches(spark, sf_dir):
    """Three batches of ten by priority. SQL has no short form; the tests hold it to a walk by hand."""
    return crawl.crawl_prioritised(web(spark, sf_dir), 3)


QUERIES["crawl_batches"] = crawl_batches
