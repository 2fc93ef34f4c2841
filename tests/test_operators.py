import math
import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import crawl, postings, reorder, search, snippets
from termloom.plans.engine import SearchEngine
from termloom.plans.materialize import in_ranges, with_rank
from termloom.plans.queryparse import parse
from termloom.sources import readers, writers
from termloom.streaming import incremental

TOY = [("a", 1, 1), ("b", 1, 1), ("a", 2, 1), ("b", 2, 1), ("c", 3, 1), ("a", 4, 1), ("c", 4, 1)]


@pytest.fixture
def toy(spark):
    return spark.createDataFrame(TOY, readers.POSTINGS)


@pytest.fixture
def lengths(spark):
    return spark.createDataFrame([(i, 10 + i) for i in range(1, 9)], "doc_id long, doc_len long")


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_toy_lists(toy):
    got = {r.term: (r.df, r.doc_ids) for r in postings.posting_lists(toy).collect()}
    assert got == {"a": (3, [1, 2, 4]), "b": (2, [1, 2]), "c": (2, [3, 4])}
    assert {(r.term, r.last_doc_id, r.n) for r in postings.blocks(toy).collect()} == {("a", 4, 3), ("b", 2, 2), ("c", 4, 2)}
    gaps = postings.gaps(toy)
    assert [r.gap for r in gaps.where("term = 'a'").orderBy("pos").collect()] == [1, 1, 2]
    assert {(r.term, r.doc_id) for r in postings.gap_decode(gaps.select("term", "pos", "gap")).collect()} == {x[:2] for x in TOY}


def test_toy_queries(toy, lengths):
    assert sorted(ids(search.conjunctive(toy, lengths, ("a", "b")))) == [1, 2]
    assert ids(search.conjunctive(toy, lengths, ("a", "c"))) == [4]
    assert sorted(ids(search.disjunctive(toy, lengths, ("b", "c")))) == [1, 2, 3, 4]
    assert ids(search.conjunctive(toy, lengths, ("a", "zz"))) == [] and ids(search.conjunctive(toy, lengths, ())) == []
    assert sorted(ids(search.disjunctive(toy, lengths, ("b", "zz")))) == [1, 2]
    assert ids(search.run(toy, lengths, parse(""))) == []
    assert sorted(ids(search.run(toy, lengths, parse("a b OR c"), dnf=True))) == [1, 2, 3, 4]


def test_scores_by_hand(toy, lengths):
    twice = {r.doc_id: r.score for r in search.conjunctive(toy, lengths, ("b", "b")).collect()}
    average = sum(10 + i for i in range(1, 9)) / 8
    by_hand = lambda d: math.log((8 - 2 + 0.5) / 2.5) * 2.2 / (1.2 * (0.25 + 0.75 * (10 + d) / average) + 1)
    assert twice == {1: round(2 * by_hand(1), 6), 2: round(2 * by_hand(2), 6)}
    fixed = search.conjunctive(toy, lengths, ("b",), n_docs=3, average=10.0).collect()
    assert fixed and all(r.score < 0 for r in fixed)


def test_details_and_alternatives(toy, lengths):
    hits = search.conjunctive(toy, lengths, ("c", "a"))
    assert [tuple(t) for t in search.details(toy, lengths, hits, ("c", "a")).first().terms] == [("c", 1, 2), ("a", 1, 3)]
    got = search.alternatives(toy, lengths, (("a",), ("a", "b"))).collect()
    assert len([r for r in got if r.doc_id == 1]) == 2
    assert search.alternatives(toy, lengths, ()).collect() == []


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_batch_of_whole_texts(toy, lengths, spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    wanted = spark.createDataFrame([(1, "a"), (1, "c"), (1, "unknown"), (2, "unknown"), (3, "b")], "query_id long, term string")
    got = search.rank_batch(toy, lengths, wanted, disjunctive=True).orderBy("query_id", "rank").collect()
    for q, terms in ((1, ("a", "c")), (2, ("unknown",)), (3, ("b",))):
        assert [(r.doc_id, r.score) for r in got if r.query_id == q] == [(r.doc_id, r.score) for r in search.disjunctive(toy, lengths, terms).collect()]
    assert search.rank_batch(toy, lengths, wanted.where("query_id = 1")).collect() == []
    both = search.rank_batch(toy, lengths, wanted.where("term in ('a', 'c')")).collect()
    assert [(r.doc_id, r.score) for r in both] == [(r.doc_id, r.score) for r in search.conjunctive(toy, lengths, ("a", "c")).collect()]
    odd = toy.select("term", "doc_id", "freq").unionByName(spark.createDataFrame([(None, 1, 1), ("a", None, 1)], "term string, doc_id long, freq long"))
    assert search.rank_batch(odd, lengths, wanted, disjunctive=True).orderBy("query_id", "rank").collect() == got


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128])
def test_block_boundaries(spark, n):
    df = spark.range(n).select(F.lit("t").alias("term"), (F.col("id") * 3).alias("doc_id"), F.lit(1).cast("long").alias("freq"))
    sizes = [r.n for r in postings.blocks(df).orderBy("block_no").collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 64) and all(s == 64 for s in sizes[:-1])


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_lists_over_several_ranges(spark, whole_partitions):
    """One term in most documents: its list is cut into ranges, and numbers, gaps and sums go on across them."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.lit("zz")).otherwise(F.lit("hot")).alias("term"), (F.col("id") * 3 + 2).alias("doc_id"), (F.col("id") % 5 + 1).alias("freq"))
    assert in_ranges(df, ["term", "doc_id"]).where("term = 'hot'").select("_range").distinct().count() > 1
    want, at = {}, {}
    for t, d in sorted((r.term, r.doc_id) for r in df.collect()):
        n, before = at.get(t, (0, None))
        want[t, d] = (n + 1, n // 64, d - (before or 0), d + 1 if n % 64 == 0 else d - before)
        at[t] = (n + 1, d)
    rows = {(r.term, r.doc_id): r for r in postings.within_blocks(df).collect()}
    gapped = postings.gaps(df)
    whole = {(r.term, r.doc_id): r for r in gapped.collect()}
    assert {k: (rows[k].rn, rows[k].block_no, whole[k].gap, rows[k].gap) for k in want} == want and all(whole[k].pos == want[k][0] for k in want)
    back = postings.gap_decode(gapped.select("term", "pos", "gap"))
    assert {(r.term, r.doc_id): r.pos for r in back.collect()} == {k: v[0] for k, v in want.items()}
    edges = {(r.term, r.pos): (r.df, r.gap) for r in postings.term_edges(df, 500).collect()}
    assert edges == {("hot", v[0]): (3600, v[2]) for (t, _), v in want.items() if t == "hot"}


def test_index_payloads(spark):
    """Bytes by hand for one short list, and both formats read back."""
    by_hand = spark.createDataFrame([("t", 5, 1), ("t", 300, 3)], "term string, doc_id long, freq long")
    assert postings.varbyte_blocks(by_hand).select(F.hex("payload")).first()[0] == "82" + "2C82" + "83" + "82" + "85" + "2C82" + "81" + "83"
    # gaps 5 and 295; gamma of 1 and 3 is 1, 011: bits 1011, the first lowest
    assert postings.gamma_blocks(by_hand).select(F.hex("payload")).first()[0] == "82" + "2C82" + "A0" + "85" + "2782" + "0D"
    df = spark.range(300).select(F.when(F.col("id") % 7 == 0, F.lit("b")).otherwise(F.lit("a")).alias("term"), (F.col("id") * F.col("id") % 9001 * 50 + F.col("id")).alias("doc_id"), (F.col("id") % 300 + 1).alias("freq")).dropDuplicates(["term", "doc_id"])
    lists = {(r.term, r.block_no): (r.doc_ids, r.freqs) for r in postings.block_lists(df).collect()}
    sizes = {r.term: r.df for r in postings.lexicon(df).collect()}
    for got in (postings.read_varbyte_blocks(postings.varbyte_blocks(df)), postings.read_gamma_blocks(postings.gamma_blocks(df))):
        rows = {(r.term, r.block_no): r for r in got.collect()}
        assert {k: (r.doc_ids, r.freqs) for k, r in rows.items()} == lists
        assert all(r.last_doc_id == r.doc_ids[-1] and r.df == (sizes[r.term] if r.block_no == 0 else None) for r in rows.values())


def test_long_edge_line_is_read_in_one_pass(spark, tmp_path):
    """A quarter of a million gaps: arrays grown gap by gap would copy some 250 GB."""
    n = 250_000
    (tmp_path / "edges.txt").write_text(f"hot {n} 0 " + " ".join(["2"] * (n - 1)) + "\ncold 1 7\n")
    got = readers.term_edges(spark, str(tmp_path))
    assert {tuple(r) for r in got.groupBy("term").agg(F.count("*"), F.sum("doc_id"), F.max("doc_id")).collect()} == {("hot", n, n * (n - 1), 2 * (n - 1)), ("cold", 1, 7, 7)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_index_is_counted_where_texts_lie(spark):
    """Repeated, null and empty rows counted as by SQL; no posting is shuffled for its count, and none again for its block."""
    docs = spark.createDataFrame([(1, "A b a-b"), (1, "a c"), (2, None), (3, ""), (None, "b"), (None, "B \u017f"), (4, "x\n y_Z 9")], "doc_id long, text string")
    for tokenizer in ("letters", "prefix", "prefix_lower", "alnum", "html"):
        whole = postings.whole_postings(docs, tokenizer)
        assert plan(whole).count("Exchange") == 1 and "Aggregate" not in plan(whole)
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, postings.postings(docs, tokenizer).collect()))
    toy = spark.createDataFrame(TOY, readers.POSTINGS)
    assert "row_number" not in plan(postings.gaps(toy)) and "row_number" not in plan(postings.within_blocks(toy))


def test_blocks_over_several_ranges(spark, whole_partitions):
    """Blocks that begin in one range and end in another, in every form."""
    df = spark.range(3001).select(F.when(F.col("id") % 10 == 0, F.lit("zz")).otherwise(F.lit("hot")).alias("term"), (F.col("id") * 3 + 2).alias("doc_id"), (F.col("id") % 5 + 1).alias("freq"))
    by_term = {}
    for r in sorted(df.collect()):
        by_term.setdefault(r.term, []).append((r.doc_id, r.freq))
    want = {(t, i // 64): x[i : i + 64] for t, x in by_term.items() for i in range(0, len(x), 64)}
    for got in (postings.block_lists(df), postings.read_varbyte_blocks(postings.varbyte_blocks(df)), postings.read_gamma_blocks(postings.gamma_blocks(df))):
        rows = got.collect()
        assert {(r.term, r.block_no): list(zip(r.doc_ids, r.freqs)) for r in rows} == want and len(rows) == len(want)
        if "df" in got.columns:
            assert {r.term: r.df for r in rows if r.df} == {t: len(x) for t, x in by_term.items()}


def test_odd_numbers_in_codes(spark):
    """Codes of any length, and decoders that leave an unended number out."""
    from termloom.functions import codes

    x = [0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 2**56, 2**62]
    df = spark.createDataFrame([(i,) for i in x], "x long")
    for stop in (True, False):
        back = df.select("x", codes.varbyte_decode(codes.varbyte_hex(F.col("x"), stop), stop).alias("y"), codes.varbyte_bits(F.col("x"), stop).alias("b"), codes.hex_bits(codes.varbyte_hex(F.col("x"), stop)).alias("h")).collect()
        assert all(r.y == [r.x] and r.b == r.h for r in back)
    odd = spark.createDataFrame([("8182",), ("",), (None,), ("0181",), ("8101",), ("01",), ("85",)], "c string").select(codes.varbyte_decode(F.col("c"))).collect()
    assert [r[0] for r in odd] == [[1, 2], [], None, [129], [1], [], [5]]


def test_seek_and_next(toy):
    assert [(r.term, r.doc_id) for r in postings.from_term(toy, "b", 3).collect()] == [("b", 1), ("b", 2), ("c", 3)]
    assert postings.from_term(toy, "bb").collect() == []
    assert ids(postings.next_at_least(toy, "a", 3)) == [4] and ids(postings.next_at_least(toy, "a", 5)) == []


def test_ranks_are_dense(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "x double, id long")
    got = with_rank(df, ["x", "id"], "rank").orderBy("x").collect()
    assert [r["rank"] for r in got] == list(range(500))


def two_pointers(words, terms):
    import re

    at = [{t.lower() for t in re.findall("[A-Za-z0-9]+", w)} & set(terms) for w in words]
    best = None
    for r in range(len(at)):
        seen, left = set(), r + 1
        while seen != set(terms) and left > 0:
            left -= 1
            seen |= at[left]
        if seen == set(terms) and (best is None or r + 1 - left < best[1] - best[0]):
            best = (left, r + 1)
    return best


def test_snippets_equal_two_pointers(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "x", "y-b", "c.", "z"]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lp, r.rp, r.snippet) for r in snippets.snippets(df, ("a", "b", "a", "c")).collect()}
    for i, t in enumerate(texts):
        want = two_pointers(t.split(), ("a", "b", "c"))
        assert got[i][:2] == (want or (None, None))
        if want:
            w, (lp, rp) = t.split(), want
            assert rp - lp > 50 or got[i][2] == "".join(x + " " for x in w[max(0, lp - 10) : rp + 10])
        else:
            assert got[i][2] == "snippet unavailable"


def test_long_span_shows_its_ends(spark):
    words = ["a", *["x"] * 70, "b", *["y"] * 20]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert snippets.snippets(df, ("a", "b")).first().snippet == " ".join(words[:10]) + " ...... " + " ".join(words[62:82]) + " "
    assert [r.pos for r in snippets.occurrence(df, "x").collect()] == [1] and [r.pos for r in snippets.occurrence(df, "x", True).collect()] == [70]


def test_bisection_keeps_a_permutation(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(f"t{t}", d) for d in range(31) for t in rng.sample(range(8), 3)], "term string, doc_id long").distinct()
    perm = spark.range(31).select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    for got in (reorder.bisect_once(edges, perm), reorder.bisect(edges, perm, levels=2, rounds=2)):
        rows = got.collect()
        assert sorted(r.old_id for r in rows) == list(range(31)) == sorted(r.new_id for r in rows)
    assert 30 not in {r.doc_id for r in reorder.halves(perm).collect()}
    assert reorder.gains(edges, reorder.halves(perm), True).count() == 30


def test_gains_are_those_of_the_c_library(spark):
    """Degrees multiply a logarithm's last bit: every gain is the same double that SQL's log2 gives."""
    import duckdb

    from termloom.functions.scores import move_gain, rounded

    rng = random.Random(7)
    given = [(float(rng.randint(1, 250000)), float(rng.randint(0, 250000)), 250000.0, 250000.0) for _ in range(500)]
    df = spark.createDataFrame(given, "o double, r double, no double, nr double")
    mine = df.select("o", "r", move_gain(F.col("o"), F.col("r"), F.col("no"), F.col("nr")).alias("g")).collect()
    con = duckdb.connect()
    con.execute("create table x (o double, r double, no double, nr double)")
    con.executemany("insert into x values (?, ?, ?, ?)", given)
    theirs = con.sql("select o, r, o * log2(no / (o + 1)) + r * log2(nr / (r + 1)) - ((o - 1) * log2(no / o) + (r + 1) * log2(nr / (r + 2))) from x").fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs)
    halves = [0.0000005, 1.0000025, -1.0000025, 2.5, 0.49999999999999994, -0.0, 1234.5678905]
    got = spark.createDataFrame([(x,) for x in halves], "x double").select(rounded(F.col("x"), 6)).collect()
    assert [r[0] for r in got] == [con.sql(f"select round({x!r}::double, 6)").fetchall()[0][0] for x in halves]
    none = spark.createDataFrame([(0.0, 3.0), (None, 1.0)], "o double, r double").select(move_gain(F.col("o"), F.col("r"), F.lit(5.0), F.lit(5.0)))
    assert [r[0] for r in none.collect()] == [None, None]


def test_unmatched_postings(toy, spark):
    perm = spark.createDataFrame([(1, 7), (2, 5)], "old_id long, new_id long")
    assert sorted((r.term, r.doc_id) for r in reorder.reassign(toy, perm).collect()) == [("a", 5), ("a", 7), ("b", 5), ("b", 7)]
    assert {(r.doc_id, r.postings) for r in reorder.unmatched(toy, perm).collect()} == {(3, 1), (4, 2)}


def site(spark):
    a = lambda *h: "<html>" + "".join(f'<a class="k" href="{x}">l</a>' for x in h) + "</html>"
    rows = [(0, "http://a.com/0", a("/1", "/1", "/2", "http://b.org/x", "mailto:q", "/p.gif")), (1, "http://a.com/1", a("/2", "#here")), (2, "http://a.com/2", '<base href="http://c.net/">' + a("/z")), (3, "http://d.com/3", '<base href="nonsense">' + a("/z"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_links_base_and_robots(spark):
    pages = site(spark)
    got = {(r.page_id, r.link) for r in crawl.links(pages).collect()}
    assert got == {(0, "http://a.com/1"), (0, "http://a.com/2"), (0, "http://b.org/x"), (1, "http://a.com/2"), (1, "http://a.com/1"), (2, "http://c.net/z")}
    robots = spark.createDataFrame([("a.com", "/2"), ("zz.com", "/")], "netloc string, prefix string")
    assert {r.link for r in crawl.links(pages, robots).collect()} == {"http://a.com/1", "http://b.org/x", "http://c.net/z"}


def test_crawls(spark):
    pages = site(spark)
    levels = {(r.url, r.level) for r in crawl.crawl_bfs(pages, 2, crawl.seeds(pages, 1)).collect()}
    assert levels == {("http://a.com/0", 0), ("http://a.com/1", 1), ("http://a.com/2", 1), ("http://b.org/x", 1), ("http://c.net/z", 2)}
    rated = {r.url: (r.importance, r.novelty, r.score) for r in crawl.prioritised(pages, pages.where("page_id in (0, 1)")).collect()}
    assert rated == {"http://a.com/2": (1, 3, round(5 / 3 + 1, 6)), "http://b.org/x": (0, 1, 5.0)}
    order = {r.url: r.batch for r in crawl.crawl_prioritised(pages, 1, crawl.seeds(pages, 1)).collect()}
    assert order["http://b.org/x"] == 1 and order["http://a.com/0"] == 0
    many = spark.range(30).select(F.concat(F.lit("http://s.com/"), "id").alias("url"), F.col("id").alias("page_id"))
    assert crawl.cap_sites(many, ["page_id"]).count() == 10
    lines = [r.line for r in crawl.crawl_log(pages, spark.createDataFrame([("http://a.com/0", 2.5)], "url string, score double")).orderBy("page_id").collect()]
    assert lines[0].endswith("Return code:200 Priority score:2.50") and lines[1].endswith("Return code:200")


def graph_of_pages(spark, n=60, seed=3):
    """Pages that link to one another over a few hosts, several to unknown addresses."""
    rng = random.Random(seed)
    address = [f"http://h{i % 7}.com/p{i}" for i in range(n)]
    rows = [(i, address[i], "<html>" + "".join(f'<a href="{rng.choice(address + [f"http://u{k}.org/x" for k in range(9)])}">l</a>' for _ in range(rng.randrange(0, 7))) + "</html>") for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def named(rows, ids):
    import re

    out = {}
    for i, _, html in rows:
        if i in ids:
            for link in set(re.findall('href="([^"]*)"', html)):
                out.setdefault(link, set()).add(i)
    return out


def host(url):
    return url.split("/")[2]


@pytest.mark.parametrize("limit", [12_000, 13])
def test_levels_against_a_queue(spark, limit):
    from collections import Counter

    pages, rows = graph_of_pages(spark)
    by_url = {u: i for i, u, _ in rows}
    queue = [(0, i, u) for i, u, _ in rows[:4]]
    for level in (1, 2, 3):
        before = sum(x[0] < level - 1 for x in queue)
        turn = sorted((p, u) for k, p, u in queue if k == level - 1)[: max(0, limit - before)]
        if before >= limit:
            break
        found = sorted((min(p), u) for u, p in named(rows, {by_url[u] for _, u in turn if u in by_url}).items() if u not in {x[2] for x in queue})
        had = Counter(host(x[2]) for x in queue)
        now = Counter()
        for p, u in found:
            now[host(u)] += 1
            if now[host(u)] + had[host(u)] <= 10:
                queue.append((level, p, u))
    got = crawl.crawl_bfs(pages, 3, crawl.seeds(pages, 4), limit=limit)
    assert sorted((r.url, r.level) for r in got.collect()) == sorted((u, k) for k, _, u in queue)


@pytest.mark.parametrize("limit,refill", [(12_000, 1_000), (25, 1_000), (12_000, 12)])
def test_batches_against_a_heap(spark, limit, refill):
    """One batch after another, by hand: the best ten, then waiting pages are read until the frontier holds enough."""
    from collections import Counter

    pages, rows = graph_of_pages(spark)
    by_url = {u: i for i, u, _ in rows}
    read, taken = set(range(4)), {u: 0 for _, u, _ in rows[:4]}

    def frontier(ids, without):
        starts = {u for i, u, _ in rows if i in ids}
        had, now, out = Counter(map(host, starts)), Counter(), {}
        for p, u in sorted((min(p), u) for u, p in named(rows, ids).items() if u not in without):
            now[host(u)] += 1
            if now[host(u)] + had[host(u)] <= 10:
                out[u] = p
        return out, had

    for batch in (1, 2, 3):
        if len(taken) >= limit:
            break
        first, had = frontier(read, {u for i, u, _ in rows if i in read})
        made = Counter(map(host, first)) + had
        score = {u: round(5 / made[host(u)] + len(named(rows, read)[u]) - 1, 6) for u in first if u not in taken}
        for u in sorted(score, key=lambda u: (-score[u], u))[: min(10, limit - len(taken))]:
            taken[u] = batch
        left = len([u for u in score if u not in taken])
        waiting = sorted(by_url[u] for u in taken if u in by_url and by_url[u] not in read)
        new = Counter(frontier_page for frontier_page in late_frontier(rows, read, waiting, taken).values())
        held = left
        for p in waiting:
            if held < refill:
                read.add(p)
            held += new[p]
    got = crawl.crawl_prioritised(pages, 3, crawl.seeds(pages, 4), limit, refill)
    assert {r.url: r.batch for r in got.collect()} == taken


def late_frontier(rows, read, waiting, taken):
    from collections import Counter

    had, now, out = Counter(host(u) for i, u, _ in rows if i in read), Counter(), {}
    for p, u in sorted((min(p), u) for u, p in named(rows, read | set(waiting)).items() if u not in taken):
        now[host(u)] += 1
        if now[host(u)] + had[host(u)] <= 10:
            out[u] = p
    return out


def test_failed_fetches_are_logged(spark):
    failed = spark.createDataFrame([(7, "http://a.com/7", "timeout", None), (8, "http://a.com/8", "http", 404), (9, "http://a.com/9", "url", None), (10, "http://a.com/10", "odd", None)], "page_id long, url string, kind string, code int")
    lines = {r.page_id: r.line for r in crawl.crawl_log(site(spark), failures=failed).collect()}
    assert lines[7] == "7 http://a.com/7 connection time out" and lines[8] == "8 http://a.com/8 ErrorCode:404" and lines[9] == "9 http://a.com/9 URLError" and lines[10] == "10 http://a.com/10 Other weird Error" and len(lines) == 8


def test_reader_cases(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    writers.trec(spark.createDataFrame([("http://x/1", None), ("http://x/2", "a")], "url string, text string"), at("t"))
    assert {tuple(r) for r in readers.trec(spark, at("t"), ordered=False).collect()} == {("http://x/1", ""), ("http://x/2", "a")}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("t 1\n")
    (tmp_path / "l" / "b.txt").write_text("t 2\n" * 5000 + "u 3\n")
    assert {tuple(r) for r in readers.lexicon(spark, at("l")).collect()} == {("t", 1), ("u", 3)}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "bad.gz").write_bytes(b"no gzip at all")
    writers.gov2(spark.createDataFrame([("http://g/1", "<html>x</html>"), ("http://g/2", None)], "url string, html string").coalesce(1), at("g/good"))
    assert [r.file.rsplit("/", 1)[1] for r in readers.broken_files(spark, at("g")).collect()] == ["bad.gz"]
    assert {r.url for r in readers.gov2(spark, at("g/*"), skip_broken=True).collect()} == {"http://g/1", "http://g/2"}
    with pytest.raises(Exception, match="gz"):
        readers.gov2(spark, at("g/*")).collect()
    with pytest.raises(ValueError):
        SearchEngine.from_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string")).__class__(None, None).show("x")


def test_files_round_trip(spark, toy, tmp_path):
    at = lambda n: str(tmp_path / n)
    writers.postings(toy, at("p"))
    assert {tuple(r) for r in readers.postings(spark, at("p")).collect()} == set(TOY)
    writers.lexicon(postings.lexicon(toy), at("l"))
    assert {tuple(r) for r in readers.lexicon(spark, at("l")).collect()} == {("a", 3), ("b", 2), ("c", 2)}
    writers.term_edges(postings.term_edges(toy, 2), at("e"))
    assert {tuple(r) for r in readers.term_edges(spark, at("e")).collect()} == {("a", 1), ("a", 2), ("a", 4)}
    perm = spark.createDataFrame([(i, (i * 7) % 20) for i in range(20)], "old_id long, new_id long")
    writers.permutation(perm, at("m"))
    assert {tuple(r) for r in readers.permutation(spark, at("m")).collect()} == {tuple(r) for r in perm.collect()}
    docs = spark.createDataFrame([("http://x/1", "one two\nthree"), ("http://x/2", "")], "url string, text string")
    writers.trec(docs.coalesce(1), at("t"))
    assert [tuple(r) for r in readers.trec(spark, at("t")).orderBy("doc_id").collect()] == [(0, "http://x/1", "one two\nthree"), (1, "http://x/2", "")]
    info = spark.createDataFrame([(1, "u", 5, 4)], "doc_id long, url string, word_count long, distinct_words long")
    writers.document_info(info, at("i"))
    assert tuple(readers.document_info(spark, at("i")).first()) == (1, "u", 5, 4)
    writers.document_map(info, at("d"))
    assert tuple(readers.document_map(spark, at("d")).first()) == (1, "u")
    writers.document_lengths(spark.createDataFrame([(1, 9)], "doc_id long, doc_len long"), at("n"))
    assert tuple(readers.document_lengths(spark, at("n")).first()) == (1, 9)


def test_gov2_gzip(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "00.gz", "wt") as f:
        f.write("<DOC>\n<DOCNO>1</DOCNO>\n<DOCHDR>\nhttp://g.gov/a\nServer: x\n</DOCHDR>\n<html>Hi</html>\n</DOC>\n<DOC>\n<DOCHDR>\nhttp://g.gov/b\n</DOCHDR>\nplain\n</DOC>\n")
    got = sorted((r.url, r.html.strip()) for r in readers.gov2(spark, str(tmp_path / "*.gz")).collect())
    assert got == [("http://g.gov/a", "<html>Hi</html>"), ("http://g.gov/b", "")]


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red dog"), (3, "blue fox"), (4, "x"), (5, None)], "doc_id long, text string")
    engine = SearchEngine.from_documents(docs).save(str(tmp_path / "index"))
    assert ids(engine.search("red fox")) == [1] and sorted(ids(engine.search("dog OR blue"))) == [2, 3]
    shown = engine.show("red fox").first()
    assert shown.snippet == "red fox jumps " and shown.doc_len == 3
    assert "docLength:3" in writers.report(engine.show("red fox")).first().line


def test_streams(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "frontier")
    site(spark).repartition(2).write.parquet(src)
    pages = incremental.stream(spark, src, "page_id long, url string, html string", files=1)
    incremental.feed_frontier(pages, table, str(tmp_path / "cp")).awaitTermination()
    found = [r.url for r in spark.read.parquet(table).collect()]
    assert len(found) == len(set(found)) and {"http://b.org/x", "http://c.net/z"} <= set(found)
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(docs)
    incremental.term_counts(incremental.stream(spark, docs, "doc_id long, text string")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
    assert incremental.event_counts(incremental.stream(spark, "/root/testdata/sf0.001/events.parquet", spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema)).isStreaming


def test_plans_push_down(spark):
    from termloom import catalogue

    plan = catalogue.QUERIES["bm25_or_flat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
