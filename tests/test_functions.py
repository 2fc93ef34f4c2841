import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import codes, text, urls
from termloom.plans.queryparse import parse


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_tokenizers_differ(spark):
    df = one(spark, t="Don't STOP 49,130 Kelvin x1\n\ny")
    got = df.select(text.letters(F.col("t")).alias("l"), text.prefixes(F.col("t")).alias("p"), text.prefixes(F.col("t"), True).alias("q"), text.alnum(F.col("t")).alias("a")).first()
    assert got.l == ["Don", "t", "STOP", "elvin", "x", "y"]
    assert got.p == ["Don", "STOP", "49", "x1", "y"]
    assert got.q == ["don", "stop", "49", "x1", "y"]
    assert got.a == ["don", "t", "stop", "49", "130", "elvin", "x1", "y"]


def test_html_tokens(spark):
    df = one(spark, h='<HTML lang="en"><script>var a = "<b>";</script>Hi <b>There</b></html>', n="no element")
    got = df.select(text.html_alnum(F.col("h")).alias("h"), text.html_alnum(F.col("n")).alias("n")).first()
    assert got.h == ["hi", "there"] and got.n == []


def test_word_count_and_header(spark):
    df = one(spark, t=" a\tb\x0bc\n", e="", d="<DOC>\n<DOCHDR>\nhttp://x/y\nmore")
    got = df.select(text.word_count(F.col("t")).alias("t"), text.word_count(F.col("e")).alias("e"), text.header_url(F.col("d")).alias("d"), text.normalise_query_word(F.lit('"49,130!')).alias("q")).first()
    assert (got.t, got.e, got.d, got.q) == (3, 0, "http://x/y", "49130")


@given(st.sets(st.integers(0, 5000), min_size=1, max_size=64))
@settings(max_examples=60, deadline=None)
def test_interpolative_round_trip(ids):
    ids = sorted(ids)
    bits = codes.interpolative_bits(ids)
    assert codes.interpolative_ids(codes.unpack_bits(codes.pack_bits(bits), len(bits)), len(ids), ids[0], ids[-1]) == ids


def test_dense_blocks_cost_nothing():
    assert codes.interpolative_bits(list(range(7, 71))) == "" and codes.interpolative_bits([9]) == ""


def test_lengths_equal_payloads(spark):
    rng = random.Random(3)
    blocks = [sorted(rng.sample(range(10_000), n)) for n in (1, 2, 3, 63, 64)]
    df = spark.createDataFrame([(b,) for b in blocks], "ids array<long>")
    for r in df.select("ids", codes.interpolative_length(F.col("ids")).alias("n"), codes.interpolative_encode(F.col("ids")).alias("p")).collect():
        assert r.n == len(codes.interpolative_bits(r.ids)) and len(r.p) == -(-r.n // 8)


def test_varbyte_both_polarities_and_gamma(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**31, 2**40]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for stop in (True, False):
        got = df.select("n", codes.varbyte_hex(F.col("n"), stop).alias("c"), codes.varbyte_length(F.col("n")).alias("k")).collect()
        assert all(len(r.c) == 2 * r.k for r in got)
        joined = spark.createDataFrame([("".join(r.c for r in sorted(got, key=lambda r: r.n)),)], "c string")
        assert joined.select(codes.varbyte_decode(F.col("c"), stop).alias("x")).first().x == numbers
    some = [1, 2, 3, 4, 5, 255, 256, 1, 1]
    bits = "".join(r.c for r in spark.createDataFrame([(n,) for n in some], "n long").coalesce(1).select(codes.gamma(F.col("n")).alias("c")).collect())
    assert spark.createDataFrame([(bits,)], "b string").select(codes.gamma_decode(F.col("b")).alias("x")).first().x == some
    assert spark.createDataFrame([(4, 9)], "n long, b long").select(codes.unary(F.col("n")).alias("u"), codes.aligned(F.col("b")).alias("a")).first() == ("0001", 16)


def test_bit_strings(spark):
    df = spark.createDataFrame([(5,), (300,)], "n long")
    assert [r[0] for r in df.select(codes.varbyte_bits(F.col("n"))).collect()] == ["10100001", "00110100" + "01000001"]
    for bits in ("", "1", "101100111", "00000001" * 3):
        row = spark.createDataFrame([(bits,)], "b string").select(codes.bits_hex(F.col("b")).alias("h")).select("h", codes.hex_bits(F.col("h")).alias("b")).first()
        assert row.h == codes.pack_bits(bits).hex().upper() and row.b == bits + "0" * (-len(bits) % 8)


def test_query_parser():
    assert parse("with AND this by").groups == (("with", "this", "by"),) and not parse("a or b").disjunctive
    assert parse("a b OR c").groups == (("a", "b"), ("c",)) and parse("a b OR c").disjunctive
    assert parse("49,130").terms == ("49", "130") and parse("49,130!", strip=True).terms == ("49130",)
    assert parse("").groups == () and parse("OR").groups == ()


def test_url_rules(spark):
    page = "http://u@h.com:80/d/p.html?q#f"
    hrefs = ["/a?b#c", "#top", "http://o.com/x.PDF", "http://o.com/x", "//other.com/y", "mailto:z", "", "rel.html", "/pic.JPG", "httpdocs/z"]
    df = spark.createDataFrame([(page, h) for h in hrefs], "p string, h string")
    got = {r.h: (r.w, r.u) for r in df.select("h", urls.wanted(F.col("h")).alias("w"), urls.resolve(F.col("p"), F.col("h")).alias("u")).collect()}
    assert got["/a?b#c"] == (True, "http://u@h.com:80/a") and got["#top"] == (True, page)
    assert not got["http://o.com/x.PDF"][0] and got["http://o.com/x"] == (True, "http://o.com/x")
    assert got["//other.com/y"] == (True, "http://u@h.com:80/y")
    assert not got["mailto:z"][0] and not got[""][0] and not got["rel.html"][0] and not got["/pic.JPG"][0]
    assert got["httpdocs/z"] == (True, "http://u@h.com:80/d/httpdocs/z")
    assert df.select(urls.netloc(F.col("p")).alias("n"), urls.scheme(F.col("p")).alias("s")).first() == ("u@h.com:80", "http")


def test_decoders_stop_at_broken_codes(spark):
    big = 2**62 + 5
    row = spark.range(1).select(
        codes.varbyte_decode(F.concat(codes.varbyte_hex(F.lit(big)), codes.varbyte_hex(F.lit(0)), F.lit("01"))).alias("v"),
        codes.varbyte_decode(F.lit("")).alias("v0"),
        codes.gamma_decode(F.concat(codes.gamma(F.lit(big)), codes.gamma(F.lit(1)), F.lit("0010"))).alias("g"),
        codes.gamma_decode(F.lit("0000000")).alias("g0"),
    ).first()
    assert (row.v, row.v0, row.g, row.g0) == ([big, 0], [], [big, 1], [])
