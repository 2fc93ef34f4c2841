"""Each operator against brute force or SQL, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import chat, decontam, ego, entries, features, packing, quality, secrets, simhash, substring, toxicity, warc
from termloom.llm.shared import connected_components, smallest, spanning_forest

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, score double, row long, spans string, k1 long, n long, id long, piece int"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def joined(spark, df):
    """df as a join and a shuffle give it: planned again for each column set, its rows come in other orders and partitions."""
    other = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("more").alias("_row"), F.lit(1).alias("_doc"))
    return df.repartition(32, "doc_id").hint("merge").join(other.repartition(32).hint("merge"), "doc_id")


def docs(spark, texts, ids=None):
    """Documents with columns whose names operators use inside."""
    rows = [(ids[i] if ids else i, t, 0.5, i, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \t\n", "one", "Two words", LONG, "é ü \U0001f600 ß", "same text here " * 20, "same text here " * 20]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(entries.Q[name], entries.SQL[name])


# -- 1: chat --------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    for t in ("<|", "<\\|", "<\\\\|x<|im_end|>", "a<", "|b", "<|<|<\\|"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n\\n")) == t + "\n\\n"


def test_chat_cases(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>"), (2, 0, "assistant", "x"), (3, 0, None, None), (None, 0, "user", "n"), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, None, "system", "a\nb"), (5, 0, "tool", LONG)]
    df = spark.createDataFrame([(*t, "r", 7) for t in talk], "conv_id long, turn long, role string, text string, segment string, seg_no long")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[4].valid
    assert (got[1].n_turns, got[1].loss_chars, got[4].n_turns) == (2, 23, 3)
    assert got[1].loss_sha256 == hashlib.sha256(b"<|im_end|>\n<|im_start|>").hexdigest()
    assert got[4].turns_sha256 == hashlib.sha256(b"system\na\nb\nuser\nb\nuser\nb\n").hexdigest()
    assert got[None].n_turns == 1 and got[3].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.read_back(chat.format_chat(df.limit(0))).collect() == []
    marked = "".join(r.segment for r in chat.format_chat(df.where("conv_id = 1")).orderBy("seg_no").collect())
    assert marked.count("<|im_start|>") == marked.count("<|im_end|>") == 2


def test_templates_read_back(spark):
    """Any template that is accepted reads back; one whose marks can't be told from texts is refused."""
    talk = [(1, 0, "us[er\n", "[INST] a [/INST]\n[INST] x\ny [/INST]\n"), (1, 1, "assistant", " [" + "\\" * 3 + "[I[I"), (1, 2, "user", ""), (1, 3, "assistant", " "), (2, 0, "user", " [/INST]")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    want = {c: hashlib.sha256("".join(f"{r}\n{t}\n" for i, _, r, t in talk if i == c).encode()).hexdigest() for c in (1, 2)}
    for template in (chat.Template(head="[INST] ", tail=" [/INST]\n"), chat.Template(head="<s>\n", tail="\n</s>\n"), chat.Template(head="ab", tail="ba"), chat.CHATML):
        got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df, template), template).collect()}
        assert {c: r.turns_sha256 for c, r in got.items()} == want and [got[c].n_turns for c in (1, 2)] == [4, 1]
        assert got[1].loss_sha256 == hashlib.sha256((talk[1][3] + talk[3][3]).encode()).hexdigest()
    for bad in ("x", "", "aab", "\\a"):
        with pytest.raises(ValueError):
            chat.Template(tail=bad)


@given(st.text("ab<|[ \\\n", max_size=12), st.sampled_from([("<|x", "<|y"), ("ab", "ba"), ("[ ", " [\n"), ("a<b", "|a|")]))
@settings(max_examples=300, deadline=None)
def test_escapes_of_any_marks(text, marks):
    template = chat.Template(head=marks[0], tail=marks[1])
    safe = template.escape(text)
    assert template.unescape(safe) == text and all((safe + m).find(m) == len(safe) for m in marks)
    assert template.unescape_role(template.escape_role(text)) == text and "\n" not in template.escape_role(text)


# -- 2: embeddings ----------------------------------------------------------------------------------------------------------


def brute_links(vectors, threshold=0.9):
    good = {i: np.array(v, float) for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(i, j) for i in good for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= threshold]
    return Counter(i for i, _ in links), links


def groups(n, links):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    vectors = [(base[i % 12] + rng.normal(size=8) * 0.25 * (i % 5)).tolist() for i in range(150)]
    vectors += [vectors[0], vectors[0], [x * 7 for x in vectors[1]], [0.0] * 8, None, [], [1.0, None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 0.0], [2.0, 0.1]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id long, n long")
    counts, links = brute_links(vectors)
    label = groups(len(vectors), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego.similarity_join(df, block=16).collect()}
    assert got == {i: (counts[i], label[i]) for i in range(len(vectors))}
    assert ego.similarity_join(df.limit(0)).collect() == []


def test_repeated_vec_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert rows(ego.similarity_join(df), "vec_id", "n_links", "component_id") == [(1, 1, 1), (1, 1, 1), (None, 0, None)]


def test_any_vec_ids(spark):
    big = 2**62
    df = spark.createDataFrame([(big + 6, [1.0, 0.0]), (big + 5, [1.0, 0.01]), (-big, [0.0, 1.0]), (None, [0.0, 1.01]), (2**63 - 1, [1e200, 1e200]), (None, [3e-200, 3.1e-200])], "vec_id long, embedding array<double>")
    got = rows(ego.similarity_join(df), "vec_id", "n_links", "component_id")
    assert got == sorted([(big + 6, 1, big + 5), (big + 5, 1, big + 5), (-big, 1, -big), (None, 1, -big), (2**63 - 1, 1, 2**63 - 1), (None, 1, 2**63 - 1)], key=repr)


def test_pairs_at_the_threshold(spark):
    """Cosines of exactly 0.9 in double precision link, whatever the axes that the search turns to."""
    exact = [(0.9, [1.0, 0.0], [9.0, math.sqrt(19.0)])]
    pairs = []
    for k in range(200):
        a = np.random.default_rng(k).normal(size=6)
        a /= np.sqrt(a @ a)
        b = np.random.default_rng(k + 999).normal(size=6)
        b -= (a @ b) * a
        pairs.append((a, 0.9 * a + math.sqrt(1 - 0.81) * b / np.sqrt(b @ b)))
    vectors = [v.tolist() for p in pairs for v in p] + [exact[0][1] + [0.0] * 4, exact[0][2] + [0.0] * 4]
    counts, _ = brute_links(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in ego.similarity_join(df, block=64).collect()}
    apart = [i for i in got if got[i] != counts[i]]
    near = [abs(np.dot(vectors[i], vectors[i ^ 1]) / math.sqrt(np.dot(vectors[i], vectors[i]) * np.dot(vectors[i ^ 1], vectors[i ^ 1])) - 0.9) for i in apart]
    assert all(x < 1e-15 for x in near)  # the last digit may differ with the order of summing, nothing else


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 7), (1, 2), (2, 3), (5, 4), (3, 1), *[(100, 100 + i) for i in range(1, 60)], *[(200 + i, 201 + i) for i in range(40)]]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    u, v = spanning_forest(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert got == dict(zip(u.tolist(), v.tolist()))
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# -- 3: archives --------------------------------------------------------------------------------------------------------------


def test_thinned_sample_is_the_plain_one(spark):
    df = spark.range(60_000).union(spark.range(500)).withColumn("x", F.lit(1))
    key = F.xxhash64("id")
    plain = [r.id for r in df.distinct().orderBy(key, "id").limit(40).collect()]
    few = smallest(df, key, "id", df.count(), 40, distinct=True)
    assert [r.id for r in few.collect()] == plain
    assert [r.id for r in smallest(df.where("id < 30"), key, "id", 30, 40, distinct=True).collect()] == [r.id for r in df.where("id < 30").distinct().orderBy(key, "id").collect()]


def test_surt():
    assert warc.surt("http://U@www.Ex.org:8080/a?b#c") == "org,ex,www:8080)/a?b" and warc.surt("http://x.y") == "y,x)/" and warc.surt(None) == "" and warc.surt("odd") == "odd"


def test_archives(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(5, "http://a.com/1", big), (2, "http://b.com/1", big), (7, "http://b.com/1", big), (8, None, None), (9, "http://a.com/1", "short"), (10, "z z", "short"), (11, "http://c.d/é", "é" * 200), (2, "http://b.com/1", big), (12, "http://l.com", LONG)]
    df = spark.createDataFrame([(*p, "x", 1, "y") for p in pages], "page_id long, url string, html string, file string, size long, digest string")
    got = rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min(j for j, _, k in pages if k == h)
        again = len(raw) >= 100 and first < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("pages", [
    [(2, "http://b/", "A" * 300), (2, "http://b/", "B" * 300), (7, "http://c/", "B" * 300), (8, "http://c/", "A" * 300)],
    [(1, "http://a/", "X" * 200), (2, "http://b/", "X" * 200), (2, "http://b/", "Y" * 200), (3, "http://c/", "Y" * 200), (3, "http://c/", "X" * 200)],
    [(4, "http://a/", "Z" * 150)] * 700 + [(5, "http://a/", "Z" * 150), (None, "http://a/", "Z" * 150)],
])
def test_repeated_page_ids(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = []
    for i, _, h in pages:
        first = min(j for j, _, k in pages if k == h and j is not None)
        again = i is not None and first < i
        want.append((i, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    assert rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)


def test_folders_for_archives(spark):
    from termloom.llm import shared
    from termloom.plans import materialize

    assert shared.store_dir(spark).startswith("file://") and shared.file_system("file:///x")[1] == "/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.file_system("odd://x/y")

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        materialize.shared_folder(Far)


# -- 4: substrings ---------------------------------------------------------------------------------------------------------------


def brute_removed(texts, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_windows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    shared = [" ".join(rng.choice(list("abcdef"), 60)) for _ in range(4)]
    texts = [*ODD, "a " * 200, "a b " * 100, "b a " * 50, shared[0], shared[0] + " x " + shared[1], "y\x0b" + shared[1] + " z z", *(" ".join(rng.choice(list("ab"), 80)) for _ in range(5))]
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(df, 35).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 35)
    assert substring.deduplicate(df.limit(0)).collect() == []
    for n in (1, 2, 8, 12, 17):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(df, n).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts, n)
    twice = docs(spark, [shared[2], shared[2], shared[3]], [1, 1, None])
    assert rows(substring.deduplicate(twice), "doc_id", "n_removed") == [(1, 60), (1, 60), (None, 0)]


def test_parts_of_long_texts():
    """Each window of a long text is whole in one part, at its place."""
    import pyarrow as pa

    texts = [" ".join(f"v{i % 31}" for i in range(700)), "short one", "", "  x\ty " * 90]
    batch = pa.record_batch([pa.array(range(4)), pa.array(texts)], names=["i", "text"])
    for window in (1, 5, 35):
        seen = []
        for part, at, starts, parts in substring.portions(iter([batch]), window, limit=200):
            for k, s, words in zip(at.tolist(), starts.tolist(), parts):
                seen += [(part.column(0)[k].as_py(), s + i, tuple(words[i : i + window])) for i in range(len(words) - window + 1)]
        split = [t.encode().split() for t in texts]
        assert sorted(seen) == sorted((k, i, tuple(w[i : i + window])) for k, w in enumerate(split) for i in range(len(w) - window + 1))


def test_hot_windows_against_brute_force(spark, whole_partitions, monkeypatch):
    """A passage in most texts, a line that most hold between words of their own, many tasks, grams dealt by window."""
    monkeypatch.setattr(substring, "HOT_LEAST", 2)
    rng = np.random.default_rng(3)
    passage, line = " ".join(f"p{i}" for i in range(50)), " ".join(f"l{i}" for i in range(30))
    own = lambda: " ".join(f"o{rng.integers(1 << 40)}" for _ in range(25))
    texts = [" ".join([own(), line if i % 3 else "", own(), passage if i % 2 else "", own()]) for i in range(90)]
    df = docs(spark, texts).repartition(12, "doc_id")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(df, 35).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 35)


# -- 5 and 8: classifiers ----------------------------------------------------------------------------------------------------------


def learnable(spark, label):
    rng = np.random.default_rng(9)
    clean = lambda: " ".join(rng.choice([f"word{i}" for i in range(60)], 30))
    ones = [i % 3 == 0 for i in range(600)]
    bad = (lambda: clean() + " nastyword vileword") if label == "toxic" else clean
    texts = [bad() if one else clean() if label == "toxic" else clean().replace(" ", " !! ") for one in ones]
    given = spark.createDataFrame([(i, int(one), None) for i, one in enumerate(ones) if i % 2 == 0] + [(9999, None, 1)], f"doc_id long, {label} int, text string")
    return docs(spark, texts), given, ones


def test_toxicity(spark):
    df, given, ones = learnable(spark, "toxic")
    model = toxicity.fit(df, given)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[i].predicted == one for i, one in enumerate(ones))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    odd = toxicity.score(docs(spark, ODD, [None, *range(8)]), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert toxicity.fit(df, given.where("toxic = 0")) is None and {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == [] and toxicity.fit(df.limit(0), given) is None


def test_rare_toxicity(spark):
    texts = [f"clean {'shared' if i % 80 == 0 else 'plain'}" if i >= 10 else "shared nastyword" for i in range(4000)]
    df = docs(spark, texts)
    given = spark.createDataFrame([(i, int(i < 10)) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.fit(df, given)
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    assert model.prior == sum(i < 10 for i in learned) / len(learned) < 0.003
    assert not set(model.used) & set(toxicity.features(b"shared", 20)) and set(toxicity.features(b"nastyword", 20)) <= set(model.used)


def test_quality(spark):
    df, given, ones = learnable(spark, "quality")
    model = quality.fit(df, given)
    got = {r.doc_id: r for r in quality.digest(quality.score(df, model)).collect()}
    assert sum(got[i].predicted == one for i, one in enumerate(ones)) >= 0.97 * len(ones)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    odd = quality.score(docs(spark, ODD, [None, *range(8)]), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    for kept, every in (("quality = 1", 1.0), ("quality = 0", 0.0), ("quality is null", 1.0)):  # no label: nothing is known against a text
        assert {r.score for r in quality.score(df, quality.fit(df, given.where(kept))).collect()} == {every}
    assert quality.score(df.limit(0), quality.fit(df.limit(0), given)).collect() == []


def test_training_rows_are_bounded(spark):
    """Ids that repeat, with one text or with many: so many different texts at most, and the same ones in any order."""
    ids = spark.range(40_000).select((F.col("id") % 60).alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 60 < 30, F.col("id") % 60).otherwise(F.col("id"))).alias("text"))
    given = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    make = lambda texts: list(texts)
    for bound in (10, 25, 500):
        keys = features.chosen_keys(ids, given, bound)
        got = features.features_of(ids, keys, make)
        assert len(got) == bound and len({(r[0], r[3]) for r in got}) == bound and all(r[2] == r[0] % 2 for r in got)
        again = features.features_of(ids.repartition(7), features.chosen_keys(ids.repartition(7), given, bound), make)
        assert again == got
    few = features.features_of(ids.where("doc_id < 30"), features.chosen_keys(ids, given.where("doc_id < 30"), 500), make)
    assert sorted(r[3].decode() for r in few) == sorted(f"t{i}" for i in range(30))


def test_sample_of_few_different_rows(spark):
    """Of many rows with few different ones, all are found, whatever the first share."""
    df = spark.range(200_000).select((F.col("id") % 60).alias("doc_id"), F.lit(1).alias("h"))
    got = smallest(df, F.xxhash64("doc_id", "h"), ["doc_id", "h"], df.count(), 8000, distinct=True)
    assert sorted(r.doc_id for r in got.collect()) == list(range(60))


def test_toxicity_where_rows_repeat(spark):
    base, given, ones = learnable(spark, "toxic")
    many = base.select("doc_id", "text").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    model = toxicity.fit(many, given)
    once = toxicity.fit(base, given)
    assert np.array_equal(model.used, once.used) and np.allclose(model.weights, once.weights) and np.isclose(model.bias, once.bias)
    learn = many.where(features.fold("doc_id", 5) != 0)
    counts, n = toxicity.text_counts(learn, np.array(sorted({*toxicity.features(b"nastyword", 20), *toxicity.features(b"word7", 20)})), 20, chunk=4)
    known = [r for r in learn.collect()]
    assert n == len(known) and sorted(counts) == sorted(sum(any(f in toxicity.features(w.encode(), 20) for w in r.text.split()) for r in known) for f in {*toxicity.features(b"nastyword", 20), *toxicity.features(b"word7", 20)})


def test_risk_and_gradient():
    """Against the sum of the published formula, and against differences of the risk."""
    rng = np.random.default_rng(2)
    model = toxicity.NnPU(4, 0.3, decay=0.0)
    model.weights, model.bias = rng.normal(size=6), -0.4
    docs_ = lambda n: (np.array([c for _ in range(n) for c in range(6)]), np.repeat(np.arange(n), 6), n)
    for case in range(20):
        p, u = ([np.flatnonzero(rng.random(6) < 0.5) for _ in range(n)] for n in (5, 9))
        sparse = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(c) for c in x]), len(x)) for x in (p, u)]
        model.weights, model.bias = rng.normal(size=6) * 2, rng.normal() * (3 if case % 2 else 1)
        z = lambda x: [model.weights[c].sum() + model.bias for c in x]
        plus = 0.3 * sum(math.log(1 + math.exp(-t)) for t in z(p)) / 5
        bracket = sum(math.log(1 + math.exp(t)) for t in z(u)) / 9 - 0.3 * sum(math.log(1 + math.exp(t)) for t in z(p)) / 5
        assert np.allclose(model._risk(*sparse), (plus, bracket))
        target = (lambda: sum(model._risk(*sparse))) if bracket >= 0 else (lambda: -model._risk(*sparse)[1])
        g = model._gradient(*sparse)
        for k in range(7):
            def moved(by):
                if k < 6:
                    model.weights[k] += by
                else:
                    model.bias += by
            moved(1e-6)
            up = target()
            moved(-2e-6)
            down = target()
            moved(1e-6)
            assert abs((up - down) / 2e-6 - g[k]) < 1e-6
    assert docs_(2)[2] == 2


def plain_tokens(text, marks):
    out, word = [], b""
    for b in (text or "").encode() + b" ":
        letter = 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
        if letter if not marks else not letter and b > 32:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
        elif word:
            out.append(word)
            word = b""
    return out


def test_context_vectors_and_pooling(spark):
    """Against sums by hand, over texts of which one is cut into many runs."""
    rng = np.random.default_rng(6)
    texts = [*ODD, *(" ".join(rng.choice(["Aa", "aa!", "b,", "c -- d", "é", "...", "x1"], 40)) for _ in range(30))]
    places, signs = quality.index_vectors()
    row = lambda w: xxhash.xxh32_intdigest(w) % quality.ROWS
    total = np.zeros((quality.ROWS, quality.DIM))
    for t in texts:
        for marks in (False, True):
            tokens = [row(w) for w in plain_tokens(t, marks)]
            if t is not LONG:
                for i, x in enumerate(tokens):
                    for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                        if i != j:
                            np.add.at(total[x], places[tokens[j]], signs[tokens[j]])
    want = (total / np.maximum(np.sqrt((total**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)
    few = [t for t in texts if t is not LONG]
    assert np.allclose(quality.context_vectors(docs(spark, few)), want, atol=1e-6)
    raw = [(t or "").encode() for t in few]
    for limit in (7, 64, 1 << 22):
        got = np.zeros(quality.ROWS * quality.DIM)
        quality.add_contexts(got, raw, 2, quality.Buckets(), places, signs, limit)
        assert np.array_equal(got.reshape(total.shape), total)
    by_hand = []
    for t in texts:
        words, marks = ([row(w) for w in plain_tokens(t, m)] for m in (False, True))
        v, m = want[words].astype(float), want[marks].astype(float)
        mean = v.mean(axis=0) if len(v) else np.zeros(quality.DIM)
        spread = np.sqrt(np.maximum((v * v).mean(axis=0) - mean**2, 0)) if len(v) else mean
        again = sum(a == b for a, b in zip(words, words[1:]))
        by_hand.append([*mean, *spread, *(m.mean(axis=0) if len(m) else mean * 0), math.log1p(len(marks) / max(1, len(words))), again / max(1, len(words)), math.log1p(len(words))])
    for limit in (100, 1 << 19):
        assert np.allclose(quality.pooled([(t or "").encode() for t in texts], want, quality.Buckets(), limit), by_hand, atol=2e-4)


def held_out(spark, name, label):
    at = "/root/testdata/sf0.1"
    got = entries.Q[name](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ones, zeros = got[got[label] == 1], got[got[label] == 0]
    return len(got), (ones.predicted == 1).mean(), (zeros.predicted == 1).mean()


def test_held_out_toxicity(spark):
    n, found, false = held_out(spark, "op5_toxicity_pu", "toxic")
    assert n > 500 and found >= 0.9 and false <= 0.01


def test_held_out_quality(spark):
    n, kept, false = held_out(spark, "op8_quality_classifier", "quality")
    assert n > 500 and kept >= 0.99 and false <= 0.04


# -- 6: fingerprints -----------------------------------------------------------------------------------------------------------------


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    return groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])


def test_fingerprints_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()] + ODD
    prints = [brute_print(t) for t in texts]
    got = sorted(simhash.near_duplicates(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == brute_components(prints)
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).collect() == []
    assert rows(simhash.near_duplicates(docs(spark, ["a b c d", "a b c d", "q"], [4, 4, None])), "doc_id", "component_id") == [(4, 4), (4, 4), (None, None)]


def test_fingerprints_by_pieces(monkeypatch):
    whole = [simhash.fingerprint((t or "").encode(), k) for t in ODD for k in (1, 2, 3, 9)]
    pieces = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda text: pieces(text, 11))
    assert [simhash.fingerprint((t or "").encode(), k) for t in ODD for k in (1, 2, 3, 9)] == whole


@given(st.binary(max_size=60), st.integers(1, 9))
def test_pieces_keep_words(raw, limit):
    parts = list(simhash.pieces(raw, limit))
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def test_any_doc_ids(spark):
    big = 2**62
    got = rows(simhash.near_duplicates(docs(spark, ["a b c d"] * 3 + ["q"], [big + 6, big + 5, 2**63 - 1, -big])), "doc_id", "component_id")
    assert got == sorted([(big + 6, big + 5), (big + 5, big + 5), (2**63 - 1, big + 5), (-big, -big)], key=repr)


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    points = set()
    for x in rng.integers(0, 2**63, 150, dtype=np.uint64):
        for _ in range(8):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(0, 9)):
                y ^= 1 << int(b)
            points.add(y)
    points |= {(1 << 40) | i for i in range(400)}  # one dense ball
    points = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(i), int(p)) for i, p in enumerate(points.view(np.int64))], "id long, fp long")
    e = simhash.link(df, 3, shard=60, sample=500).collect()
    q, h = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 3)
    norm = lambda u, v: dict(zip(*(x.tolist() for x in spanning_forest(np.array(u), np.array(v)))))
    assert norm([r.u for r in e], [r.v for r in e]) == norm(q, h)


def test_one_doc_id_of_several_texts(spark):
    prints = spark.createDataFrame([(5, 0), (5, 0xFFFFFFFF), (2, 1)], "doc_id long, fp long")
    assert rows(simhash.components(prints), "fp", "component_id") == [(0, 2), (1, 2), (0xFFFFFFFF, 5)]
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    for given, left in (([(5, a), (5, b)], [(5, a), (5, b)]), ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]), ([(5, a), (5, a), (None, a)], [(5, a), (None, a)])):
        df = docs(spark, [t for _, t in given], [i for i, _ in given])
        assert rows(corpus_pipeline.drop_near_duplicates(spark, df, SMALL), "doc_id", "text") == left


# -- 7: secrets -----------------------------------------------------------------------------------------------------------------------


def brute_base(t):
    t, out = t or "", []
    for k, (kind, pattern, least) in enumerate((("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [x for _, _, x in sorted(out)]


SECRET = ["", None, "PassWord = 'abcdefghijkl' x", "é\U0001f600 api_key:\"0123456789abcdef0\"", "token=short", "AKIA" + "Z" * 14 + " login: bob secret=short77", "AKIA" + "Z" * 13, "deadbeef" * 2 + " deadbee", "token=secret=abcdefghijkl", "token=apikey: abcdefghijkl", "user=alice https://h.x/p password=hunter22", "f" * 5000 + " secret : " + "q" * 5000, "x " * 5000 + "user=alice" + " y" * 5000 + "secret=short77"]


def test_secrets_against_brute_force(spark):
    got = {r.doc_id: r for r in secrets.digest(secrets.find_spans(docs(spark, SECRET + ODD))).collect()}
    for i, t in enumerate(SECRET + ODD):
        base = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    assert got[4].spans == "" and got[12].spans == ""  # weak parts alone, or too far apart
    assert {x.split(":")[0] for x in got[10].spans.split(",")} == {"id", "endpoint", "assign"}
    same = docs(spark, [SECRET[2]] * 3, [1, 1, None])
    assert rows(secrets.digest(secrets.find_spans(same)), "doc_id", "n_assign") == [(1, 1), (1, 1), (None, 1)]
    assert secrets.find_spans(same.limit(0)).collect() == []


def linked_spans(t):
    """The rules once more, in plain Python: weak parts count beside what completes them, starts at most 200 apart."""
    sets, value = r"""["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+"
    kinds = [("assign", rf"(?ai:password|passwd|secret|token|api_?key){sets}({value})", 1), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]{16,}", 0),
             ("id", rf"(?:client_?id|access_?key_?id|account|username|user|login){sets}([A-Za-z0-9@_.-]+)", 1), ("endpoint", r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+""", 0), ("opaque", "[A-Za-z0-9+/]{40,}", 0)]
    found = []
    for order, (kind, pattern, group) in enumerate(kinds):
        for m in re.finditer(pattern, t or ""):
            n = len(m[group])
            strong = kind == "assign" and n >= 12 or kind == "access" and n >= 18 or kind == "hex"
            weak = not strong and (kind == "assign" and 6 <= n <= 11 or kind == "id" and n >= 3 or kind == "endpoint" or kind == "opaque" and n == 40)
            part = "id" if kind in ("access", "id") else "secret" if kind != "endpoint" else ""
            found.append((m.start(), order, m.end(), kind, strong, weak, part))
    near = lambda x, part: any(abs(y[0] - x[0]) <= 200 and y[6] == part and (y[4] or y[5]) for y in found)
    needs = {"assign": ("id",), "opaque": ("id",), "id": ("secret",), "endpoint": ("id", "secret")}
    kept = [x for x in found if x[4] or x[5] and all(near(x, p) for p in needs[x[3]])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k, *_ in sorted(kept))


def test_linked_spans_against_brute_force(spark):
    rng = np.random.default_rng(8)
    bits = ["user=alice", "USER=bob", "login: 'ann.b'", "client_id=ab", "AKIA" + "Q" * 16, "AKIA" + "Q" * 6, "password=hunter22", 'secret: "abcdefghijklm"', "token=abc", "https://h.x/p?q=1", "s3://bucket/key", "ab12" * 10, "AB12" * 11, "deadbeef" * 2, "\ufdd0", "\ufdd1$1", "é\U0001f600", "x" * 30, "y " * 40, ",", "\n", "api_key=", "=="]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.integers(1, 30))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_spans(docs(spark, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == [linked_spans(t) for t in texts] and sum(map(bool, got.values())) > 200


def test_redaction_behind_a_shuffle(spark, whole_partitions):
    """Rows keep their own spans when the input is planned anew: behind a join and behind a shuffle, adaptive or not."""
    texts = [f"doc {i} password=abcdefgh{i:06d}" if i % 3 == 0 else f"clean {i}" for i in range(3000)]
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        for df in (joined(spark, docs(spark, texts)), docs(spark, texts).repartition("doc_id"), docs(spark, texts).withColumnRenamed("row", "_spans")):
            got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
            assert got == {i: f"doc {i} [SECRET]" if i % 3 == 0 else t for i, t in enumerate(texts)} and secrets.redact(df).columns == df.columns


def test_redaction(spark):
    df = docs(spark, SECRET)
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns and got[1] is None and got[4] == "token=short"
    assert got[2] == "[SECRET]' x" and got[7] == "[SECRET] deadbee" and got[3] == "é\U0001f600 [SECRET]\""
    assert not any(brute_base(t) for t in got.values())


def test_redaction_in_either_case(spark):
    texts = ["USERNAME=alice https://h.x/p PASSWORD=hunter22", "CLIENT_ID: x12 and secret=short77", "user=bob HTTPS://H.X/P password=hunter22", "login=bob1 USERNAME:user=alice secret=short77"]
    got = [r.text for r in secrets.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["[SECRET] [SECRET] [SECRET]", "[SECRET] and [SECRET]", "[SECRET] [SECRET] [SECRET]", "[SECRET] [SECRET] [SECRET]"]


def test_secret_plans_have_no_python(spark):
    for df in (entries.Q["op7_secret_scan"](spark, SMALL), secrets.redact(docs(spark, ["x"]))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# -- 9: packing ------------------------------------------------------------------------------------------------------------------------


def check_packing(pieces, capacity=1024):
    by_doc, bins = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_doc, bins


def test_packing_against_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()] + [*ODD, "<|endoftext|> a", "  lead\n\n tail  ", "it's 12³ ½　ok"]
    slow = Tokenizer.from_file(entries.tokenizer_path())
    got = packing.pack(packing.tokenize_pieces(docs(spark, texts), entries.tokenizer_path()), shard_items=64).collect()
    by_doc, bins = check_packing(got)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        total += len(ids)
    assert len(bins) <= 1.1 * total / 1024 + 2
    assert packing.pack(packing.tokenize_pieces(docs(spark, ["x"]).limit(0), entries.tokenizer_path())).collect() == []
    same = packing.pack(packing.tokenize_pieces(docs(spark, ["a b"] * 3, [1, 1, None]), entries.tokenizer_path())).collect()
    assert len(same) == 3 and len({r.sequence_id for r in same}) == 1 and {r.offset for r in same} == {0, 3, 6}


def test_genetic_packing_is_sound():
    import random

    rng = random.Random(0)
    sizes = [rng.randrange(1, 1024) for _ in range(500)]
    greedy = packing.best_fit([], sorted(range(500), key=lambda i: -sizes[i]), sizes, 1024)
    best = packing.evolve(sizes, 1024, 1, [], 60, 6)
    assert sorted(i for b in best for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 1024 for b in best)
    assert packing.lower_bound(np.array(sizes), 1024) <= len(best) <= len(greedy)
    assert packing._unpack_bins(packing._pack_bins(best, 500)) and packing.lower_bound(np.array([600, 600, 600, 400]), 1024) == 3


def test_genetic_packing_beats_best_fit():
    """Sets of three that fill a bin, which best fit decreasing misses."""
    import random

    for seed in range(6):
        rng, sizes = random.Random(seed), []
        for _ in range(40):
            a = rng.randrange(257, 500)
            b = rng.randrange(257, min(500, 1024 - a - 257))
            sizes += [a, b, 1024 - a - b]
        greedy, best, bound = packing.figures(sizes)
        assert bound == 40 <= best < greedy and best <= 42


def test_replacement_keeps_documents():
    import random

    for seed in range(20):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 600) for _ in range(120)]
        bins = packing.best_fit([], rng.sample(range(120), 120), sizes, 1024)
        after = packing.settle(bins, sizes, 1024, rng, 3)
        assert sorted(i for b in after for i in b) == list(range(120)) and all(0 < sum(sizes[i] for i in b) <= 1024 for b in after)
        assert packing.fitness(after, sizes, 1024) >= packing.fitness(bins, sizes, 1024)


# -- 10: decontamination ---------------------------------------------------------------------------------------------------------------


def test_decontamination_cases(spark):
    item = " ".join(f"q{i}" for i in range(14))
    items = [(1, item), (2, "Short One"), (10, item), (3, None), (4, ""), (None, "no id at all"), (2, "short one")]
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id long, n_words long")
    texts = [*ODD, "x " + item.upper().replace(" ", "-") + " y", "a SHORT, one b short one", "q0 q1 q2 q3 q4 q5 q6 q7 q8", "so no id at all then", LONG + " " + item]
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.digest(decontam.match_benchmark(df, bench)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [got[i][:2] for i in range(len(texts))] == [(0, 0)] * 9 + [(14, 2), (4, 1), (0, 0), (4, 0), (14, 2)]
    assert got[9][2] == sha("1,10") and got[10][2] == sha("2") and got[0][2] == sha("")
    parts = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.digest(decontam.match_benchmark(df, bench, shard_words=12)).collect()}
    assert parts == got
    assert decontam.match_benchmark(df.limit(0), bench).collect() == [] and {r.n_hit for r in decontam.digest(decontam.match_benchmark(df, bench.limit(0))).collect()} == {0}
    cut = {r.doc_id: r.text for r in decontam.decontaminate(df, bench).collect()}
    assert 9 not in cut and 10 not in cut and cut[13].startswith("w0 ") and "q0" not in cut[13] and cut[0] is None and cut[6] == ODD[6]
    assert decontam.decontaminate(df, bench).columns == df.columns


@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9)), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"q"]), max_size=25), st.integers(1, 5))
@settings(max_examples=500, deadline=None)
def test_automaton_against_brute_force(items, words, window):
    hit, names = set(), set()
    for name, item in items:
        n = min(len(item), window)
        for a in range(len(item) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == item[a : a + n]:
                    hit |= set(range(i, i + n))
                    names.add(name)
    spans, found, n = decontam.SuffixAutomaton(items, window).scan(iter(words))
    assert {j for s, e in spans for j in range(s, e)} == hit and found == names - {None} and n == len(words)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_shards_behind_a_shuffle(spark):
    """One shard or several, behind a join and behind a shuffle: every row, each with its own items."""
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(11))) for k in range(40)], "item_id long, text string")
    texts = [" ".join(["some text", *(f"w{i % 57}x{j}" for j in range(11)), f"end {i}"]) for i in range(1500)]
    want = [(i, 11, 1, hashlib.sha256(str(i % 57).encode()).hexdigest()) if i % 57 < 40 else (i, 0, 0, hashlib.sha256(b"").hexdigest()) for i in range(1500)]
    for df in (joined(spark, docs(spark, texts)), docs(spark, texts).repartition("doc_id")):
        for shard in (1_000_000, 60):
            got = rows(decontam.digest(decontam.match_benchmark(df, bench, shard_words=shard)), "doc_id", "n_hit", "n_items", "items_sha256")
            assert got == sorted(want, key=repr)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(joined(spark, docs(spark, texts)), bench, max_coverage=0.9, shard_words=60).collect()}
    assert all(cut[i] == (f"some text  end {i}" if i % 57 < 40 else texts[i]) for i in range(1500))


# -- pipeline -----------------------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    """Stage by stage, each on what the one before kept; the classifier's own scores decide the first."""
    at = "/root/testdata/sf0.01"
    start = spark.read.parquet(f"{at}/documents.parquet")
    kept = [start]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], at)
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    tables = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    assert all(k.columns == start.columns for k in kept[:-1])
    good = {r.doc_id for r in entries.Q["op8_quality_classifier"](spark, at).where("predicted = 1").collect()}
    assert tables[1] == {i: t for i, t in tables[0].items() if i in good}
    ids = sorted(tables[1])
    prints = np.array([brute_print(tables[1][i]) for i in ids], np.uint64)
    u, v = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 3)
    later = set(spanning_forest(u, v)[0].tolist())
    assert set(tables[2]) == {i for k, i in enumerate(ids) if k not in later}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect() if (w := words(r.text)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    for i, t in tables[2].items():
        w = words(t)
        hit = {j for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for j in range(s, s + n)}
        if 2 * len(hit) > len(w):
            assert i not in tables[3]
        else:
            assert words(tables[3][i]) == [x for j, x in enumerate(w) if j not in hit] and (hit or tables[3][i] == t)
    for i, t in tables[3].items():
        assert not brute_base(tables[4][i]) and (brute_base(t) or "[SECRET]" in tables[4][i] or tables[4][i] == t)
    by_doc, _ = check_packing(kept[-1].collect())
    assert set(by_doc) == set(tables[4])
    assert all(r.n_chars == len(r.text or "") for r in kept[4].collect())


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_tables(spark, number):
    """Nulls, empty, blank and long texts, ties, repeated rows, an empty table, columns whose names operators use."""
    name, stage = corpus_pipeline.STAGES[number]
    texts = [*ODD, None, "user=alice password=hunter22 " * 3]
    clash = "doc_id long, text string, lang string, source string, n_chars int, score double, _row long, _doc string, _spans string, row long, fp long, component long, h long, y int, x string, _n_words long, _one int"
    data = [(i if i != 3 else None, t, "en", None, None if i == 4 else 7, 0.5, 1, "d", "s", 2, 3, 4, 5, 6, "x", 8, 9) for i, t in enumerate(texts)]
    data += [data[7], data[7], (None, None, *data[0][2:])]
    df = spark.createDataFrame(data, clash)
    out = stage(spark, df, SMALL)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got, key = out.collect(), lambda r: (r.doc_id, r.text)
    others = lambda r: tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars"))
    given = {others(r) for r in df.collect()}
    assert all(others(r) in given for r in got)
    if name == "near_duplicates":
        assert sorted(map(repr, map(key, got))) == sorted(map(repr, [(0, None), (None, "one"), (4, "Two words"), (5, LONG), (6, ODD[6]), (7, ODD[7]), (10, texts[10]), (None, None)]))
    if name in ("decontamination", "secrets"):
        assert len(got) == len(data) and all(r.n_chars == len(r.text or "") for r in got)
        assert Counter(map(key, got)) - Counter((d[0], d[1]) for d in data) == ({} if name == "decontamination" else {(10, "[SECRET] [SECRET] " * 3): 1})
    assert stage(spark, df.limit(0), SMALL).collect() == []


def test_packing_stage_on_odd_tables(spark):
    df = docs(spark, [*ODD, ODD[7]], [None, *range(7), 6, 6]).withColumnRenamed("n", "sequence_id").withColumnRenamed("k1", "length")
    out = corpus_pipeline.pack_sequences(spark, df, SMALL)
    first = out.where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in first} == {None: 1, **{i: 1 for i in range(6)}, 6: 3}
    assert corpus_pipeline.pack_sequences(spark, df.limit(0), SMALL).collect() == []
