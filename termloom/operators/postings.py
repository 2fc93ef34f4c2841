"""From documents to postings, lexicon, document statistics and posting blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import codes, text
from termloom.plans.materialize import with_carried, written

BLOCK = codes.BLOCK


def tokens(docs: DataFrame, tokenizer: str = "alnum", key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, term: a row for each token."""
    late = text.LOWERED_LAST.get(tokenizer)
    runs = docs.select(F.col(key).alias("doc_id"), F.explode((late or text.TOKENIZERS[tokenizer])(F.col(column))).alias("term"))
    return runs.select("doc_id", F.lower("term").alias("term")) if late else runs


def positions(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, pos, term: the alphanumeric runs of each word between blanks, lowered; a word may hold several."""
    worded = docs.select(F.col(key).alias("doc_id"), F.posexplode(text.words(F.col(column))).alias("pos", "word"))
    return worded.select("doc_id", F.col("pos").cast("long").alias("pos"), F.explode(text.alnum_runs(F.col("word"))).alias("term")).select("doc_id", "pos", F.lower("term").alias("term"))


def postings(docs: DataFrame, tokenizer: str = "alnum", key: str = "doc_id", column: str = "text") -> DataFrame:
    """term, doc_id, freq. A filter on term moves below both steps of the count, down to the tokens."""
    return tokens(docs, tokenizer, key, column).groupBy("term", "doc_id").agg(F.count("*").alias("freq"))


def whole_postings(docs: DataFrame, tokenizer: str = "alnum", key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows of postings(), for what reads them all: texts are dealt by document and counted where they lie, so that no
    posting is shuffled for its count. A filter on term doesn't move below this one."""
    first = text.PATTERNS[tokenizer][0]
    dealt = docs.select(F.col(key).alias("doc_id"), (first(F.col(column)) if first else F.col(column)).alias("text")).where("text is not null")
    find = text.finder(tokenizer)

    def count(batches):
        terms, keys, freqs, held, last = [], [], [], Counter(), None

        def close():
            terms.extend(held.keys())
            freqs.extend(held.values())
            keys.extend([last] * len(held))
            held.clear()

        kind = None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(keys, kind), pa.array(freqs, pa.int64())], ["term", "doc_id", "freq"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != last:
                    close()
                    last = k
                    if len(terms) > 100_000:
                        yield made()
                        terms, keys, freqs = [], [], []
                held.update(find(t.as_py()))
        close()
        if terms:
            yield made()

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(count, f"term string, doc_id {kind}, freq long")


def lexicon(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def document_lengths(docs: DataFrame, key: str = "doc_id", column: str = "text", url: bool = False) -> DataFrame:
    """doc_id, doc_len: words between blanks, and one for an address where documents start with one."""
    return docs.select(F.col(key).alias("doc_id"), (text.word_count(F.col(column)) + int(url)).alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long")
    return lengths.agg(F.count("*").alias("n_docs"), total.alias("total_len"), F.floor(F.sum("doc_len") / F.count("*")).cast("long").alias("avg_len"))


def document_info(docs: DataFrame, tokenizer: str = "alnum", key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, word_count, distinct_words, each within its row."""
    words = text.TOKENIZERS[tokenizer](F.col(column))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), words.alias("w")).select("doc_id", count(F.col("w")).alias("word_count"), count(F.array_distinct("w")).alias("distinct_words"))


def posting_lists(posts: DataFrame) -> DataFrame:
    """term, df, doc_ids, freqs in order of doc_id: a list for each term, for lexica whose longest list fits a row.

    block_lists holds lists of any length, 64 postings to a row."""
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "freq")))
    return posts.groupBy("term").agg(F.count("*").alias("df"), pairs.alias("p")).select("term", "df", F.col("p.doc_id").alias("doc_ids"), F.col("p.freq").alias("freqs"))


def _cut(batches):
    """Sorted postings as rows of at most 64 of one term: _range, term, _k (the postings of the term before, in this range),
    _pre (the doc_id before, in this range), n, last, doc_ids, freqs."""
    part, rest, k0, pre = TaskContext.get().partitionId(), None, 0, None

    def lists(table, final):
        nonlocal rest, k0, pre
        term, ids, freqs = (table.column(i).combine_chunks() for i in range(3))
        n = len(table)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        k = at - np.maximum.accumulate(np.where(new, at, 0))
        run = np.flatnonzero(new)
        k[: run[1] if len(run) > 1 else n] += k0
        starts = np.flatnonzero(new | (k % BLOCK == 0))
        before = pa.array(np.maximum(starts - 1, 0)), pa.array(k[starts] == 0)
        pres = pc.if_else(before[1], pa.scalar(None, ids.type), ids.take(before[0]))
        if k0:
            pres = pa.concat_arrays([pa.array([pre], ids.type), pres.slice(1)])
        if not final:
            cut = int(starts[-1])
            rest, k0, pre = table.slice(cut), int(k[cut]), pres[len(starts) - 1].as_py()
            starts, pres, n = starts[:-1], pres.slice(0, len(starts) - 1), cut
        offsets = pa.array(np.append(starts, n), pa.int32())
        first, last = pa.array(starts), pa.array(np.append(starts[1:], n) - 1)
        sizes = np.diff(np.append(starts, n))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), part), pa.int64()), term.take(first), pa.array(k[starts], pa.int64()), pres, pa.array(sizes, pa.int64()), ids.take(last), pa.ListArray.from_arrays(offsets, ids.slice(0, n)), pa.ListArray.from_arrays(offsets, freqs.slice(0, n))],
            ["_range", "term", "_k", "_pre", "n", "last", "doc_ids", "freqs"],
        )

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 17:
            made = lists(pa.concat_tables(([rest] if rest is not None else []) + [pa.Table.from_batches(held)]), False)
            held, rows = [], 0
            if made.num_rows:
                yield made
    tables = ([rest] if rest is not None else []) + ([pa.Table.from_batches(held)] if held else [])
    if tables and (last := pa.concat_tables(tables)).num_rows:
        yield lists(last, True)


def _lists(posts: DataFrame) -> DataFrame:
    """term, block_no, before (the doc_id before the block in the term's list), doc_ids, freqs from a written table: at most
    64 postings to a row.

    Lists are cut into ranges of (term, doc_id), so that one of any length is spread over tasks; what a range needs of
    earlier ones is a count and a doc_id. Only terms that lie in several ranges have blocks that begin in one and end in
    another: their postings are gathered by block, all others stay where they are."""
    freq = F.col("freq") if "freq" in posts.columns else F.lit(1).cast("long").alias("freq")
    kind = posts.schema["doc_id"].dataType.simpleString()
    dealt = posts.select("term", "doc_id", freq).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    ranges = written(dealt.mapInArrow(_cut, f"_range long, term string, _k long, _pre {kind}, n long, last {kind}, doc_ids array<{kind}>, freqs array<long>"))
    carried = with_carried(ranges, "term", _n=(F.sum("n"), F.sum), _prev=(F.max("last"), F.max))
    at = carried.withColumn("_k", F.col("_k") + F.coalesce("_n", F.lit(0))).withColumn("_pre", F.coalesce("_pre", "_prev"))
    whole = ~F.coalesce("_split", F.lit(False)) | ((F.col("_k") % BLOCK == 0) & (F.col("n") == BLOCK))
    stay = at.where(whole).select("term", F.floor(F.col("_k") / BLOCK).cast("long").alias("block_no"), F.col("_pre").alias("before"), "doc_ids", "freqs")
    loose = at.where(~whole).select("term", "_k", "_pre", "doc_ids", F.posexplode(F.arrays_zip("doc_ids", "freqs")).alias("_i", "_p"))
    loose = loose.select("term", F.floor((F.col("_k") + F.col("_i")) / BLOCK).cast("long").alias("block_no"), F.when(F.col("_i") > 0, F.get("doc_ids", F.col("_i") - 1)).otherwise(F.col("_pre")).alias("_pre"), F.struct(F.col("_p.doc_ids").alias("d"), F.col("_p.freqs").alias("f")).alias("_p"))
    merged = loose.groupBy("term", "block_no").agg(F.min("_pre").alias("_pre"), F.sort_array(F.collect_list("_p")).alias("p"))
    return stay.unionByName(merged.select("term", "block_no", F.when(F.col("block_no") > 0, F.col("_pre")).alias("before"), F.col("p.d").alias("doc_ids"), F.col("p.f").alias("freqs")))


def _single(lists: DataFrame) -> DataFrame:
    """The postings of _lists: term, doc_id, freq, rn, block_no, _inside (the doc_id before in the block), before."""
    each = lists.select("term", "block_no", "before", "doc_ids", F.posexplode(F.arrays_zip("doc_ids", "freqs")).alias("_i", "_p"))
    inside = F.when(F.col("_i") > 0, F.get("doc_ids", F.col("_i") - 1))
    return each.select("term", F.col("_p.doc_ids").alias("doc_id"), F.col("_p.freqs").alias("freq"), (F.col("block_no") * BLOCK + F.col("_i") + 1).alias("rn"), "block_no", inside.alias("_inside"), "before")


def numbered(posts: DataFrame) -> DataFrame:
    """posts with rn, from 1 within each term, and block_no."""
    return _single(_lists(posts)).select(*posts.columns, "rn", "block_no")


def within_blocks(posts: DataFrame) -> DataFrame:
    """numbered with gap: the distance to the posting before in the same block, the first counted from -1 so that it is at least 1."""
    return _single(_lists(posts)).select(*posts.columns, "rn", "block_no", (F.col("doc_id") - F.coalesce("_inside", F.lit(-1))).alias("gap"))


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of an Arrow array of lists, their lists' sizes and the places of the lists' first numbers."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, np.cumsum(sizes) - sizes


def _sizes_of_blocks(batches):
    for b in batches:
        ids, n, first = _flat(b.column(2))
        freqs = _flat(b.column(3))[0]
        before = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
        before[first] = -1
        total = lambda x: pa.array(np.add.reduceat(x, first) if len(x) else x, pa.int64())
        gamma = lambda x: 2 * codes.bit_lengths(x) - 1
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids[first + n - 1], pa.int64()), total(codes.varbyte_lengths(ids)), total(codes.varbyte_lengths(freqs)), total(gamma(ids - before)), total(gamma(freqs))],
            ["term", "block_no", "n", "last_doc_id", "docid_bytes", "freq_bytes", "gap_bits", "freq_bits"],
        )


def blocks(posts: DataFrame) -> DataFrame:
    """term, block_no, n, last_doc_id, and sizes: docid_bytes and freq_bytes absolute in variable bytes, gap_bits and freq_bits in gamma."""
    return block_lists(posts).mapInArrow(_sizes_of_blocks, "term string, block_no long, n long, last_doc_id long, docid_bytes long, freq_bytes long, gap_bits long, freq_bits long")


def block_lists(posts: DataFrame) -> DataFrame:
    """term, block_no, doc_ids, freqs: at most 64 each."""
    return _lists(posts).select("term", "block_no", "doc_ids", "freqs")


def _with_df(lists: DataFrame) -> DataFrame:
    """Block lists with df. A term whose only block isn't full has its size; the others' are summed."""
    several = lists.select("term", "block_no", F.size("doc_ids").cast("long").alias("_n")).where(f"block_no > 0 or _n = {BLOCK}").groupBy("term").agg(F.max("block_no").alias("_last"), F.max_by("_n", "block_no").alias("_n"))
    return lists.join(several, "term", "left").withColumn("df", F.coalesce(F.col("_last") * BLOCK + F.col("_n"), F.size("doc_ids").cast("long"))).select("term", "block_no", "df", "doc_ids", "freqs")


def _payloads(gamma: bool):
    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            df = b.column(2).to_numpy(zero_copy_only=False)
            ids, n, first = _flat(b.column(3))
            freqs = _flat(b.column(4))[0]
            given = ids.copy()
            if gamma:
                given[1:] -= ids[:-1]
                given[first] = ids[first]
            size = np.add.reduceat(codes.varbyte_lengths(given), first)
            tail, held = codes.gamma_bytes(freqs, n) if gamma else (np.zeros(0, np.uint8), np.add.reduceat(codes.varbyte_lengths(freqs), first))
            lead = (b.column(1).to_numpy() == 0).astype(np.int64)
            fixed = lead + (2 if gamma else 3)
            count = fixed + n * (1 if gamma else 2)
            start = np.cumsum(count) - count
            x = np.zeros(count.sum(), np.int64)
            x[start[lead == 1]] = df[lead == 1]
            x[start + lead] = ids[first + n - 1]
            x[start + lead + 1] = 8 * (size + held) if gamma else size
            inside = np.arange(len(ids)) - np.repeat(first, n) + np.repeat(start + fixed, n)
            x[inside] = given
            if not gamma:
                x[start + lead + 2] = held
                x[inside + np.repeat(n, n)] = freqs
            raw, ends = codes.varbyte_bytes(x)
            stops = np.concatenate([[0], ends[start + count - 1]]).tolist()
            raw, tail = raw.tobytes(), tail.tobytes()
            if gamma:
                cuts = np.concatenate([[0], np.cumsum(held)]).tolist()
                out = [raw[a:z] + tail[c:e] for a, z, c, e in zip(stops, stops[1:], cuts, cuts[1:])]
            else:
                out = [raw[a:z] for a, z in zip(stops, stops[1:])]
            extra = [pa.array(n, pa.int64())] if gamma else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *extra, pa.array(out, pa.binary())], ["term", "block_no", *(["n"] if gamma else []), "payload"])

    return pack


def varbyte_blocks(posts: DataFrame) -> DataFrame:
    """term, block_no, payload BINARY: the bytes of an index file, whose blocks of a term follow one another.

    A term's first block starts with df. Each has its last doc_id, the bytes of its doc_ids and of its frequencies, then
    both lists, doc_ids absolute; every number in variable bytes with a stop bit."""
    return _with_df(block_lists(posts)).mapInArrow(_payloads(False), "term string, block_no long, payload binary")


def gamma_blocks(posts: DataFrame) -> DataFrame:
    """term, block_no, n, payload BINARY: like varbyte_blocks, but doc_ids are gaps within the block (the first absolute)
    in variable bytes, frequencies are gamma codes filled up to whole bytes (first bit lowest), and one number holds the
    bits of both lists."""
    return _with_df(block_lists(posts)).mapInArrow(_payloads(True), "term string, block_no long, n long, payload binary")


def _readers(gamma: bool):
    def read(batches):
        for b in batches:
            if not b.num_rows:
                continue
            payloads = b.column("payload").to_pylist()
            held = np.array([len(x) for x in payloads], np.int64)
            base = np.cumsum(held) - held
            raw = np.frombuffer(b"".join(payloads), np.uint8)
            lead = (b.column("block_no").to_numpy() == 0).astype(np.int64)
            fixed = lead + (2 if gamma else 3)
            ends = np.flatnonzero(raw & 128) + 1
            at = np.searchsorted(ends, base, "right")
            if gamma:  # after its numbers a block has bits, whose bytes are taken out
                n = b.column("n").to_numpy()
                cut = ends[at + fixed + n - 1]
                freqs = codes.gamma_numbers(raw, cut, n)
                keep = np.zeros(len(raw) + 1, np.int64)
                np.add.at(keep, base, 1)
                np.add.at(keep, cut, -1)
                x = codes.varbyte_numbers(raw[np.cumsum(keep)[:-1] > 0])[0]
                count = fixed + n
            else:
                x = codes.varbyte_numbers(raw)[0]
                count = np.append(at[1:], len(ends)) - at
                n = (count - fixed) // 2
            start = np.cumsum(count) - count
            first = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(start + fixed, n)
            ids = x[inside]
            if gamma:
                run = np.cumsum(ids)
                ids = run - np.repeat(run[first] - ids[first], n)
            else:
                freqs = x[inside + np.repeat(n, n)]
            offsets = pa.array(np.append(first, n.sum()), pa.int32())
            df = pa.array(x[start], pa.int64(), mask=lead == 0)
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("block_no"), df, pa.array(x[start + lead], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(freqs, pa.int64()))], ["term", "block_no", "df", "last_doc_id", "doc_ids", "freqs"])

    return read


READ = "term string, block_no long, df long, last_doc_id long, doc_ids array<long>, freqs array<long>"


def read_varbyte_blocks(payloads: DataFrame) -> DataFrame:
    """term, block_no, df (null but for the first block), last_doc_id, doc_ids, freqs from varbyte_blocks' payloads."""
    return payloads.select("term", "block_no", "payload").mapInArrow(_readers(False), READ)


def read_gamma_blocks(payloads: DataFrame) -> DataFrame:
    """term, block_no, df (null but for the first block), last_doc_id, doc_ids, freqs from gamma_blocks' payloads."""
    return payloads.select("term", "block_no", "n", "payload").mapInArrow(_readers(True), READ)


def gaps(posts: DataFrame) -> DataFrame:
    """term, doc_id, gap over the whole list, pos; the first is absolute."""
    return _single(_lists(posts)).select("term", "doc_id", (F.col("doc_id") - F.coalesce("_inside", "before", F.lit(0))).alias("gap"), F.col("rn").alias("pos"))


def gap_decode(gapped: DataFrame) -> DataFrame:
    """term, pos, doc_id from gaps: sums within ranges, on top of what earlier ranges of the list add up to."""
    placed = gapped.select("term", "pos", "gap").repartitionByRange("term", "pos").sortWithinPartitions("term", "pos")
    summed = written(placed.mapInArrow(_summed, "_range long, term string, pos long, gap long, _run long"))
    carried = with_carried(summed, "term", _sum=(F.sum("gap"), F.sum))
    return carried.select("term", "pos", (F.col("_run") + F.coalesce("_sum", F.lit(0))).alias("doc_id"))


def _summed(batches):
    """Sorted gaps with _range and _run, the sum of the term's gaps so far in this range."""
    part, term, so_far = TaskContext.get().partitionId(), None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        terms, gap = b.column(0), b.column(2).to_numpy()
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        run = np.cumsum(gap)
        run -= np.repeat(run[first] - gap[first], np.diff(np.append(first, n)))
        if terms[0].as_py() == term:
            run[: first[1] if len(first) > 1 else n] += so_far
        term, so_far = terms[n - 1].as_py(), int(run[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int64()), terms, b.column(1), b.column(2), pa.array(run, pa.int64())], ["_range", "term", "pos", "gap", "_run"])


def frequent_edges(posts: DataFrame, least: int) -> DataFrame:
    """term, doc_id of terms in more than `least` documents. Postings are written, for they are needed several times."""
    held = written(posts.select("term", "doc_id"))
    return held.join(lexicon(held).where(F.col("df") > least).select("term"), "term").select("term", "doc_id")


def term_edges(posts: DataFrame, least: int) -> DataFrame:
    """term, df, pos, gap of those terms."""
    held = written(posts.select("term", "doc_id"))
    often = lexicon(held).where(F.col("df") > least)
    return gaps(held.join(often.select("term"), "term")).join(often, "term").select("term", "df", "pos", "gap")


def from_term(posts: DataFrame, term: str, rows: int = 201) -> DataFrame:
    """The first posting of a term and those that follow in order, whatever their terms; nothing if the term is absent."""
    present = posts.where(F.col("term") == term).limit(1).select(F.lit(True).alias("_there"))
    return posts.where(F.col("term") >= term).join(F.broadcast(present)).drop("_there").orderBy("term", "doc_id").limit(rows).select("term", "doc_id", "freq")


def next_at_least(posts: DataFrame, term: str, least: int | Column) -> DataFrame:
    """term, doc_id: the first posting of a term from a document on."""
    return posts.where((F.col("term") == term) & (F.col("doc_id") >= least)).groupBy("term").agg(F.min("doc_id").alias("doc_id"))
