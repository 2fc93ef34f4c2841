"""Substring dedup: Rabin-Karp hashes of every window of `window` words; repeated windows merge into removal intervals.

Counting every window's hash in a shuffle costs several times the text. So three scans share the work, without loss:

1. Each window has a smallest `gram`-word hash, the same wherever its words stand. Occurrences of such smallest grams
   (about a tenth of the windows) are counted in hash ranges; a gram that occurs once rules out all its windows.
2. Grams that occur again set bits in a map of at most `max_bits` bits, whatever the corpus' size (beyond that it only
   lets more windows through). Windows whose gram is set are grouped by 96-bit hash: first within a task, so that a
   passage in a third of all documents leaves each task once, then across tasks, in buckets by gram or, for grams that
   many tasks report, by window. There are as many buckets as the corpus has `bucket_bytes` of text.
3. Repeated windows come back as word intervals by document and cut the text.

Cases: null text has no words; texts shorter than a window keep all; a long text is read in parts that overlap by a
window; rows equal in doc_id and text get the same result, and count as two places; null doc_ids are kept; an empty
table gives no rows; further columns are ignored. Windows of any length may be asked for. They are compared by two
Rabin-Karp hashes with different bases, 64 bits of one and 32 of the other: of n windows about n*n/2^97 pairs may collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import parallelism, pieces, sliced, stash, text_column

BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: A gram is dealt by window where this share of the parts that tasks send, and at least so many, hold it.
HOT_SHARE, HOT_LEAST, HOT_BITS = 2, 8, 20


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Powers:
    """Powers of both bases and of their inverses, mod 2^64."""

    up = down = np.ones((2, 1), np.uint64)

    @classmethod
    def of(cls, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.shape[1] < n:
            m = max(n, 1 << 18)
            rows = lambda bases: np.array([np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in bases])
            cls.up, cls.down = rows(BASES), rows([pow(b, -1, 1 << 64) for b in BASES])
        return cls.up[which, :n], cls.down[which, :n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def rolling(words: np.ndarray, n: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp hashes of all runs of n words."""
    up, down = Powers.of(len(words) + 1)
    if prefix is None:
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    m = len(words) - n + 1
    return mix((prefix[n:] - prefix[:m]) * down[:m]) if m > 0 else np.zeros(0, np.uint64)


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n neighbours, in log n passes."""
    size, y = 1, x
    while 2 * size <= n:
        y = op(y[:-size], y[size:])
        size *= 2
    return op(y[: len(x) - n + 1], y[n - size :][: len(x) - n + 1]) if size < n else y


class Windows:
    """Of a block of texts: window hashes, each window's smallest gram, and the grams' occurrences that are smallest somewhere."""

    def __init__(self, parts: list[list[bytes]], cache: WordHashes, window: int, gram: int):
        gram = min(gram, window)
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.window, total = window, int(self.sizes.sum())
        m = total - window + 1
        self.doc = np.repeat(np.arange(len(parts)), self.sizes)
        if m <= 0 or not (self.sizes >= window).any():
            self.valid = np.zeros(0, bool)
            self.low = self.grams = np.zeros(0, np.uint64)
            return
        self.words = np.fromiter((h for p in parts for h in map(cache.__getitem__, p)), np.uint64, total)
        self.prefix = self._prefix(self.words, 0)
        self.valid = self.doc[:m] == self.doc[window - 1 :]
        g = rolling(self.words, gram, self.prefix)
        width = window - gram + 1
        self.low = sliding(g, width, np.minimum)
        padded = np.zeros(len(g) + width - 1, np.uint64)
        padded[width - 1 : width - 1 + m] = np.where(self.valid, self.low, 0)
        self.grams = g[(sliding(padded, width, np.maximum) == g) & (g > 0)]

    @staticmethod
    def _prefix(words: np.ndarray, which: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * Powers.of(len(words) + 1, which)[0][: len(words)])])

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes (of the second the upper half) of the windows that begin at these words."""
        other = mix(self.words ^ np.uint64(BASES[1]))
        pair = ((self.prefix, 0), (self._prefix(other, 1), 1))
        one, two = (mix((p[at + self.window] - p[at]) * Powers.of(len(p), which)[1][at]) for p, which in pair)
        return one, (two >> np.uint64(32)).astype(np.uint32)


def portions(batches: Iterator[pa.RecordBatch], window: int, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """A batch, rows of it, the number of the first word, and words: parts of texts, together of about `limit` bytes. Parts
    of a long text overlap by a window less a word, so each window is whole in just one."""
    for batch in sliced(batches, limit, 4000):
        rows, starts, parts, held = [], [], [], 0

        def take() -> tuple:
            out = batch, np.array(rows, np.int64), np.array(starts, np.int64), parts
            return out

        for k, text in enumerate(text_column(batch, "text")):
            at, tail = 0, []
            for piece in pieces(text, limit):
                words = tail + piece.split()
                rows.append(k)
                starts.append(at)
                parts.append(words)
                held += len(piece)
                tail = words[max(0, len(words) - window + 1) :]
                at += len(words) - len(tail)
                if held >= limit:
                    yield take()
                    rows, starts, parts, held = [], [], [], 0
        if rows:
            yield take()


def repeated_grams(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """n, grams binary (sorted uint64), hot binary (those that many tasks' parts hold): smallest grams that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size = WordHashes(), [], 0

        def flush():
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(grams, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
            rows = list(zip(np.split(grams, cut), np.split(times > 1, cut)))
            return pa.record_batch([pa.array(range(buckets), pa.int32()), pa.array([g.tobytes() for g, _ in rows], pa.binary()), pa.array([np.packbits(t).tobytes() for _, t in rows], pa.binary())], names=["bucket", "grams", "again"])

        for *_, parts in portions(batches, window):
            held.append(Windows(parts, cache, window, gram).grams)
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, again = [], []
        for batch in batches:
            for g, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                grams.append(np.frombuffer(g, "<u8"))
                again.append(np.unpackbits(np.frombuffer(t, np.uint8), count=len(grams[-1])))
        if grams:
            found, inv, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            twice = (times > 1) | (np.bincount(inv, np.concatenate(again), len(found)) > 0)
            hot = times >= max(HOT_LEAST, len(grams) / HOT_SHARE)
            yield pa.record_batch([pa.array([int(twice.sum())], pa.int64()), pa.array([found[twice].tobytes()], pa.binary()), pa.array([found[hot].tobytes()], pa.binary())], names=["n", "grams", "hot"])

    dealt = docs.select("text").mapInArrow(count, "bucket int, grams binary, again binary").repartitionById(buckets, "bucket")
    return stash(dealt.mapInArrow(reduce, "n long, grams binary, hot binary"))


def gram_bits(grams: DataFrame, column: str, power: int) -> np.ndarray:
    """A bit for each range of hashes, 2 ** power in all."""
    shift = 64 - power

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                at = np.frombuffer(g, "<u8") >> np.uint64(shift)
                byte, inv = np.unique(at >> np.uint64(3), return_inverse=True)
                bits = np.zeros(len(byte), np.uint8)
                np.bitwise_or.at(bits, inv, np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                yield pa.record_batch([pa.array([byte.astype("<u4").tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(1 << (power - 3), np.uint8)
    for row in grams.select(column).mapInArrow(positions, "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(row["at"], "<u4")] |= np.frombuffer(row["bits"], np.uint8)
    return out


def is_set(map_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = grams >> np.uint64(64 - (len(map_) * 8 - 1).bit_length())
    return (map_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def repeats(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of hashes occur more than once, and of each such pair one place."""
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    twice = np.zeros(len(one), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    starts = np.concatenate([[True], ~same]) if len(one) else np.zeros(0, bool)
    return twice, order[starts & twice[order]]


def spans_of(doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of merged intervals, from windows sorted by doc and start."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(doc) else first
    return doc[first], start[first], start[last] + window


PARTS = ["bucket", "hashes", "others", "ones", "other_ones", "doc", "start", "k1", "k2", "sk1", "sk2", "spans"]


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 16, max_bits: int = 1 << 29, bucket_bytes: int = 16 << 20) -> DataFrame:
    """k1 long, k2 int (of doc_id and text), spans binary: pairs of int32, word intervals of repeated windows. A row for each document that has any."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parallelism(spark), -(-size // bucket_bytes))
    grams = repeated_grams(docs, window, gram, n)
    total = grams.agg(F.sum("n")).first()[0] or 0
    power = min(max_bits.bit_length() - 1, max(16, (32 * total - 1).bit_length()))
    maps = spark.sparkContext.broadcast((gram_bits(grams, "grams", power), gram_bits(grams, "hot", HOT_BITS)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket, as columns of bytes: hashes sent with their place, hashes that are known as repeated here. Places known
        as repeated go along in any bucket, for nothing is to be decided about them."""
        cache, (again, hot) = WordHashes(), maps.value
        held, k1, k2, docs_held, total, turn = [], [], [], 0, 0, TaskContext.get().partitionId()

        def flush():
            one, two, bucket, doc, start = (np.concatenate(x) for x in zip(*held))
            key1, key2 = np.concatenate(k1), np.concatenate(k2)
            known, ones = repeats(one, two)
            alone = np.flatnonzero(~known)
            alone = alone[np.lexsort((start[alone], doc[alone], bucket[alone]))]
            edges = np.searchsorted(bucket[alone], np.arange(n + 1))
            ones = ones[np.argsort(bucket[ones], kind="stable")]
            one_edges = np.searchsorted(bucket[ones], np.arange(n + 1))
            here = np.flatnonzero(known)
            here = here[np.lexsort((start[here], doc[here]))]
            d, s, e = spans_of(doc[here], start[here], window)
            spans = np.unique(np.array([key1[d], key2[d], s, e], np.int64).T.reshape(-1, 4), axis=0)  # equal rows say the same
            rows, size = [], -(-len(spans) // n)
            for b in range(n):
                k = (b - turn) % n * size
                at, of, mine = alone[edges[b] : edges[b + 1]], ones[one_edges[b] : one_edges[b + 1]], spans[k : k + size]
                if len(at) or len(of) or len(mine):
                    names, local = np.unique(doc[at], return_inverse=True)
                    rows.append((b, one[at].tobytes(), two[at].tobytes(), one[of].tobytes(), two[of].tobytes(), np.diff(local, prepend=0).astype("<i4").tobytes(), np.diff(start[at], prepend=0).astype("<i4").tobytes(), key1[names].tobytes(), key2[names].tobytes(), mine[:, 0].tobytes(), mine[:, 1].astype("<i4").tobytes(), mine[:, 2:].astype("<i4").tobytes()))
            return pa.record_batch([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names=PARTS)

        for batch, rows, starts, parts in portions(batches, window):
            w = Windows(parts, cache, window, gram)
            if not len(w.valid):
                continue
            take = np.flatnonzero(w.valid & is_set(again, w.low))
            if not len(take):
                continue
            doc, low, (one, two) = w.doc[take], w.low[take], w.hashes(take)
            bucket = mix(np.where(is_set(hot, low), one, low)) % np.uint64(n)
            held.append((one, two, bucket.astype(np.int32), docs_held + doc, take - w.first[doc] + starts[doc]))
            k1.append(batch.column(0).to_numpy()[rows])
            k2.append(batch.column(1).to_numpy()[rows])
            docs_held += len(parts)
            total += len(take)
            if total > 600_000:
                yield flush()
                held, k1, k2, docs_held, total, turn = [], [], [], 0, 0, turn + 1
        if total:
            yield flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        if not rows:
            return
        every = (np.concatenate([np.frombuffer(r[k], kind) for k in at for r in rows]) for at, kind in (((0, 2), "<u8"), ((1, 3), "<u4")))
        twice, _ = repeats(*every)
        at, out = 0, []
        for r in rows:
            again = twice[at : at + len(r[0]) // 8]
            at += len(again)
            local, start = (np.cumsum(np.frombuffer(x, "<i4")) for x in r[4:6])
            d, s, e = spans_of(local[again], start[again], window)
            out.append(np.array([np.frombuffer(r[6], "<i8")[d], np.frombuffer(r[7], "<i4")[d], s, e], np.int64).T)
            out.append(np.column_stack([np.frombuffer(r[8], "<i8"), np.frombuffer(r[9], "<i4"), np.frombuffer(r[10], "<i4").reshape(-1, 2)]).astype(np.int64))
        found = np.unique(np.concatenate(out), axis=0)
        to = (mix(found[:, 0].astype(np.uint64)) % np.uint64(n)).astype(np.int32)
        found = found[np.argsort(to, kind="stable")]
        edges = np.searchsorted(np.sort(to), np.arange(n + 1))
        some = np.flatnonzero(np.diff(edges))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([found[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "found"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, from what all buckets found in it."""
        parts = [np.frombuffer(x, "<i8").reshape(-1, 4) for batch in batches for x in batch.column(1).to_pylist()]
        if parts:
            found = np.unique(np.concatenate(parts), axis=0)
            yield _by_doc(found[:, 0], found[:, 1].astype(np.int32), found[:, 2:].astype("<i4"))

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "text")
    sent = keyed.mapInArrow(candidates, "bucket int, " + ", ".join(f"{x} binary" for x in PARTS[1:]))
    found = sent.repartitionById(n, "bucket").mapInArrow(decide, "bucket int, found binary")
    return found.repartitionById(n, "bucket").mapInArrow(gather, "k1 long, k2 int, spans binary")


def _by_doc(k1: np.ndarray, k2: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    edges = [0, *(np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1).tolist(), len(k1)] if len(k1) else [0]
    at = edges[:-1]
    return pa.record_batch([pa.array(k1[at], pa.int64()), pa.array(k2[at], pa.int32()), pa.array([spans[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary())], names=["k1", "k2", "spans"])


def deduplicate(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, by one blank)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(docs, window)
    keyed = docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash("text", "doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for text, found in zip(text_column(batch, "text"), batch.column(2).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if found:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s, e in np.frombuffer(found, "<i4").reshape(-1, 2):
                        gone[s] += 1
                        gone[e] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    words = [w for w, k in zip(words, stay.tolist()) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
