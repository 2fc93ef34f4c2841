"""Benchmark decontamination: documents stream through a generalised suffix automaton of the benchmark's words.

Cases: null text has no words; an empty item matches nothing; an item of fewer words than a window is one window; a
null item_id marks words but is not listed; repeated items and repeated item_ids are listed once; repeated documents
are judged one by one; with no items nothing is hit; a long text is read a piece at a time; further columns pass
through documents untouched.

Automata are built from at most `shard_words` benchmark words each and lie in flat arrays (measured with a million words,
300,000 of them different: 190 MB in a worker, 45 MB broadcast), so what is broadcast and what a worker holds is bounded
however large the benchmark grows. Beyond one shard documents are
written with a number for each row, pass each shard in turn, and their intervals meet by that number. Items longer than
a shard's bound are cut with an overlap of a window.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.shared import pieces, sliced, stash, text_column

#: Bytes that belong to words, A-Z lowered; all others become blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class SuffixAutomaton:
    """Generalised over all items; transitions by word number.

    A state's first transition stands in arrays, the root's all do; the few states with several keep the rest in a small
    dict. Windows' items are a range of one array for each state of a window's length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.root = array("i")
        self.word, self.to, self.link, self.len = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.names = [name for name, _ in items]
        coded = []
        for k, (_, words) in enumerate(items):
            if words:
                ids = array("i", (self.vocab.setdefault(w, len(self.vocab)) for w in words))
                self.root.extend([-1] * (len(self.vocab) - len(self.root)))
                coded.append((k, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        n = len(self.len)
        states, owners, ends = array("i"), array("i"), {}
        for k, ids in coded:
            s = 0
            for i, w in enumerate(ids):
                s = self._step(s, w)
                if i + 1 >= window:
                    states.append(self._at_length(s, window))
                    owners.append(k)
            if len(ids) < window:
                ends.setdefault(self._at_length(s, len(ids)), []).append((len(ids), k))
        pairs = np.unique(np.array([states, owners], np.int32).T.reshape(-1, 2), axis=0)
        self.owners = array("i", pairs[:, 1].tobytes())
        self.first = array("i", np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype("i").tobytes())
        self.ends = ends
        # of each state, the nearest suffix of a window's length, and the nearest that ends a short item; -1 for none
        self.top, self.short = array("i", [-1]) * n, array("i", [-1]) * n
        for s in np.argsort(np.array(self.len), kind="stable").tolist():
            up = self.link[s]
            if self.len[s] >= window:
                self.top[s] = s if self.len[up] < window else self.top[up]
            self.short[s] = s if s in ends else self.short[up] if up >= 0 else -1

    def _step(self, s: int, w: int) -> int:
        if s == 0:
            return self.root[w]
        if self.word[s] == w:
            return self.to[s]
        m = self.more.get(s)
        return m.get(w, -1) if m else -1

    def _set(self, s: int, w: int, t: int) -> None:
        if s == 0:
            self.root[w] = t
        elif self.word[s] in (-1, w):
            self.word[s], self.to[s] = w, t
        else:
            self.more.setdefault(s, {})[w] = t

    def _new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _at_length(self, s: int, n: int) -> int:
        while self.link[s] >= 0 and self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._new(self.len[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self._step(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self._step(last, w)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        cur = self._new(self.len[last] + 1, 0)
        p = last
        while p >= 0 and self._step(p, w) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            q = self._step(p, w)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return cur

    def scan(self, words: Iterable[bytes]) -> tuple[list[list[int]], set, int]:
        """Word intervals [start, end) inside occurrences of windows, merged; the items they come from; the number of words."""
        root, word, to, more, link, length = self.root, self.word, self.to, self.more, self.link, self.len
        top, short, ends, window, known = self.top, self.short, self.ends, self.window, self.vocab.get
        spans: list[list[int]] = []
        tops, found = set(), set()
        s = n = i = 0
        for i, w in enumerate(map(known, words), 1):
            if w is None:
                s = n = 0
                continue
            while s:
                if word[s] == w:
                    t = to[s]
                    break
                m = more.get(s)
                t = m.get(w, -1) if m else -1
                if t >= 0:
                    break
                s = link[s]
                n = length[s]
            else:
                t = root[w]
            s = t
            n += 1
            size = 0
            if n >= window:
                size = window
                tops.add(top[s])
            k = short[s]
            while k >= 0:
                for a, item in ends[k]:
                    if a <= n:
                        size = max(size, a)
                        found.add(item)
                k = short[link[k]] if k else -1
            if size:
                start = i - size
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])
        for t in tops:
            found.update(self.owners[self.first[t] : self.first[t + 1]])
        return spans, {self.names[k] for k in found} - {None}, i


def shards_of(items: DataFrame, window: int, shard_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in shards of bounded words; the driver holds two at a time."""
    shard, held = [], 0
    for name, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of((text or "").encode())
        step = max(1, shard_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step) if len(words) > shard_words else (0,):
            part = words[at : at + shard_words]
            if held and held + len(part) > shard_words:
                yield shard
                shard, held = [], 0
            shard.append((name, part))
            held += len(part)
    if shard:
        yield shard


def match_benchmark(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 1_000_000) -> DataFrame:
    """docs with n_words long, n_hit long, spans binary (pairs of little-endian int32: word intervals [start, end)), items array<string>.

    Columns of docs with these names are replaced."""
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    found = _matched(docs, items, window, shard_words)
    return found.select(*(F.col("_doc")[c].alias(c) for c in docs.columns), *(F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "spans", "items")))


def _matched(docs: DataFrame, items: DataFrame, window: int, shard_words: int = 1_000_000) -> DataFrame:
    """_doc (a row of docs), _n_words, _n_hit, _spans, _items."""
    spark = docs.sparkSession
    shards = shards_of(items, window, shard_words)
    first, second = next(shards, []), next(shards, None)
    rows, one = docs.select(F.struct(*docs.columns).alias("_doc")), spark.sparkContext.broadcast(SuffixAutomaton(first, window))
    text = F.col("_doc.text").alias("text")
    if second is None:
        return _pass(rows.select("_doc", text), "_doc", one)
    # a written table has one number for each row, whatever is read from it
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = _pass(rows.select("_row", text), "_row", one)
    while second is not None:
        found = _merge(found, _pass(rows.select("_row", text), "_row", spark.sparkContext.broadcast(SuffixAutomaton(second, window))))
        second = next(shards, None)
    return rows.join(found, "_row").drop("_row")


def hits(spans: Iterable[list[int]]) -> int:
    return sum(e - s for s, e in spans)


def _pass(docs: DataFrame, kept: str, automaton) -> DataFrame:
    """A column of docs with what one automaton finds in text."""
    names = ["_n_words", "_n_hit", "_spans", "_items"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.StringType())]
    schema = T.StructType([docs.schema[kept]] + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        for batch in sliced(batches):
            counts, hit, spans, items = [], [], [], []
            for text in text_column(batch, "text"):
                found, from_, n = auto.scan(w for piece in pieces(text.translate(TABLE)) for w in piece.split()) if len(text) > 1 << 20 else auto.scan(words_of(text))
                counts.append(n)
                hit.append(hits(found))
                spans.append(np.array(found, "<i4").tobytes())
                items.append(sorted(from_))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[kept, *names])

    return docs.select(kept, "text").mapInArrow(scan, schema)


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("_row", F.col("_spans").alias("_s"), F.col("_items").alias("_i")), "_row")
    both = both.withColumn("_u", _union_spans("_spans", "_s"))
    return both.select("_row", "_n_words", F.col("_u.n").alias("_n_hit"), F.col("_u.spans").alias("_spans"), F.array_sort(F.array_union("_items", "_i")).alias("_items"))


def _union_spans(a: str, b: str) -> Column:
    @F.pandas_udf("n long, spans binary")
    def union(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y):
            spans: list[list[int]] = []
            for s, e in sorted(np.frombuffer(p + q, "<i4").reshape(-1, 2).tolist()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            out.append((hits(spans), np.array(spans, "<i4").tobytes()))
        return pd.DataFrame(out, columns=["n", "spans"])

    return union(a, b)


def digest(matched: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    got = matched.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return got.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, shard_words: int = 1_000_000) -> DataFrame:
    """docs without the words inside benchmark windows; documents of which more than max_coverage is hit are dropped."""
    matched = _matched(docs, items, window, shard_words)
    schema = T.StructType(list(docs.schema.fields))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = pa.table(batch.column(0).flatten(), names=names)
            spans = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in batch.column(3).to_pylist()]
            keep, texts = [], []
            for k, (text, cuts, n, hit) in enumerate(zip(rows.column("text").to_pylist(), spans, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if hit > max_coverage * n:
                    continue
                keep.append(k)
                texts.append(_without(text, cuts) if len(cuts) else text)
            rows = rows.take(pa.array(keep, pa.int64()))
            kind = rows.schema.field("text")
            yield from rows.set_column(names.index("text"), kind, pa.chunked_array([pa.array(texts, kind.type)])).combine_chunks().to_batches()

    return matched.mapInArrow(cut, schema)


def _without(text: str, cuts: np.ndarray) -> str:
    raw = text.encode()
    plain = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in cuts:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode()
