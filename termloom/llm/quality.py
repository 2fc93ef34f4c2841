"""Quality: random-indexing word vectors, pooled by document, and a two-layer numpy network with calibrated probabilities.

Random indexing (Kanerva et al., 2000): each word, hashed to a row, has a sparse ternary index vector; its context
vector sums its neighbours' index vectors over the whole corpus, and likewise for runs of punctuation among
themselves. Context sums are integers, added up by blocks of rows. A document is the mean and spread of its words'
vectors and the mean of its marks', with three shares (marks a word, words like the one before, length). The network
is fitted on at most `bound` labelled rows of the learning folds (documented bound: 6,000), a fifth of which only
sets the temperature. Every text is read whole, in runs of bounded size, so a text of any length needs no more memory.

Cases: null and empty texts pool to zeros and get a score; a null doc_id is not learned from and is scored; labels of
a document that differ count as the largest; rows of equal doc_id and text are learned from once and scored one by
one; where all labels are alike every score is that label (1 or 0), and with no label at all 1, for then nothing is
known against any text; an empty table gives no rows; further columns pass through (one named score is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.features import LETTERS, MARKS, chosen_keys, features_of, fold, labelled
from termloom.llm.shared import packed_sums, pieces, sliced, summed, text_column

FOLDS, HELD = 4, 2
ROWS, DIM, NONZERO, CHUNK = 8192, 64, 4, 512


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) % ROWS
        return value


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each row's index vector."""
    rng = np.random.default_rng(8)
    return rng.permuted(np.tile(np.arange(DIM), (ROWS, 1)), axis=1)[:, :NONZERO].copy(), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def runs(texts: list[bytes], table: bytes, cache: Buckets, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, text's number) of all tokens in order, in runs of about `limit` bytes: a long text goes on from run to run."""
    held, owners, size = [], [], 0

    def packed() -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(p) for p in held]
        return np.fromiter((b for p in held for b in map(cache.__getitem__, p)), np.int64, sum(sizes)), np.repeat(owners, sizes)

    for k, text in enumerate(texts):
        for piece in pieces(text.translate(table), limit):
            tokens = piece.split()
            if tokens:
                held.append(tokens)
                owners.append(k)
            size += len(piece)
            if size >= limit and held:
                yield packed()
                held, owners, size = [], [], 0
    if held:
        yield packed()


def add_contexts(total: np.ndarray, texts: list[bytes], reach: int, cache: Buckets, places: np.ndarray, signs: np.ndarray, limit: int = 1 << 20) -> None:
    """Add to total (ROWS * DIM) the index vectors of each token's neighbours up to `reach` away."""
    for table in (LETTERS, MARKS):
        tail = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for run in runs(texts, table, cache, limit):
            before = len(tail[0])  # the last tokens of the run before, each a neighbour of new ones
            ids, owner = (np.concatenate(x) for x in zip(tail, run))
            for k in range(1, reach + 1):
                at = np.arange(max(before, k), len(ids))
                at = at[owner[at] == owner[at - k]]
                a, b = ids[at], ids[at - k]
                for x, y in ((a, b), (b, a)):
                    for j in range(NONZERO if len(x) else 0):
                        total += np.bincount(x * DIM + places[y, j], signs[y, j], ROWS * DIM)
            tail = ids[-reach:], owner[-reach:]


def context_vectors(docs: DataFrame, reach: int = 2) -> np.ndarray:
    """Unit context vectors, ROWS x DIM: of one size for any corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (places, signs) = Buckets(), index_vectors()
        total = np.zeros(ROWS * DIM)
        for batch in sliced(batches):
            add_contexts(total, text_column(batch, "text"), reach, cache, places, signs)
        if total.any():
            yield pa.record_batch([pa.array(range(ROWS // CHUNK), pa.int32()), pa.array(map(packed_sums, total.reshape(-1, CHUNK * DIM)), pa.binary())], names=["chunk", "sums"])

    out = summed(docs.select("text").mapInArrow(add, "chunk int, sums binary"), ROWS // CHUNK, CHUNK * DIM).astype(float)
    vectors = out.reshape(ROWS, DIM)
    return (vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, cache: Buckets, limit: int = 1 << 18) -> np.ndarray:
    """A row of features for each text."""
    n = len(texts)
    sums, counts, again = np.zeros((n, 3 * DIM)), np.zeros((2, n)), np.zeros(n)
    for kind, (at, table) in enumerate(((0, LETTERS), (2 * DIM, MARKS))):
        last = (-1, -1)
        for ids, owner in runs(texts, table, cache, limit):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            text = owner[first]
            counts[kind, text] += np.diff(first, append=len(ids))
            own = vectors[ids]
            sums[text, at : at + DIM] += np.add.reduceat(own, first, axis=0)
            if kind == 0:
                sums[text, DIM : 2 * DIM] += np.add.reduceat(own * own, first, axis=0)
                same = np.concatenate([[last == (owner[0], ids[0])], (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])])
                again[text] += np.add.reduceat(same.astype(np.float64), first)
                last = owner[-1], ids[-1]
    words, marks = np.maximum(counts, 1)
    mean = sums[:, :DIM] / words[:, None]
    spread = np.sqrt(np.maximum(sums[:, DIM : 2 * DIM] / words[:, None] - mean * mean, 0))
    shares = [np.log1p(counts[1] / words), again / words, np.log1p(counts[0])]
    return np.column_stack([mean, spread, sums[:, 2 * DIM :] / marks[:, None], *shares]).astype(np.float32)


class Network:
    """tanh layer, then a logit; Adam on log loss; a temperature from rows kept apart."""

    def __init__(self, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11):
        self.hidden, self.epochs, self.batch, self.rate, self.decay, self.seed = hidden, epochs, batch, rate, decay, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        apart, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z, step = (x - self.mean) / self.scale, 0
        for _ in range(self.epochs):
            rng.shuffle(used)
            for k in range(0, len(used), self.batch):
                at = used[k : k + self.batch]
                step += 1
                h = np.tanh(z[at] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[at]) / len(at)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[at].T @ back + self.decay * w[0], back.sum(axis=0), h.T @ d + self.decay * w[2], np.array([d.sum()])]
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] -= self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logits, truth = self.logits(x[apart]), y[apart]
        if len(apart) and 0 < truth.sum() < len(truth):
            grid = np.geomspace(0.5, 5, 47)
            self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -(2 * truth - 1) * logits / t).mean()))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> tuple[np.ndarray, Network | float]:
    """Context vectors, and the network or, where labels are all alike, every text's score."""
    vectors = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make(texts: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in pooled(texts, shared.value, Buckets())]

    given = labelled(labels, "quality", fold("doc_id", FOLDS) != HELD)
    rows = features_of(docs, chosen_keys(docs, given, bound), make)
    y = np.array([r[2] for r in rows], float)
    if not 0 < (y == 1).sum() < len(y):
        return vectors, float((y == 1).all())  # true of no labels, too
    return vectors, Network().fit(np.array([np.frombuffer(r[3], np.float32) for r in rows], np.float64), y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | float]) -> DataFrame:
    """docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (vectors, network) = Buckets(), shared.value
        for part in sliced(batches):
            x = np.full(part.num_rows, network) if isinstance(network, float) else network.scores(pooled(text_column(part, "text"), vectors, cache))
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(x)], names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())]))


def digest(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
