"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) of a numpy classifier.

Confirmed toxic documents are the positives; a sample of texts, whatever their labels, is the unlabelled set. The
risk is prior * R+(positives as 1) + max(0, R-(unlabelled as 0) - prior * R-(positives as 0)), descended by Adam on
features of words (selected by their estimated posterior); where the bracket turns negative, its gradient is ascended instead, as published. The class
prior is the share of toxic among the labelled rows of the learning folds.

How often a feature occurs without regard to labels is counted over every text of the learning folds. The weights are
fitted on at most `positives` toxic and `unlabelled` other different texts (documented bounds: 4,000 and 40,000 rows,
of the latter just their used features); every text is scored whole.

Cases: null and empty texts get the bias alone; a null doc_id is not learned from and is scored; rows of equal doc_id
and text are learned from once and scored one by one, different texts of one doc_id share its label; with no toxic label in the learning folds every score is 0; an empty
table gives no rows; a text is read whole, a piece at a time; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.features import LETTERS, chosen_keys, features_of, fold, keyed, labelled
from termloom.llm.shared import packed_sums, pieces, sliced, smallest, summed, text_column

FOLDS = 5


def features(word: bytes, bits: int) -> tuple[int, ...]:
    """Hashed numbers of a word and of its first four and five bytes, which also catch words not seen before. A short
    word has all three as well, so that words weigh alike whatever their length."""
    mask = (1 << bits) - 1
    return tuple(xxhash.xxh32_intdigest(x, seed) & mask for seed, x in ((0, word), (4, word[:4]), (5, word[:5])))


def words(text: bytes) -> set[bytes]:
    """Distinct words, found a piece at a time."""
    found: set[bytes] = set()
    for piece in pieces(text.translate(LETTERS)):
        found.update(piece.split())
    return found


def present(text: bytes, bits: int) -> np.ndarray:
    """Sorted distinct features of a text."""
    return np.unique(np.array([f for w in words(text) for f in features(w, bits)], np.int64))


class Columns(dict):
    """The columns of a word's features, mostly none."""

    def __init__(self, used: np.ndarray, bits: int):
        super().__init__()
        self.bits, self.column = bits, np.full(1 << bits, -1, np.int32)
        self.column[used] = np.arange(len(used))

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = tuple(c for f in features(word, self.bits) if (c := int(self.column[f])) >= 0)
        return value

    def of(self, text: bytes) -> list[int]:
        """A text's columns, found a piece at a time."""
        hits: set[int] = set()
        for piece in pieces(text.translate(LETTERS)):
            hits.update(*filter(None, map(self.__getitem__, piece.split())))
        return sorted(hits)


class NnPU:
    """A linear score on features that are present. Used are those which, by the prior, occur in few
    but toxic texts: an estimated posterior near 1, less the more its count is left to chance."""

    def __init__(self, bits: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 3e-5, least: float = 0.01):
        self.bits, self.prior, self.rounds, self.rate, self.decay, self.least = bits, prior, rounds, rate, decay, least

    def candidates(self, p: np.ndarray, positives: int) -> np.ndarray:
        """Features of enough toxic texts to be judged; p: how many have each."""
        return np.flatnonzero(p >= max(5, self.least * positives))

    def toxic(self, p: np.ndarray, positives: int, u: np.ndarray, texts: int) -> np.ndarray:
        """Whether features are to be used: p of the toxic and u of all texts have them."""
        posterior = self.prior * (p / positives) / ((u + 1) / (texts + 1))
        return posterior >= 0.9 - 0.6 / np.sqrt(np.maximum(p, 1))

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], used: np.ndarray) -> NnPU:
        """From the columns, places in used, of each text."""
        self.used, self.weights, self.bias = used, np.zeros(len(used)), -1.0
        p, u = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(c) for c in x]), len(x)) for x in (positive, unlabelled))
        m = np.zeros(len(used) + 1)
        v = np.zeros(len(used) + 1)
        for step in range(1, self.rounds + 1):
            g = self._gradient(p, u)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]
        return self

    def _risk(self, p, u) -> tuple[float, float]:
        """prior * R+ of positives as 1, and the bracket: R- of unlabelled as 0 less prior * R- of positives as 0."""
        zp, zu = self._score(p), self._score(u)
        return self.prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()

    def _gradient(self, p, u) -> np.ndarray:
        """Of the risk with decay, bias last; where the bracket is negative, of its ascent."""
        zp, zu = self._score(p), self._score(u)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # logistic losses' derivatives: as 1: s - 1, as 0: s
        if self._risk(p, u)[1] >= 0:
            gp, gu = self.prior * (sp - 1) / len(zp) - self.prior * sp / len(zp), su / len(zu)
        else:
            gp, gu = self.prior * sp / len(zp), -su / len(zu)
        g = self._back(p, gp) + self._back(u, gu)
        g[:-1] += self.decay * self.weights
        return g

    def _score(self, x):
        cols, rows, n = x
        return np.bincount(rows, self.weights[cols], n) + self.bias

    def _back(self, x, g):
        cols, rows, _ = x
        return np.append(np.bincount(cols, g[rows], len(self.weights)), g.sum())


def text_counts(docs: DataFrame, used: np.ndarray, bits: int, chunk: int = 1 << 14) -> tuple[np.ndarray, int]:
    """How many of all texts have each of the features, and how many texts there are."""
    chunks = -(-(len(used) + 1) // chunk)
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, total = Columns(shared.value, bits), np.zeros(chunks * chunk, np.int64)
        for batch in sliced(batches):
            for text in text_column(batch, "text"):
                total[columns.of(text)] += 1
            total[len(shared.value)] += batch.num_rows  # behind the features, the texts
        if total.any():
            yield pa.record_batch([pa.array(range(chunks), pa.int32()), pa.array(map(packed_sums, total.reshape(chunks, chunk)), pa.binary())], names=["chunk", "sums"])

    got = summed(docs.select("text").mapInArrow(count, "chunk int, sums binary"), chunks, chunk).reshape(-1)
    return got[: len(used)], int(got[len(used)])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 40_000, bits: int = 20) -> NnPU | None:
    learn = fold("doc_id", FOLDS) != 0
    rows = labelled(labels, "toxic", learn)
    n, toxic = rows.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    if not toxic:
        return None
    found = features_of(docs, chosen_keys(docs, rows.where("y = 1"), positives), lambda texts: [present(t, bits).astype("<i4").tobytes() for t in texts])
    if not found:
        return None
    model = NnPU(bits, toxic / n if toxic < n else n / (n + 1))
    pos = [np.frombuffer(r[3], "<i4") for r in found]
    p = np.bincount(np.concatenate(pos), minlength=1 << bits)
    some = model.candidates(p, len(pos))
    u, texts = text_counts(docs.where("doc_id is not null").where(learn), some, bits)
    used = some[model.toxic(p[some], len(pos), u, texts)]
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def make(texts: list[bytes]) -> list[bytes]:
        columns = Columns(shared.value, bits)
        return [np.array(columns.of(t), "<i4").tobytes() for t in texts]

    few = keyed(docs).where(learn).select("doc_id", "h")
    others = smallest(few, F.xxhash64("doc_id", "h", F.lit(1)), ["doc_id", "h"], texts, unlabelled, distinct=True).withColumn("y", F.lit(0))
    unl = [np.frombuffer(r[3], "<i4") for r in features_of(docs, others, make)]
    column = Columns(used, bits).column
    return model.fit([c[c >= 0] for c in (column[x] for x in pos)], unl, used)


def score(docs: DataFrame, model: NnPU | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.used, model.weights, model.bias, model.bits) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value:
            used, weights, bias, bits = shared.value
            columns = Columns(used, bits)
        for batch in sliced(batches):
            scores = np.zeros(batch.num_rows)
            for k, text in enumerate(text_column(batch, "text") if shared.value else ()):
                scores[k] = 1 / (1 + np.exp(-np.clip(bias + weights[columns.of(text)].sum(), -700, 700)))
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
