"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are turned to their principal axes (from a bounded sample, which steers only the speed), sorted by the
grid cells of width epsilon on the leading axes, and cut into intervals and blocks along that order. Pairs of
intervals, then of blocks, are skipped where their boxes lie further apart than epsilon; what is left is joined by
halving both sequences until boxes part or are small. Each pair is settled by its cosine in double precision, from the
vectors as they were given.

Cases: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing and keeps its
row; vectors of other lengths link only with their like; equal vectors stand for each other and are not compared
again; rows with equal vec_id count as vectors of their own; vec_ids may be any number, and a null one is carried
(its component is null if no linked vector has an id); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import Store, connected_components, parallelism, sliced, smallest, spanning_forest, stash, store_dir

SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit and no cosine: squares of huge or tiny components stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Vectors:
    """Given vectors, their norms and their unit vectors on the principal axes, in double and single precision."""

    def __init__(self, given: np.ndarray, turn: np.ndarray):
        self.given = scaled(given)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.given, self.given))
        self.x = self.given / self.norm[:, None] @ turn
        self.x4 = self.x.astype(np.float32)

    def __len__(self) -> int:
        return len(self.x)

    def cosines(self, i: np.ndarray, other: Vectors, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.given[i], other.given[j]) / (self.norm[i] * other.norm[j])


def near_pairs(a: Vectors, b: Vectors | None, epsilon: float, threshold: float, leaf: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with cosine >= threshold of two sequences in grid order; within one sequence (b None) i < j.

    Products in single precision, with their rounding's bound as slack, choose what double precision decides."""
    own = b is None
    b = a if own else b
    slack = SLACK + 3e-7 * (a.x.shape[1] + 4)
    boxes: dict = {}

    def box(side: int, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        if (side, s, e) not in boxes:
            x = (b if side else a).x[s:e]
            boxes[side, s, e] = x.min(axis=0), x.max(axis=0)
        return boxes[side, s, e]

    stack = [((0, len(a)), (0, len(b)))]
    while stack:
        (s, e), (t, f) = stack.pop()
        if s == e or t == f or own and s >= f:
            continue
        if apart(*box(0, s, e), *box(1, t, f), epsilon):
            continue
        if e - s <= leaf and f - t <= leaf:
            i, j = np.nonzero(a.x4[s:e] @ b.x4[t:f].T >= threshold - slack)
            if own:
                up = i + s < j + t
                i, j = i[up], j[up]
            if len(i):
                exact = a.cosines(s + i, b, t + j) >= threshold
                yield s + i[exact], t + j[exact]
            continue
        left = [(s, (s + e) // 2), ((s + e) // 2, e)] if e - s > leaf or e - s >= f - t else [(s, e)]
        right = [(t, (t + f) // 2), ((t + f) // 2, f)] if f - t > leaf or f - t >= e - s else [(t, f)]
        stack += [(p, q) for p in left for q in right if not own or p[0] < q[1]]


def apart(low, high, low2, high2, epsilon: float) -> bool | np.ndarray:
    """Whether boxes (of the last axis) lie further from each other than epsilon."""
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return (gap * gap).sum(axis=-1) > epsilon * epsilon + SLACK


def partners(i: int, low: np.ndarray, high: np.ndarray, epsilon: float) -> list[int]:
    """Intervals from i on whose boxes are within epsilon of the i-th, by halving the sequence of intervals."""
    out, stack = [], [(i, len(low))]
    while stack:
        t, f = stack.pop()
        if t == f or apart(low[i], high[i], low[t:f].min(axis=0), high[t:f].max(axis=0), epsilon):
            continue
        if f - t == 1:
            out.append(t)
        else:
            stack += [((t + f) // 2, f), (t, (t + f) // 2)]
    return out


def similarity_join(vectors: DataFrame, threshold: float = 0.9, axes: int = 6, sample: int = 4096, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id of vectors (vec_id, embedding array<float or double>).

    Different vectors are numbered in a written table, and components are made of these numbers, so that any vec_id may occur."""
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * threshold)
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("good", F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False)))
    good = rows.where("good")
    counted = good.groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stash(counted.select("e", "least", "n", F.size("e").alias("d"), F.monotonically_increasing_id().alias("id")))
    links = spark.createDataFrame([], "id long, more long")
    edges = spark.createDataFrame([], "u long, v long")
    for (d,) in classes.select("d").distinct().toLocalIterator():
        counts, forest = _join_dimension(classes.where(F.col("d") == d), epsilon, threshold, min(axes, d), sample, block)
        links, edges = links.unionByName(counts), edges.unionByName(forest)
    more = links.groupBy("id").agg(F.sum("more").alias("more"))
    named = classes.join(more, "id", "left").join(connected_components(edges), "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = named.select("e", "least", "c", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    smallest_ = named.groupBy("c").agg(F.min("least").alias("component_id"))
    got = good.drop("good").join(named.join(smallest_, "c"), "e").select("vec_id", "n_links", "component_id")
    return got.unionByName(rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, none null."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _join_dimension(classes: DataFrame, epsilon: float, threshold: float, axes: int, sample: int, block: int) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    seen = np.array([r.e for r in smallest(classes.select("e", "id"), F.xxhash64("e"), ["id"], classes.count(), sample).collect()])
    seen, dim = Vectors(seen, np.eye(seen.shape[1])).x, seen.shape[1]
    # PCA about the origin would keep the mean as an axis; distances don't change with either
    turn = np.linalg.eigh(np.cov(seen.T) if len(seen) > 1 else np.eye(dim))[1][:, ::-1] if dim > 1 else np.eye(1)
    cells = [f"c{k}" for k in range(axes)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            given = matrix(batch.column(0))
            x = Vectors(given, turn).x
            cell = np.floor(x[:, :axes] / epsilon).astype(np.int32)
            packed, width = given.astype("<f8").tobytes(), 8 * dim
            yield pa.record_batch([*(pa.array(cell[:, k]) for k in range(axes)), pa.array(x[:, 0]), batch.column(1), batch.column(2), pa.array([packed[k * width : (k + 1) * width] for k in range(len(x))], pa.binary())], names=[*cells, "x0", "id", "n", "given"])

    n = parallelism(spark)
    schema = "".join(f"{c} int, " for c in cells) + "x0 double, id long, n long, given binary"
    order = [*cells, "x0", "id"]
    dealt = classes.select("e", "id", "n").mapInArrow(place, schema).repartitionByRange(n, *order).sortWithinPartitions(*order)
    base = store_dir(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the sequence, in a file of the shared folder for each attempt of a task: behind them their sizes and
        boxes. A row for the interval that they make up."""
        ids, times, given, sizes, boxes = [], [], [], [], []
        store, name, out, at = Store(base), f"blocks-{uuid.uuid4().hex}", None, 0

        def done(k: int) -> None:
            nonlocal out, at
            out = out or store.create(name)
            raw = np.frombuffer(b"".join(given[:k]), "<f8").reshape(k, dim)
            x = Vectors(raw, turn).x
            sizes.append(k)
            boxes.append((x.min(axis=0), x.max(axis=0)))
            at += out.write(np.array(ids[:k], "<i8").tobytes() + np.array(times[:k], "<i8").tobytes() + raw.tobytes())
            del ids[:k], times[:k], given[:k]

        for batch in batches:
            ids += batch.column(0).to_pylist()
            times += batch.column(1).to_pylist()
            given += batch.column(2).to_pylist()
            while len(given) >= block:
                done(block)
        if given:
            done(len(given))
        if out:
            every = np.array(boxes)
            out.write(np.array(sizes, "<i8").tobytes() + every.astype("<f8").tobytes())
            out.close()
            row = (TaskContext.get().partitionId(), every[:, 0].min(axis=0).tobytes(), every[:, 1].max(axis=0).tobytes(), name, at, len(sizes))
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["part", "low", "high", "file", "at", "blocks"])

    intervals = stash(dealt.select("id", "n", "given").mapInArrow(cut, "part int, low binary, high binary, file string, at long, blocks long"))
    # an interval, and so a row, for each of the shuffle's partitions: their number is a setting, not the data's
    rows = sorted(tuple(r) for r in intervals.toLocalIterator())
    known = spark.sparkContext.broadcast(([r[3:] for r in rows], *(np.array([np.frombuffer(r[k], "<f8") for r in rows]) for k in (1, 2))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks that may hold links, of an interval and those from it on."""
        places, low, high = known.value
        store = Store(base)

        def blocks(k: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
            name, at, m = places[k]
            raw = store.read(name, at, m * 8 * (1 + 2 * dim))
            sizes = np.frombuffer(raw, "<i8", m)
            starts = (np.cumsum(sizes) - sizes) * 8 * (2 + dim)
            return [(name, s, z) for s, z in zip(starts.tolist(), sizes.tolist())], np.frombuffer(raw, "<f8", offset=8 * m).reshape(m, 2, dim)

        for batch in batches:
            for i in batch.column(0).to_pylist():
                mine, boxes = blocks(i)
                for j in partners(i, low, high, epsilon):
                    theirs, others = (mine, boxes) if i == j else blocks(j)
                    for k, place_ in enumerate(mine):
                        from_ = k if i == j else 0
                        near = from_ + np.flatnonzero(~apart(boxes[k, 0], boxes[k, 1], others[from_:, 0], others[from_:, 1], epsilon))
                        if len(near):
                            met = [theirs[m] for m in near]
                            yield pa.record_batch([*(pa.array([v] * len(met)) for v in place_), *(pa.array(c) for c in zip(*met))], names=WORK)

    WORK = [f"{s}_{c}" for s in "ab" for c in ("file", "at", "size")]
    work = spark.range(len(rows)).repartition(max(1, min(n, len(rows)))).mapInArrow(meet, ", ".join(f"{c} {'string' if c.endswith('file') else 'long'}" for c in WORK)).repartition(n)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, kept = Store(base), OrderedDict()

        def load(name: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray, Vectors]:
            if (name, at) not in kept:
                if len(kept) >= 8:
                    kept.popitem(last=False)
                raw = store.read(name, at, size * (16 + 8 * dim))
                kept[name, at] = np.frombuffer(raw, "<i8", size), np.frombuffer(raw, "<i8", size, 8 * size), Vectors(np.frombuffer(raw, "<f8", size * dim, 16 * size).reshape(size, dim), turn)
            kept.move_to_end((name, at))
            return kept[name, at]

        for batch in batches:
            for one, other in sorted((r[:3], r[3:]) for r in zip(*(c.to_pylist() for c in batch.columns))):
                (ai, at, a), (bi, bt, b), same = load(*one), load(*other), one == other
                more_a, more_b, u, v = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [], []
                held = 0
                for i, j in near_pairs(a, None if same else b, epsilon, threshold):
                    np.add.at(more_a, i, bt[j])
                    np.add.at(more_b, j, at[i])
                    u.append(ai[i])
                    v.append(bi[j])
                    held += len(i)
                    if held > 1 << 20:
                        u, v = ([x] for x in spanning_forest(np.concatenate(u), np.concatenate(v)))
                        held = len(u[0])
                fu, fv = spanning_forest(np.concatenate(u), np.concatenate(v)) if u else (ai[:0], bi[:0])
                ids, more = np.concatenate([ai, bi]), np.concatenate([more_a, more_b])
                ids, more = ids[more > 0], more[more > 0]
                size = max(len(ids), len(fu))
                pad = lambda x: pa.array(x.tolist() + [None] * (size - len(x)), pa.int64())
                yield pa.record_batch([pad(ids), pad(more), pad(fu), pad(fv)], names=["id", "more", "u", "v"])

    out = stash(work.mapInArrow(join, "id long, more long, u long, v long"))
    return out.where("id is not null").select("id", "more"), out.where("u is not null").select("u", "v")
