"""SimHash near-dedup: exact links at a few differing bits through vantage-point trees.

Distinct fingerprints stand for their copies. Vantage points and radii come from a bounded sample (`sample`
fingerprints, or sixteen for each of at most `max_leaves` shards); every fingerprint then has one home shard, and by the triangle bound it queries just those further
shards whose boundary lies within `radius`. A shard with many homes is divided and its queries go to each part, so
no task holds an unbounded group; inside a part another tree prunes. Results are exact (recall 1).

Cases: a text of no words (null too) has fingerprint zero and links like any other; rows with equal doc_id or equal
text each keep their row; a null doc_id gets the component of its fingerprint (null if only such rows are in it);
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.shared import connected_components, parallelism, pieces, sliced, smallest, spanning_forest, stash, text_column


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority of the shingles' hashes, counted a piece of the text at a time."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces(text.lower()):  # bytes: A-Z only, and the six ASCII blanks
        words = tail + piece.split()
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(seed)))
        n += len(digests) // 8
        ones += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        tail = words[max(0, len(words) - shingle + 1) :]
    if not n:
        if not tail:
            return 0
        n, ones = 1, np.unpackbits(np.frombuffer(xxhash.xxh64_digest(b" ".join(tail), seed), np.uint8)).astype(np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp long (the unsigned value's bits), and the columns of keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in text_column(batch, "text")], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    given = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    return given.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *(given.schema[c] for c in keep)]))


class VantageTree:
    """Nodes (vantage, inside's largest distance, outside's smallest); leaves are numbered from the left."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 40, keep: bool = False, seed: int = 7):
        self.rng, self.keep, self.leaves = np.random.default_rng(seed), keep, []
        self.root = self._build(points, np.arange(len(points)), leaf, depth)

    def _build(self, points, at, leaf, depth):
        if len(at) > leaf and depth:
            vantage = points[at[self.rng.integers(len(at))]]
            far = np.bitwise_count(points[at] ^ vantage).astype(np.int16)
            cut = int(np.median(far))
            inside = far <= cut
            if inside.all():
                inside = far < cut
            if inside.any() and not inside.all():
                low = int(far[inside].max())
                high = int(far[~inside].min()) if self.keep else low + 1  # points to come may lie anywhere
                return (vantage, low, high, self._build(points, at[inside], leaf, depth - 1), self._build(points, at[~inside], leaf, depth - 1))
        self.leaves.append(at if self.keep else None)
        return len(self.leaves) - 1

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, rows, whether it is their home). Of two shards only the inner one's rows query the outer one's homes."""
        stack = [(self.root, np.arange(len(points)), True)]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows, home
                continue
            vantage, low, _, inner, outer = node
            far = np.bitwise_count(points[rows] ^ vantage).astype(np.int16)
            inside = far <= low
            if home:
                stack += [(inner, rows[inside], True), (outer, rows[~inside], True), (outer, rows[inside & (far + radius > low)], False)]
            else:
                stack += [(inner, rows[far - radius <= low], False), (outer, rows[far + radius > low], False)]

    def near(self, homes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, home rows) of pairs within radius, for a tree built over homes with keep."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                at = self.leaves[node]
                step = max(1, (1 << 20) // max(1, len(at)))
                for k in range(0, len(rows), step):
                    q, h = np.nonzero(np.bitwise_count(queries[rows[k : k + step], None] ^ homes[at]) <= radius)
                    yield rows[k + q], at[h]
                continue
            vantage, low, high, inner, outer = node
            far = np.bitwise_count(queries[rows] ^ vantage).astype(np.int16)
            stack += [(inner, rows[far - radius <= low]), (outer, rows[far + radius >= high])]


def link(classes: DataFrame, radius: int = 3, shard: int = 8192, sample: int = 4096, max_leaves: int = 1 << 14) -> DataFrame:
    """Edges (u, v) of ids that join all fingerprints of classes (id long, fp long) within radius: a spanning forest of each task's links."""
    spark = classes.sparkSession
    n = classes.count()
    leaves = 1 << min(int(math.log2(max_leaves)), max(0, math.ceil(math.log2(max(1, n / shard)))))
    few = smallest(classes.select("fp"), F.xxhash64("fp"), ["fp"], n, max(sample, 16 * leaves))
    points = few.toArrow().column("fp").to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(points, max(1, len(points) // leaves // 2), depth=int(math.log2(leaves))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            for leaf, rows, home in tree.value.route(fps, radius):
                part = batch.take(pa.array(rows))
                yield pa.record_batch([pa.array(np.full(len(rows), leaf, np.int32)), *part.columns, pa.array(np.full(len(rows), home))], names=["leaf", "id", "fp", "home"])

    routed = stash(classes.select("id", "fp").mapInArrow(deal, "leaf int, id long, fp long, home boolean"))
    # a row for each shard that has homes, max_leaves at most
    sizes = stash(routed.where("home").groupBy("leaf").agg(F.ceil(F.count("*") / (4 * shard)).cast("int").alias("parts")))
    number = F.col("parts")
    # a home lies in one part and also queries the others
    own = F.pmod(F.xxhash64("fp"), number).cast("int")
    spread = routed.join(F.broadcast(sizes), "leaf").withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("home", F.col("home") & (F.col("part") == F.col("own")))
    total = sizes.agg({"parts": "sum"}).first()[0] or 1
    grouped = spread.repartition(max(parallelism(spark), min(total, 4096)), "leaf", "part").sortWithinPartitions("leaf", "part", F.col("home").desc())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, fps, tree_, found = None, [], [], None, []

        def forest():
            u, v = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return spanning_forest(u, v)

        for batch in batches:
            leaf, id_, fp, home, part = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            key = leaf.astype(np.int64) << 32 | part
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if key[s] != now:
                    if now is not None and tree_ is None:
                        found += _join(np.concatenate(ids), np.concatenate(fps), None, None, None, radius)
                    now, ids, fps, tree_ = key[s], [], [], None
                at_home = s + int(home[s:e].sum())
                if at_home > s:
                    ids.append(id_[s:at_home])
                    fps.append(fp[s:at_home])
                if at_home < e and ids:
                    if tree_ is None:
                        ids, fps = [np.concatenate(ids)], [np.concatenate(fps)]
                        tree_ = VantageTree(fps[0], 64, keep=True)
                        found += _join(ids[0], fps[0], None, None, tree_, radius)
                    found += _join(ids[0], fps[0], id_[at_home:e], fp[at_home:e], tree_, radius)
                if sum(len(x[0]) for x in found) > 1 << 20:
                    found.append(forest())
        if now is not None and tree_ is None and ids:
            found += _join(np.concatenate(ids), np.concatenate(fps), None, None, None, radius)
        if found:
            u, v = forest()
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return grouped.select("leaf", "id", "fp", "home", "part").mapInArrow(search, "u long, v long")


def _join(ids, fps, query_ids, queries, tree, radius):
    tree = tree or VantageTree(fps, 64, keep=True)
    out, held = [], 0
    for q, h in tree.near(fps, fps if queries is None else queries, radius):
        u, v = (ids if query_ids is None else query_ids)[q], ids[h]
        keep = u != v
        if keep.any():
            out.append((u[keep], v[keep]))
            held += int(keep.sum())
            if held > 1 << 20:
                out = [spanning_forest(*(np.concatenate(x) for x in zip(*out)))]
                held = len(out[0][0])
    return out


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints (doc_id, fp) with component (the smallest fp reachable by links) and component_id, the smallest doc_id in it.

    Nodes are fingerprints: rows of one doc_id with different texts link nothing by themselves."""
    prints = stash(prints)
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    found = connected_components(link(classes.select(F.col("fp").alias("id"), "fp"), radius))
    named = classes.join(found.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return prints.join(named.select("fp", "component").join(least, "component"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    got = components(fingerprints(docs, shingle), radius)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
