"""Helpers shared by the operators: scratch storage, ASCII tokenising on bytes, bounded samples, connected components."""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.materialize import delete, shared_folder
from termloom.plans.materialize import written as stash
from termloom.plans.materialize import written_at as stashed

BLANK = re.compile(rb"[\t-\r ]")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `limit` bytes and at most `rows` rows, without copies: what becomes Python objects stays
    small whatever the session's batch size."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * limit // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def pieces(text: bytes, limit: int = 1 << 18) -> Iterator[bytes]:
    """A text in order, cut before blanks into pieces of about limit bytes: words stay whole."""
    at = 0
    while len(text) - at > limit:
        found = BLANK.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def store_dir(spark: SparkSession) -> str:
    """A new folder for a Store; an error at once where Python can't open its file system."""
    path = shared_folder(spark)
    file_system(path)
    return path


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI that Hadoop has resolved (file, hdfs, viewfs, s3a as s3, gs, abfs)."""
    try:
        return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
    except (pa.ArrowInvalid, NotImplementedError) as e:
        raise ValueError(f"Python can't open {uri}: set spark.checkpoint.dir to a folder on file, hdfs, s3a, gs or abfs") from e


class Store:
    """Files below a URI, read by ranges; few stay open."""

    def __init__(self, base: str):
        self.fs, self.path = file_system(base)
        self.open: OrderedDict = OrderedDict()

    def create(self, name: str):
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str, offset: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 16:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(size, offset)


def smallest(rows: DataFrame, key: Column, ties: str | list[str], n: int, take: int, distinct: bool = False) -> DataFrame:
    """The `take` (distinct) rows of the smallest hashes `key`, of about n in all, written.

    Rows that are most likely not among them go before the sort, so that what meets in one task is bounded by `take`. Where
    too few are left, because rows repeat, the share is widened until there are enough or all rows are in."""
    share = min(1.0, (4 * take + 1000) / max(1, n))
    while True:
        kept = rows if share == 1 else rows.where(key < F.lit(-(1 << 63) + int(share * (1 << 64))))
        got = stash((kept.distinct() if distinct else kept).orderBy(key, *([ties] if isinstance(ties, str) else ties)).limit(take))
        if share == 1 or got.count() == take:
            return got
        share = min(1.0, 8 * share)


def summed(parts: DataFrame, chunks: int, size: int) -> np.ndarray:
    """The sum of integer arrays that tasks send as rows (chunk int, sums: compressed int64), chunks x size: the driver gets one row for each chunk."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(packed), "<i8")
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([packed_sums(x) for x in sums.values()], pa.binary())], names=["chunk", "sums"])

    out = np.zeros((chunks, size), np.int64)
    for r in parts.repartitionById(chunks, "chunk").mapInArrow(merge, "chunk int, sums binary").toLocalIterator():
        out[r["chunk"]] += np.frombuffer(zlib.decompress(r["sums"]), "<i8")
    return out


def packed_sums(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i8").tobytes(), 1)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for each node that is not the smallest, from the edges u-v."""
    if not len(u):
        return u[:0], v[:0]
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            break
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that edges (u long, v long) reach, for each id that has an edge to another.

    Alternates large-star and small-star (Kiveris et al., 2014): every star is a minimum by key with map-side
    combining and one equi-join, which adaptive execution splits where a hub is hot. Edges are written to the shared
    folder each round, so nothing is gathered in one place and a lost executor repeats one round at most.
    """
    spark = edges.sparkSession

    def star(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        return sym.join(low.select("u", F.least("u", "m").alias("m")), "u")

    now, path = stashed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        sym = now.union(now.select("v", "u"))
        large = star(sym).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = star(large)  # u > v in each row: its own minimum is a smaller node
        small = joined.select("v", "m").where("v <> m").union(joined.select("u", "m")).toDF("u", "v").distinct()
        after, new_path = stashed(small)
        delete(spark, path)
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now, path = after, new_path
        if got == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = got
    raise RuntimeError(f"components did not settle within {rounds} rounds")
