"""What the two text classifiers share: folds, bounded samples of texts, tokens on bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import sliced, stash, text_column

#: Letters, digits and bytes of other scripts stay (A-Z lowered); the rest becomes blanks. And the reverse.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKS = bytes(32 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b <= 32 else b for b in range(256))


def fold(doc_id: str | Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("string").cast("binary")), F.lit(folds))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text of rows that have a doc_id: rows of one key are one text."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def labelled(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, y: a document's largest label, of documents that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).where(learn)


def chosen_keys(docs: DataFrame, given: DataFrame, bound: int) -> DataFrame:
    """doc_id, h, y of at most `bound` different texts among given (doc_id, y), by a hash of doc_id: the sample doesn't
    depend on the order of rows, nor on how often one is repeated. Written."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = given.orderBy(*order).limit(bound)
    found = keyed(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "h", "y").distinct()
    return stash(found.orderBy(*order, "h").limit(bound))


def features_of(docs: DataFrame, keys: DataFrame, make: Callable[[list[bytes]], list[bytes]]) -> list[tuple[int, int, int, bytes]]:
    """(doc_id, h, y, features) for each of a bounded number of keys (doc_id, h, y), in order. A text that many rows share is read once by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            fresh = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            part = batch.take(pa.array(fresh, pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(make(text_column(part, "text")), pa.binary())], names=["doc_id", "h", "y", "x"])

    texts = keyed(docs).join(F.broadcast(keys), ["doc_id", "h"]).select("doc_id", "h", "y", "text")
    return sorted((r["doc_id"], r["h"], r["y"], bytes(r["x"])) for r in texts.mapInArrow(run, "doc_id long, h long, y int, x binary").dropDuplicates(["doc_id", "h"]).toLocalIterator())
