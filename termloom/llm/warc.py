"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key, page, type and digest, and written in compressed blocks; a sparse directory
holds each block's first key. A look-up searches the shards' first keys, then one shard's directory, by halving, reads one block by its
range and then one record by its range. Archives and index lie in the shared folder, one file for each task's
attempt; only files that a finished attempt reported are ever read.

Cases: a null payload is empty; a null or unparsable url is its own key; rows with equal page_id are records of their
own whatever their payloads, and where they share the smallest page_id of equal payloads all of them are responses (a
revisit is looked up with its digest among them); payloads under `least` bytes are never revisits; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import Store, parallelism, sliced, stash, store_dir

CAPTURES = "surt string, page_id long, url string, file string, offset long, size long, record_type string, digest string, refers_to long, refers_surt string"
CAPTURE_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("refers_surt", pa.string())])
#: What captures are sorted by.
KEY = ["surt", "page_id", "record_type", "digest"]
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """org,example,www)/path?query: hosts sort by domain."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url or "")
    if not m:
        return url or ""
    host = ",".join(reversed(m[1].lower().split(".")))
    return f"{host}{':' + m[2] if m[2] else ''}){m[3] or '/'}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str | None] | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8"]
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers[0]}>", f"WARC-Refers-To-Target-URI: {json.dumps(refers[1])}"]
        payload = b""
    return "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def page_of(field: str) -> int | None:
    digits = field.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_archives(pages: DataFrame, base: str, least: int = 100, level: int = 1) -> DataFrame:
    """A gzip member for each record; captures (CAPTURES) of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = F.min(F.struct("page_id", "url")).alias("r")
    large = pages.where(F.octet_length("html") >= least)
    again = large.where("page_id is not null").groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", F.col("r.page_id").alias("r"), F.col("r.url").alias("r_url"))
    refers = F.when((F.octet_length("html") >= least) & (F.col("r") < F.col("page_id")), F.col("r"))
    marked = pages.join(again, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("r"), "r_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, out, at = Store(base), f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in sliced(batches):
            rows = []
            for page, url, html, digest, r, r_url in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.create(name)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page, url, html.encode(), digest, None if r is None else (r, r_url))
                raw = packer.compress(raw) + packer.flush()
                out.write(raw)
                rows.append((surt(url), page, url, name, at, len(raw), "response" if r is None else "revisit", digest, r, None if r is None else surt(r_url)))
                at += len(raw)
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), CAPTURE_SCHEMA)] if rows else [pa.array([], t.type) for t in CAPTURE_SCHEMA], schema=CAPTURE_SCHEMA)
        if out:
            out.close()

    return stash(marked.mapInArrow(write, CAPTURES))


def write_index(captures: DataFrame, base: str, lines: int = 300) -> DataFrame:
    """shard (file), first (key, as JSON), at, size: for each shard, whose blocks and directory are in its file.

    A shard's file holds its compressed blocks and, at `at`, its directory: a line for each block."""
    dealt = captures.select("surt", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "record_type", "digest", "file", "offset", "size").repartitionByRange(parallelism(captures.sparkSession), *KEY).sortWithinPartitions(*KEY, "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, out, at, block, directory = Store(base), f"index-{uuid.uuid4().hex}.cdxz", None, 0, [], []

        def flush():
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in block).encode())
            out.write(raw)
            directory.append([*block[0][: len(KEY)], at, len(raw)])
            at += len(raw)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or store.create(name)
                block.append(row)
                if len(block) == lines:
                    flush()
        if out:
            if block:
                flush()
            raw = json.dumps(directory).encode()
            out.write(raw)
            out.close()
            yield pa.record_batch([pa.array([v], t) for v, t in ((name, pa.string()), (json.dumps(directory[0][: len(KEY)]), pa.string()), (at, pa.int64()), (len(raw), pa.int64()))], names=["shard", "first", "at", "size"])

    return stash(dealt.mapInArrow(write, "shard string, first string, at long, size long"))


class Index:
    """Look-ups of captures. Of directories and blocks a few are kept."""

    def __init__(self, base: str, shards: list[tuple]):
        self.store, self.shards = Store(base), sorted(shards, key=lambda s: json.loads(s[1]))
        self.firsts = [tuple(json.loads(s[1])) for s in self.shards]
        self.kept: OrderedDict = OrderedDict()

    def _get(self, key, make):
        if key not in self.kept:
            if len(self.kept) >= 64:
                self.kept.popitem(last=False)
            self.kept[key] = make()
        self.kept.move_to_end(key)
        return self.kept[key]

    def directory(self, k: int) -> list:
        shard, _, at, size = self.shards[k]
        return self._get(k, lambda: [tuple(x) for x in json.loads(self.store.read(shard, at, size))])

    def block(self, k: int, b: int) -> list:
        at, size = self.directory(k)[b][-2:]
        return self._get((k, b), lambda: [tuple(json.loads(x)) for x in zlib.decompress(self.store.read(self.shards[k][0], at, size)).split(b"\n")])

    def find(self, surt_: str, page: int, digest: str) -> tuple[str, int, int] | None:
        """(file, offset, size) of the response of a page with a payload: by shards, then by the directory's blocks, then
        within one block. Equal keys may begin in the block or shard before, which ends where the first of them does."""
        key = (surt_, page, "response", digest)
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.shards) and self.firsts[k] <= key:
            firsts = [x[: len(KEY)] for x in self.directory(k)]
            b = max(0, bisect.bisect_left(firsts, key) - 1)
            while b < len(firsts) and firsts[b] <= key:
                rows = self.block(k, b)
                i = bisect.bisect_left(rows, key)
                if i < len(rows) and rows[i][: len(KEY)] == key:
                    return tuple(rows[i][len(KEY) :])
                b += 1
            k += 1
        return None

    def record(self, place: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.store.read(*place), 31))


def read_archives(captures: DataFrame, index: DataFrame, base: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture in the index, from the archives:
    each by its range; a revisit's payload by a look-up of what it refers to. Shards are as many as the shuffle's partitions."""
    spark = captures.sparkSession
    shards = [tuple(r) for r in index.collect()]
    shared = spark.sparkContext.broadcast(shards)
    # tasks take whole blocks of the index, in order
    tasks = index.select("shard").withColumn("k", F.lit(0)).repartition(max(1, len(shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = Index(base, shared.value)
        number = {s[0]: k for k, s in enumerate(index_.shards)}
        seen: OrderedDict = OrderedDict()

        def payload_of(*key) -> tuple[int, str]:
            if key not in seen:
                if len(seen) >= 1024:
                    seen.popitem(last=False)
                place = index_.find(*key)
                if place is None:
                    raise ValueError(f"the index lacks {key}")
                payload = index_.record(place)[1]
                seen[key] = (len(payload), hashlib.sha256(payload).hexdigest())
            seen.move_to_end(key)
            return seen[key]

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for b in range(len(index_.directory(number[shard]))):
                    rows = []
                    for place in sorted(x[len(KEY) :] for x in index_.block(number[shard], b)):
                        fields, payload = index_.record(place)
                        page, to = page_of(fields["WARC-Record-ID"]), None
                        if fields["WARC-Type"] == "revisit":
                            to = page_of(fields["WARC-Refers-To"])
                            size, digest = payload_of(surt(json.loads(fields["WARC-Refers-To-Target-URI"])), to, fields["WARC-Payload-Digest"].removeprefix("sha256:"))
                        else:
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"page {page}: the payload is not what was written")
                        rows.append((page, size, digest, fields["WARC-Type"], to))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return tasks.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, base: str | None = None) -> DataFrame:
    """Write archives and index, then read every page back."""
    base = base or store_dir(pages.sparkSession)
    captures = write_archives(pages, base)
    return read_archives(captures, write_index(captures, base), base)
