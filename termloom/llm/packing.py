"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands with elite migration.

Cases: null and empty texts are one end token; repeated rows are packed one by one; a null doc_id is packed like any
other; an empty table gives no rows; further columns are ignored. Documents of more than `capacity` tokens are cut
from their end, so that only the first piece is shorter. Pieces are dealt by row into shards of about `shard_items`,
each solved on several islands; a shard's size doesn't grow with the input or with any key.
"""

from __future__ import annotations

import bisect
import json
import math
import random
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shared import sliced, stash

#: Byte-level BPE's own division of text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


class Encoder:
    """Ids as the `tokenizers` file at `path` gives them. A byte-level BPE whose ids follow its merges is run by the
    faster `tiktoken` on the same vocabulary; a text that holds an added token, and any other file, goes to `tokenizers`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        self.slow, self.fast = Tokenizer.from_file(path), None
        self.added = [x["content"] for x in spec["added_tokens"]]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
        plain = model["type"] == "BPE" and not spec["normalizer"] and not spec["post_processor"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in visible]
            byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in self.added}
            self.fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids (little-endian uint32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches):
            cols = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packed, n = array("I", ids).tobytes(), len(ids)
                start, piece = 0, 0
                stop = n % capacity or min(n, capacity)
                while start < n:
                    part = packed[4 * start : 4 * stop]
                    for col, x in zip(cols, (doc, piece, start, stop - start, zlib.crc32(part), part)):
                        col.append(x)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


# -- grouping genetic algorithm ---------------------------------------------------------------------------------------


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    count = np.bincount(sizes, minlength=capacity + 1)
    weight = count * np.arange(capacity + 1)
    n, w = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(weight)])
    half, best = capacity // 2, 0
    for k in range(half + 1):  # n[j]: items smaller than j
        large, mid = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
        room = mid * capacity - (w[capacity - k + 1] - w[half + 1])
        best = max(best, large + mid + max(0, math.ceil((w[half + 1] - w[k] - room) / capacity)))
    return int(best)


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Put items, in their order, each into the fullest bin that takes it. Bins by free space; a bit mask of those that occur."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, content in enumerate(bins):
        free = capacity - sum([sizes[i] for i in content])
        stacks.setdefault(free, []).append(b)
        mask |= 1 << free
    for i in items:
        size = sizes[i]
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            b, free = len(bins), capacity
            bins.append([i])
        left = free - size
        stacks.setdefault(left, []).append(b)
        mask |= 1 << left
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's sum of squared fills."""
    return (-len(bins), sum([sum([sizes[i] for i in b]) ** 2 for b in bins]) / capacity**2)


def fullest(items: list[int], sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """The choice of items that fills a bin furthest, the others, and the fill (subset sums as bit masks)."""
    mask, reach = (1 << capacity + 1) - 1, [1]
    for i in items:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & mask)
    fill = at = reach[-1].bit_length() - 1
    taken, left = [], []
    for k in range(len(items) - 1, -1, -1):
        if reach[k] >> at & 1:
            left.append(items[k])
        else:
            taken.append(items[k])
            at -= sizes[items[k]]
    return taken, left, fill


def settle(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random, sweeps: int) -> list[list[int]]:
    """Replacement (after Falkenauer's hybrid), among bins with room. A document changes places with a larger one of
    another bin where that fills its own bin further: room gathers in fewer bins. Then each bin exchanges documents with
    the emptiest one, so that it is as full as it can be, until the emptiest is gone."""
    bins, fill = list(map(list, bins)), [sum([sizes[i] for i in x]) for x in bins]
    for _ in range(sweeps):
        roomy = [k for k in range(len(bins)) if 0 < fill[k] < capacity]
        if len(roomy) < 2:
            break
        low = min(roomy, key=fill.__getitem__)
        where = {i: k for k in roomy if k != low for i in bins[k]}
        order = sorted(where, key=sizes.__getitem__)
        ranks = [sizes[i] for i in order]
        rng.shuffle(roomy)
        for k in roomy:
            for i in bins[k] if k != low else ():
                at = bisect.bisect_right(ranks, sizes[i] + capacity - fill[k]) - 1
                while ranks[at] > sizes[i] and (where[order[at]] == k or fill[where[order[at]]] == capacity):
                    at -= 1
                if ranks[at] > sizes[i]:
                    j, other = order[at], where[order[at]]
                    bins[k][bins[k].index(i)], bins[other][bins[other].index(j)] = j, i
                    where[i], where[j] = other, k
                    fill[k] += ranks[at] - sizes[i]
                    fill[other] -= ranks[at] - sizes[i]
                    break
        for k in roomy:
            if k != low and fill[k] < capacity:
                taken, left, full = fullest(bins[k] + bins[low], sizes, capacity)
                if full > fill[k]:
                    fill[low] += fill[k] - full
                    bins[k], bins[low], fill[k] = taken, left, full
    return [x for x in bins if x]


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of b are injected into a; bins of a that hold a duplicate go, and what they displace is best-fitted."""
    full = [x for x in b if sum([sizes[i] for i in x]) >= capacity - capacity // 128] or b
    injected = [list(x) for x in rng.sample(full, max(1, int(len(full) * rng.uniform(0.05, 0.3))))]
    have = {i for x in injected for i in x}
    stay, displaced = [], []
    for x in a:
        if have.isdisjoint(x):
            stay.append(list(x))
        else:
            displaced += [i for i in x if i not in have]
    loose = sorted(range(len(stay)), key=lambda k: sum([sizes[i] for i in stay[k]]))[: max(1, len(stay) // 50)]  # mutation: the emptiest bins are dissolved
    displaced += [i for k in loose for i in stay[k]]
    gone = set(loose)
    stay = [x for k, x in enumerate(stay) if k not in gone]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(injected + stay, displaced, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elite: list[list[list[int]]], rounds: int, population: int, sweeps: int = 4) -> list[list[int]]:
    """The best packing that an island finds, from its own and migrated elite solutions; done where the bound is met."""
    rng, order = random.Random(seed), sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bound = lower_bound(np.array(sizes), capacity)
    herd = [list(map(list, x)) for x in elite] or [best_fit([], order, sizes, capacity)]
    scored = sorted(((fitness(x, sizes, capacity), x) for x in herd), key=lambda p: p[0], reverse=True)
    while len(scored) < population and len(scored[0][1]) > bound:
        noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
        x = best_fit([], noisy, sizes, capacity)
        scored.append((fitness(x, sizes, capacity), x))
        scored.sort(key=lambda p: p[0], reverse=True)
    for _ in range(rounds):
        if len(scored[0][1]) <= bound or len(scored) < 2:
            break
        a, b = sorted(rng.sample(range(len(scored)), 2))
        x = settle(crossover(scored[a][1], scored[b][1], sizes, capacity, rng), sizes, capacity, rng, sweeps)
        f = fitness(x, sizes, capacity)
        if f > scored[-1][0]:
            scored[-1] = (f, x)
            scored.sort(key=lambda p: p[0], reverse=True)
    return scored[0][1]


def figures(sizes: list[int], capacity: int = 1024, islands: int = 2, rounds: int = 24, population: int = 5) -> tuple[int, int, int]:
    """Bins of best-fit decreasing, of the genetic algorithm that starts from it, and the bound, for one shard."""
    greedy = best_fit([], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)
    best = min(len(evolve(sizes, capacity, k, [], rounds, population)) for k in range(islands))
    return len(greedy), best, lower_bound(np.array(sizes), capacity)


def _pack_bins(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for b, content in enumerate(bins):
        out[content] = b
    return out.tobytes()


def _unpack_bins(packed: bytes) -> list[list[int]]:
    flat = np.frombuffer(packed, "<i4")
    order = np.argsort(flat, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1)] if len(flat) else []


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, capacity: int = 1024, shard_items: int = 4096, islands: int = 2, epochs: int = 2, rounds: int = 12, population: int = 5) -> DataFrame:
    """pieces (COLUMNS) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = stash(pieces.select(*COLUMNS)).withColumn("_row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == capacity).select(*COLUMNS, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.where(F.col("length") < capacity)
    shards = max(1, math.ceil(open_.count() / shard_items))
    dealt = open_.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(shards))).repartition(min(shards, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "length", "doc_id", "piece", "_row")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard, its pieces as Arrow bytes: bounded by the shard's size."""

        def done(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "items"])

        now, parts = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if now is not None and keys[s] != now:
                    yield done(parts)
                    parts = []
                now = int(keys[s])
                parts.append(batch.slice(s, e - s).select(COLUMNS))
        if parts:
            yield done(parts)

    grouped = stash(dealt.select("shard", *COLUMNS).mapInArrow(gather, "shard long, items binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, items, island, epoch, elites in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = pa.ipc.open_stream(items).read_all().column("length").to_pylist()
                best = evolve(sizes, capacity, hash((shard, island, epoch)), [_unpack_bins(x) for x in elites], rounds, population)
                score = fitness(best, sizes, capacity)
                yield pa.record_batch([pa.array([x], t) for x, t in zip((shard, island, items, float(score[0]), score[1], _pack_bins(best, len(sizes))), (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary()))], names=["shard", "island", "items", "bins", "fill", "elite"])

    out = "shard long, island int, items binary, bins double, fill double, elite binary"
    isle = grouped.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.expr("cast(array() as array<binary>)"))
    for epoch in range(epochs):
        if epoch:  # each island goes on from its own elite and from its neighbour's on the ring
            arrived = best.groupBy("shard").agg(F.first("items").alias("items"), F.map_from_entries(F.collect_list(F.struct("island", "elite"))).alias("from"))
            isle = arrived.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array(F.col("from")[F.col("island")], F.col("from")[(F.col("island") + 1) % islands]))
        best = isle.select("shard", "items", "island", F.lit(epoch).alias("epoch"), "elites").repartition(min(shards * islands, 4096), "shard", "island").mapInArrow(run, out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, items, elite in zip(*(c.to_pylist() for c in batch.columns)):
                table = pa.ipc.open_stream(items).read_all()
                size, bins = table.column("length").to_numpy(), np.frombuffer(elite, "<i4")
                order = np.argsort(bins, kind="stable")
                run_ = np.cumsum(size[order]) - size[order]
                first = np.concatenate([[True], np.diff(bins[order]) > 0])
                offset = np.empty(len(bins), np.int64)
                offset[order] = run_ - np.maximum.accumulate(np.where(first, run_, 0))
                table = table.append_column("sequence_id", pa.array((shard << 24) + bins.astype(np.int64))).append_column("offset", pa.array(offset))
                yield from table.combine_chunks().to_batches()

    chosen = best.groupBy("shard").agg(F.max_by(F.struct("items", "elite"), F.struct("bins", "fill", -F.col("island"))).alias("x"))
    packed = chosen.select("shard", "x.items", "x.elite").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(packed)
