"""Integer codes of inverted lists: lengths and bit strings as expressions; payloads of interpolative blocks by Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def varbyte_length(x: Column) -> Column:
    """Bytes of seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def _by_length(x: Column, byte: Callable[[Column], Column], stop_bit: bool) -> Column:
    """The bytes of x, low groups first, each as byte() writes it: a case for each length, which generated code runs."""
    n, x = varbyte_length(x).cast("int"), x.cast("long")
    of = lambda k: F.concat(*(byte(F.shiftright(x, 7 * i).bitwiseAND(127) + (128 if (i == k - 1) == stop_bit else 0)) for i in range(k)))
    found = F.when(n == 1, of(1))
    for k in range(2, 11):
        found = found.when(n == k, of(k))
    return found


def varbyte_hex(x: Column, stop_bit: bool = True) -> Column:
    """Low groups first. The high bit marks the last byte, or, without stop_bit, that more follow."""
    return _by_length(x, lambda b: F.lpad(F.hex(b), 2, "0"), stop_bit)


def varbyte_bits(x: Column, stop_bit: bool = True) -> Column:
    """The same bytes as a bit string, each byte's lowest bit first and filled up to eight."""
    return _by_length(x, lambda b: F.rpad(F.reverse(F.bin(b)), 8, "0"), stop_bit)


def hex_bits(code: Column) -> Column:
    """Bytes in hexadecimal as a bit string, each byte's lowest bit first."""
    size = (F.length(code) / 2).cast("int")
    byte = lambda i: F.reverse(F.lpad(F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 2), 8, "0"))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")).otherwise("")


def bits_hex(bits: Column) -> Column:
    """A bit string, filled up with zeros to whole bytes, as their hexadecimal; a byte's first bit is its lowest."""
    size = F.ceil(F.length(bits) / 8).cast("int")
    byte = lambda i: F.lpad(F.conv(F.reverse(F.rpad(F.substring(bits, i * 8 + 1, F.lit(8)), 8, "0")), 2, 16), 2, "0")
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")).otherwise("")


def varbyte_decode(code: Column, stop_bit: bool = True) -> Column:
    """The numbers of a hex string of codes; bytes after the last whole one are none."""

    @F.pandas_udf("array<long>")
    def decode(given: pd.Series) -> pd.Series:
        known = given.fillna("")
        raw = np.frombuffer(bytes.fromhex("".join(known)), np.uint8) ^ (0 if stop_bit else 128)
        held = known.map(len).to_numpy(np.int64) // 2
        cuts = np.cumsum(held)
        if not raw.flags.writeable:
            raw = raw.copy()
        open_ = (held > 0) & ((raw[np.maximum(cuts - 1, 0)] & 128) == 0) if len(raw) else np.zeros(len(held), bool)
        keep = np.ones(len(raw), bool)
        for i in np.flatnonzero(open_):
            at = cuts[i] - 1
            while at >= cuts[i] - held[i] and not raw[at] & 128:
                keep[at] = False
                at -= 1
        x, _ = varbyte_numbers(raw[keep])
        n = np.concatenate([[0], np.cumsum((raw & 128 > 0) & keep)])[np.concatenate([[0], cuts])].tolist()
        return pd.Series([None if g is None else x[a:z] for g, a, z in zip(given, n, n[1:])])

    return decode(code)


def varbyte_list(numbers: Column) -> Column:
    """BINARY: the codes of an array's numbers, one after the other."""

    @F.pandas_udf("binary")
    def pack(lists: pd.Series) -> pd.Series:
        n = lists.map(len).to_numpy(np.int64)
        raw, ends = varbyte_bytes(np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].tolist()
        raw = raw.tobytes()
        return pd.Series([raw[a:z] for a, z in zip(cuts, cuts[1:])])

    return pack(numbers)


def running_sums(numbers: Column) -> Column:
    """The sums of an array's first numbers, in one pass: an array grown by an expression is copied for each element."""

    @F.pandas_udf("array<long>")
    def sums(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: np.cumsum(x, dtype=np.int64), na_action="ignore")

    return sums(numbers)


def unary(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("0"), n.cast("int") - 1), F.lit("1"))


def gamma_length(n: Column) -> Column:
    return (2 * F.length(F.bin(n)) - 1).cast("long")


def gamma(n: Column) -> Column:
    """Elias gamma of n >= 1 as a bit string."""
    return F.lpad(F.bin(n), (2 * F.length(F.bin(n)) - 1).cast("int"), "0")


def gamma_decode(bits: Column) -> Column:
    """The numbers of a string of gamma codes: n zeros, a one and n further bits each; zeros that fill up a byte are none."""
    code = "|".join(f"0{{{n}}}1[01]{{{n}}}" for n in range(63))
    return F.transform(F.regexp_extract_all(bits, F.lit(rf"\G(?:{code})"), F.lit(0)), lambda x: F.conv(x, 2, 10).cast("long"))


def aligned(bits: Column) -> Column:
    return (F.ceil(bits / 8) * 8).cast("long")


def interpolative_neighbours(n: int) -> list[tuple[int, int, int]]:
    """(element, left, right) of a block of n in the order of coding: the elements coded before that bound it, -1 and n for the ends."""
    out, stack = [], [(0, n, -1, n)]
    while stack:
        at, size, left, right = stack.pop()
        if size > 0:
            mid = at + size // 2
            out.append((mid, left, right))
            stack += [(mid + 1, at + size - mid - 1, mid, right), (at, size // 2, left, mid)]
    return out


def interpolative_length(ids: Column) -> Column:
    """Bits of a block of at most 64 ascending ids, whose first and last id and size stand in its header.

    The order of coding depends on the size alone, so each element's bounds are a constant look-up, without recursion."""

    @F.pandas_udf("long")
    def bits(blocks: pd.Series) -> pd.Series:
        flat, n, order = _descending(blocks)
        out = np.zeros(len(n), np.int64)
        out[order] = interpolative_sizes(flat, n)[2]
        return pd.Series(out)

    return bits(ids)


# -- many blocks at once: numbers of all blocks in one array -----------------------------------------------------------------


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Binary digits of int64 numbers; 0 of zero, 64 of negative ones."""
    n, y = np.zeros(len(x), np.int64), np.maximum(x, 0)
    for s in (32, 16, 8, 4, 2, 1):
        more = y >> s > 0
        n += s * more
        y = np.where(more, y >> s, y)
    return np.where(x < 0, 64, n + (y > 0))


def varbyte_lengths(x: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-bit_lengths(x) // 7))


def varbyte_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, with a stop bit, and where each number's end."""
    n = varbyte_lengths(x)
    ends = np.cumsum(n)
    out, starts = np.zeros(ends[-1] if len(x) else 0, np.uint8), ends - n
    for i in range(n.max() if len(x) else 0):
        some = np.flatnonzero(n > i)
        out[starts[some] + i] = (x[some] >> 7 * i & 127) | np.where(n[some] == i + 1, 128, 0)
    return out, ends


def varbyte_numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of varbyte_bytes and where each number's bytes end."""
    ends = np.flatnonzero(raw & 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    starts = np.concatenate([[0], ends[:-1]])
    at = np.arange(ends[-1]) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw[: ends[-1]].astype(np.int64) & 127) << 7 * at, starts), ends


def gamma_bytes(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gamma codes of blocks of so many numbers, each block filled up to whole bytes, and the bytes of each block."""
    digits = bit_lengths(x)
    width = 2 * digits - 1
    first = np.cumsum(sizes) - sizes
    inside = np.cumsum(width) - width
    total = np.add.reduceat(width, first) if len(x) else np.zeros(0, np.int64)
    held = -(-total // 8)
    base = np.cumsum(held) - held
    at = inside - np.repeat(inside[first], sizes) + 8 * np.repeat(base, sizes)
    bits = np.zeros(8 * held.sum(), np.uint8)
    for j in range(digits.max() if len(x) else 0):
        some = np.flatnonzero(digits > j)
        bits[at[some] + digits[some] - 1 + j] = x[some] >> (digits[some] - 1 - j) & 1
    return np.packbits(bits, bitorder="little"), held


def gamma_numbers(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of blocks whose gamma codes start at these bytes; one number of all blocks after the other."""
    bits = np.unpackbits(raw, bitorder="little").astype(np.int64)
    ahead = np.minimum.accumulate(np.where(bits == 1, np.arange(len(bits)), len(bits))[::-1])[::-1]
    out, order = np.zeros(sizes.sum(), np.int64), np.argsort(-sizes, kind="stable")
    place, left, p = (np.cumsum(sizes) - sizes)[order], sizes[order], 8 * starts[order]
    for i in range(left[0] if len(left) else 0):
        m = np.searchsorted(-left, -i, "left")  # blocks of more than i numbers
        one = ahead[p[:m]]
        zeros = one - p[:m]
        x = np.zeros(m, np.int64)
        for b in range(zeros.max() + 1):
            x = np.where(b <= zeros, 2 * x + bits[np.minimum(one + b, len(bits) - 1)], x)
        out[place[:m] + i] = x
        p[:m] = one + zeros + 1
    return out


_BOUNDS: list[np.ndarray] = []


def _bounds() -> np.ndarray:
    """[size, step]: element, left, right of interpolative_neighbours."""
    if not _BOUNDS:
        table = np.zeros((BLOCK + 1, BLOCK, 3), np.int64)
        for n in range(1, BLOCK + 1):
            table[n, :n] = interpolative_neighbours(n)
        _BOUNDS.append(table)
    return _BOUNDS[0]


def _room(ids: np.ndarray, n: np.ndarray, step: int):
    """Of each block's element in this step: its place, the numbers coded before that bound it, and how much they leave."""
    element, left, right = _bounds()[n, step].T
    rows = np.arange(len(n))
    low, high = ids[rows, left + 1] + 1, ids[rows, right + 1] - 1
    return rows, element, low + (element - left - 1), high - low - (right - left - 1) + 1


def interpolative_sizes(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks in descending size, all ids in one array: bits and offset of each step, and each block's bits."""
    wide = n[0] if len(n) else 0
    ids = np.zeros((len(n), wide + 2), np.int64)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    ids[np.repeat(np.arange(len(n)), n), column + 1] = flat
    ids[:, 0] = ids[:, 1] - 1
    ids[np.arange(len(n)), n + 1] = ids[np.arange(len(n)), n] + 1
    size, offset = np.zeros((len(n), wide), np.int64), np.zeros((len(n), wide), np.int64)
    for step in range(wide):
        m = np.searchsorted(-n, -step, "left")
        rows, element, least, room = _room(ids[:m], n[:m], step)
        size[:m, step] = np.where(room > 0, bit_lengths(room), 0)
        offset[:m, step] = ids[rows, element + 1] - least
    return size, offset, size.sum(axis=1)


def _descending(blocks: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = blocks.map(len).to_numpy(np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.concatenate(blocks.to_numpy()[order]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    return flat, n[order], order


def _interpolative_payloads(blocks: pd.Series) -> pd.Series:
    flat, n, order = _descending(blocks)
    size, offset, total = interpolative_sizes(flat, n)
    held = -(-total // 8)
    base = np.cumsum(held) - held
    at = 8 * base[:, None] + np.cumsum(size, axis=1) - size
    bits = np.zeros(8 * held.sum(), np.uint8)
    for b in range(size.max() if size.size else 0):
        some = size > b
        bits[at[some] + b] = offset[some] >> b & 1
    raw, out = np.packbits(bits, bitorder="little").tobytes(), [b""] * len(n)
    for k, a, h in zip(order.tolist(), base.tolist(), held.tolist()):
        out[k] = raw[a : a + h]
    return pd.Series(out)


def _interpolative_blocks(raw: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    order = np.argsort(-n.to_numpy(np.int64), kind="stable")
    sizes, payloads = n.to_numpy(np.int64)[order], raw.to_numpy()[order]
    held = np.array([len(x) for x in payloads], np.int64)
    bits = np.append(np.unpackbits(np.frombuffer(b"".join(payloads), np.uint8), bitorder="little"), 0).astype(np.int64)
    at = 8 * (np.cumsum(held) - held)
    rows = np.arange(len(sizes))
    ids = np.zeros((len(sizes), (sizes[0] if len(sizes) else 0) + 2), np.int64)
    ids[:, 0] = first.to_numpy(np.int64)[order] - 1
    ids[rows, sizes + 1] = last.to_numpy(np.int64)[order] + 1
    for step in range(sizes[0] if len(sizes) else 0):
        m = np.searchsorted(-sizes, -step, "left")
        some, element, least, room = _room(ids[:m], sizes[:m], step)
        size = np.where(room > 0, bit_lengths(room), 0)
        x = np.zeros(m, np.int64)
        for b in range(size.max()):
            x += np.where(b < size, bits[np.minimum(at[:m] + b, len(bits) - 1)], 0) << b
        ids[some, element + 1] = least + x
        at[:m] += size
    out = [None] * len(sizes)
    for i, k in enumerate(order.tolist()):
        out[k] = ids[i, 1 : sizes[i] + 1]
    return pd.Series(out)


def interpolative_bits(ids: list[int]) -> str:
    """The block's payload: each offset in as many bits as its range needs, low bit first."""
    out = []
    for i, left, right in interpolative_neighbours(len(ids)):
        low = ids[0] if left < 0 else ids[left] + 1
        high = ids[-1] if right >= len(ids) else ids[right] - 1
        room = high - low - (right - left - 1) + 1
        offset = ids[i] - low - (i - left - 1)
        out += [str(offset >> b & 1) for b in range(room.bit_length() if room else 0)]
    return "".join(out)


def interpolative_ids(bits: str, n: int, first: int, last: int) -> list[int]:
    ids, at = [0] * n, 0
    for i, left, right in interpolative_neighbours(n):
        low = first if left < 0 else ids[left] + 1
        high = last if right >= n else ids[right] - 1
        room = high - low - (right - left - 1) + 1
        size = room.bit_length() if room else 0
        ids[i] = low + (i - left - 1) + sum(int(b) << k for k, b in enumerate(bits[at : at + size]))
        at += size
    return ids


def pack_bits(bits: str) -> bytes:
    """Eight to a byte, the first bit lowest."""
    return bytes(sum(int(b) << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def unpack_bits(raw: bytes, n: int) -> str:
    return "".join(str(b >> k & 1) for b in raw for k in range(8))[:n]


def interpolative_encode(ids: Column) -> Column:
    """BINARY payload of a block."""

    @F.pandas_udf("binary")
    def encode(blocks: pd.Series) -> pd.Series:
        return _interpolative_payloads(blocks)

    return encode(ids)


def interpolative_decode(payload: Column, n: Column, first: Column, last: Column) -> Column:
    @F.pandas_udf("array<long>")
    def decode(raw: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return _interpolative_blocks(raw, n, first, last)

    return decode(payload, n, first, last)
