"""Vectorised work on the UTF-8 bytes of whole Arrow columns: words, hashes, groups of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a step takes at once, unless one text has more.
SLICE = 4 << 20
_CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for bytes in any of the closed ``ranges``."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Digits, letters of ASCII and every byte of other characters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but blank, tab, line feed, vertical tab, form feed and carriage return.
NONBLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = _powers(_P if name == "up" else pow(_P, -1, 1 << 64))
    return _TABLES[name]


def utf8_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, body = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, body[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run never goes on into the next text."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, from differences of one running polynomial sum."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    up, down = _table("up"), _table("down")
    i = 0
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _CHUNK, "right"))
        if j <= i:
            out[i] = _long(data[base : int(ends[i])])
            i += 1
            continue
        part = data[base : int(ends[j - 1])]
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.multiply(part, up[: len(part)], out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        s = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[s]) * down[s]
        i = j
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def _long(piece: np.ndarray) -> np.uint64:
    total, up = 0, _table("up")
    for at in range(0, len(piece), _CHUNK):
        part = piece[at : at + _CHUNK]
        total += int(np.sum(part * up[: len(part)], dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return np.uint64(total % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each lower-cased word, first word of each text and the end)``."""
    starts, ends = runs(inside[data], offsets)
    return hash_runs(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + counts[i] - 1`` of every i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    gap = starts - np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.repeat(gap, counts) + np.arange(total)


def to_binary(values: list, kind=pa.binary()) -> pa.Array:
    return pa.array(values, type=kind)


def lists(flat: np.ndarray, pointers: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(pointers.astype(np.int32)), pa.array(flat, type=kind))
