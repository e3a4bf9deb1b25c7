"""Whole columns of text as flat numpy arrays: words, their hashes, and hashes of runs of words.

Everything here is a helper for code that Spark runs inside tasks. Work goes slice by slice (about a
megabyte of text), so the memory in use doesn't depend on how many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WRAP = 1 << 64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 12), base % _WRAP, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each text begins (one entry more than rows). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each, at least a row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each row's first word (one entry more than rows)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~_SPACE[data]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.logical_not(word[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(word & begins)
    stop = np.empty(n, dtype=bool)
    stop[-1] = True
    stop[:-1] = begins[1:] | ~word[1:]
    ends = np.flatnonzero(word & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block, side="right")))
        low = int(starts[first])
        part = data[low : int(ends[last - 1])].astype(np.uint64) + np.uint64(1)
        power = _powers(_BYTE_BASE, len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        back = _powers(pow(_BYTE_BASE, -1, _WRAP), len(part))
        out[first:last] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        first = last
    return out


def run_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries; `which` picks one of two independent families."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _WORD_BASES[which]
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((words ^ np.uint64(which * 0x5851F42D4C957F2D)) * _powers(base, len(words))[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(pow(base, -1, _WRAP), len(words))[:n])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + lengths[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch words[start:end]; stretches may overlap."""
    base = _WORD_BASES[which]
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((words ^ np.uint64(which * 0x5851F42D4C957F2D)) * _powers(base, len(words))[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(pow(base, -1, _WRAP), len(words))[starts] + (ends - starts).astype(np.uint64))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive keys, by doubling."""
    n, reach, least = len(keys) - width + 1, 1, keys
    if n <= 0:
        return keys[:0]
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[width - reach : width - reach + n])


def any_span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], which: int = 0) -> list[np.ndarray]:
    """A 64-bit hash of each data[start:end], for several arrays of starts and ends, which may overlap."""
    base = (_BYTE_BASE, *_WORD_BASES)[which]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data))[: len(data)], out=total[1:])
    back = _powers(pow(base, -1, _WRAP), len(data))
    return [mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64)) for s, e in spans]


#: The five primes of XXH64, fixed values.
XXH_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The XXH64 of each data[start:end]; spans may overlap. All spans go on together, each as far as it has bytes."""
    p1, p2, p3, p4, p5 = XXH_PRIMES
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray((len(data) + 5,), dtype="<u4", buffer=padded, strides=(1,))
    size, at = ends - starts, starts.copy()
    mixed = lambda x: _turn(x * p2, 31) * p1
    with np.errstate(over="ignore"):
        base = np.uint64(seed)
        out = np.full(len(starts), base + p5, dtype=np.uint64)
        rows = np.flatnonzero(size >= 32)
        if len(rows):
            lanes = [np.full(len(rows), v, dtype=np.uint64) for v in (base + p1 + p2, base + p2, base, base - p1)]
            going = np.arange(len(rows))
            while len(going):
                own = rows[going]
                for i, lane in enumerate(lanes):
                    lane[going] = _turn(lane[going] + eight[at[own] + 8 * i] * p2, 31) * p1
                at[own] += 32
                going = going[ends[own] - at[own] >= 32]
            total = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                total = (total ^ mixed(lane)) * p1 + p4
            out[rows] = total
        out += size.astype(np.uint64)
        while len(rows := np.flatnonzero(ends - at >= 8)):
            out[rows] = _turn(out[rows] ^ mixed(eight[at[rows]]), 27) * p1 + p4
            at[rows] += 8
        if len(rows := np.flatnonzero(ends - at >= 4)):
            out[rows] = _turn(out[rows] ^ (four[at[rows]].astype(np.uint64) * p1), 23) * p2 + p3
            at[rows] += 4
        while len(rows := np.flatnonzero(ends - at >= 1)):
            out[rows] = _turn(out[rows] ^ (padded[at[rows]].astype(np.uint64) * p5), 11) * p1
            at[rows] += 1
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        return out ^ (out >> np.uint64(32))
