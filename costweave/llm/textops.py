"""Numpy helpers over the bytes of many texts at once; used inside Arrow tasks only."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # bytes hashed at once: bounds the temporaries of a task
PART_BYTES = 1 << 20  # texts taken at once
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []

BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def release() -> None:
    """Give back what Arrow and the C library keep of batches that are done: a worker lives on through the next stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hashes` gives the hash of any span of data (uint8)."""
    _, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * inverse[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair; equal spans have equal hashes wherever they lie."""
    base, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * base[starts] + (ends - starts).astype(np.uint64))


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over every run of `width` values."""
    done = 1
    while done * 2 <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return least(values[:-rest], values[rest:]) if rest else values


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary Arrow column, without copies; NULL counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column, kind = column.cast(pa.large_binary()), np.int64
    else:
        column, kind = column.cast(pa.binary()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a NULL may span bytes
        valid = np.asarray(column.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():
            parts = [flat[a:b] for a, b, ok in zip(offsets, offsets[1:], valid) if ok]
            lengths = np.where(valid, np.diff(offsets), 0)
            return (np.concatenate(parts) if parts else flat[:0]), np.concatenate([[0], np.cumsum(lengths)])
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes that are no separators; no word crosses rows."""
    inside = ~separators[data]
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, fold: np.ndarray = LOWER):
    """(hash, row, start, end) of every word of the rows, in order. Long rows are hashed in parts cut at separators."""
    found = []
    for first, last in blocks(offsets, BLOCK_BYTES):
        low, high = int(offsets[first]), int(offsets[last])
        while low < high:
            cut = high
            if high - low > 2 * BLOCK_BYTES:  # one long row: cut after a separator
                gaps = np.flatnonzero(separators[data[low + BLOCK_BYTES : high]][: 64 * BLOCK_BYTES])
                cut = low + BLOCK_BYTES + int(gaps[0]) + 1 if len(gaps) else high
            part = fold[data[low:cut]]
            inner = np.clip(offsets[first : last + 1] - low, 0, cut - low)
            starts, ends, rows = word_spans(part, inner, separators)
            if len(starts):
                found.append((span_hashes(prefix_hashes(part), starts, ends), rows + first, starts + low, ends + low))
            low = cut
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes, in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1] + _U(n)
    for k in range(1, n):
        out = mix(out * _U(_BASE) + words[k : len(words) - n + 1 + k])
    return out


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What gram_hashes gives for neighbours, for any pairs of word hashes."""
    return mix((first + _U(2)) * _U(_BASE) + second)
