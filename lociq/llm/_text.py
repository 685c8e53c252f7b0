"""Vectorised work on the bytes of whole Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit number for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
SHINGLE = 5
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, SHINGLE + 1, dtype=np.int64).astype(U) | U(1)
_powers: dict = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of an odd multiplier modulo 2**64, and of its inverse."""
    if _powers["n"] < n:
        _powers["n"] = n
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            x = np.full(n + 1, U(base))
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers; one-to-one."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] such that (H[j] - H[i]) * P**-i depends on the bytes i..j only."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:-1], out=h[1:])
    return h


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in slices of about size bytes of text: (rows, bytes, offsets of each text and the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        to = min(to, n)
        yield slice(at, to), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, letters A-Z lower-cased, and where each text's words begin (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    left, right = np.empty(n, bool), np.empty(n, bool)
    left[0] = right[-1] = True
    left[1:], right[:-1] = space[:-1], space[1:]
    left |= edge[:-1]
    right |= edge[1:]
    starts, ends = np.flatnonzero(~space & left), np.flatnonzero(~space & right) + 1
    h = prefix_hashes(_LOWER[data])
    _, down = powers(n)
    return mix((h[ends] - h[starts]) * down[starts]), np.searchsorted(starts, off)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 5-word shingles of each text, in order, and where each text's begin (and the end).

    A text of one to four words has one shingle, the whole of it.
    """
    w, at = words(data, off)
    count = np.diff(at)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begin[-1], U)
    if len(w) >= SHINGLE:
        full = w[: len(w) - SHINGLE + 1] * _MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            full += w[k : len(w) - SHINGLE + 1 + k] * _MULTIPLIERS[k]
        where = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(at[:-1], n)
        out = full[np.minimum(where, len(full) - 1)]
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)):
        part = w[at[d] : at[d + 1]]
        out[begin[d]] = (np.append(part, U(len(part))) * np.append(_MULTIPLIERS[: len(part)], _MULTIPLIERS[-1])).sum(dtype=U)
    return mix(out), begin
