"""Vectorised word and byte primitives on concatenated UTF-8 texts (numpy, inside tasks).

White space is ASCII only, so words can be cut on bytes.  Hashes are unsigned
64-bit; every multiplication wraps.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * _K2
    x = x ^ (x >> U(27))
    x = x * _K3
    return x ^ (x >> U(31))


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """Arrow binary / string array -> (bytes of all rows, row offsets); null rows are empty."""
    import pyarrow as pa
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~IS_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off[off < len(buf)]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: its 8-byte pieces mixed in turn, then its length."""
    size = end - start
    h = mix(size.astype(U) * _K1 + U(seed) * _K3)
    if len(start) == 0:
        return h
    pad = np.concatenate([buf, np.zeros(16, np.uint8)])
    w = np.lib.stride_tricks.as_strided(pad[:8].view(U), shape=(len(pad) - 8,), strides=(1,))
    at, live, k = start, np.arange(len(start)), 0
    left = size
    while len(live):
        v = w[at]
        short = left < 8
        if short.any():
            keep = (U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1)
            v = np.where(short, v & keep, v)
        h[live] = mix(h[live] ^ (v * _K1 + U(k + 1)))
        more = left > 8
        live, at, left, k = live[more], at[more] + 8, left[more] - 8, k + 1
    return h


def rolling(h: np.ndarray, row: np.ndarray, width: int, base: int = 0x100000001B3) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``width`` consecutive items of one row:
    (index of the window's first item, mixed hash)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    acc = h[:n].copy()
    b = U(base)
    for k in range(1, width):
        acc *= b
        acc += h[k:k + n]
    ok = row[:n] == row[width - 1:]
    idx = np.flatnonzero(ok)
    return idx, mix(acc[idx])


def byte_windows(buf: np.ndarray, at: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """64-bit hash of the ``width`` (>= 8) bytes from each position of ``at``."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    w = np.lib.stride_tricks.as_strided(pad[:8].view(U), shape=(max(len(pad) - 7, 0),), strides=(1,))
    offs = list(range(0, width - 7, 8))
    if offs[-1] + 8 < width:
        offs.append(width - 8)
    h = np.full(len(at), U(seed) * _K3, U)
    for o in offs:
        h ^= w[at + o]
        h *= _K1
        h ^= h >> U(32)
    return mix(h)
