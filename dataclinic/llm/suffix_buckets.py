"""Suffix buckets: sorted one at a time, long ties settled by difference-cover ranks.

A bucket's suffixes are cut at ``length`` bytes, since a longer agreement changes nothing.

* ``cut``: suffixes are dealt to buckets by their minimiser, the least hash of the ``MER``-byte strings
  inside them: it depends on the suffix's own bytes alone, so equal suffixes meet in one bucket, and
  neighbours mostly share theirs.  Such a run travels as one string of length + run - 1 bytes.
* ``first_owners``: sorts a bucket.  Cover samples (positions modulo ``PERIOD`` in ``COVER``, from the
  string's start) are ranked by their length - PERIOD + 1 bytes; suffixes are sorted by their first and last
  8 bytes.  Of those that tie, any two have a shift s < PERIOD that puts both into the cover, so equal ends and
  equal ranks at s are equal suffixes: no byte of a long tie is read again, and a suffix holds two words
  and its ranks, whatever the length.

No hash decides equality: the minimiser's only says where a suffix is sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import byte_windows, mix

U = np.uint64
#: A perfect difference set (every non-zero residue is one difference).
PERIOD, COVER = 7, (0, 1, 3)
MER = 20
RUN = 32  # suffixes of one string at most


def spread(first: np.ndarray, size: np.ndarray, kind=np.int64) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] of them) for each i, in turn."""
    at = np.arange(int(size.sum()), dtype=kind)
    at += np.repeat((first - (np.cumsum(size) - size)).astype(kind), size)
    return at


def cut(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the suffixes at ``starts`` (ascending): (index of the first suffix, suffixes, minimiser's hash) of each."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    mer = min(MER, length // 2)
    low = (byte_windows(buf, np.arange(len(buf) - mer + 1), mer, 11) >> U(32)).astype(np.uint32)
    width, have = length - mer + 1, 1
    while have < width:  # least hash of ``have`` neighbours
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    low = low[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (low[1:] != low[:-1])
    head = np.flatnonzero(new)
    at = np.arange(len(starts))
    new |= (at - np.repeat(head, np.diff(np.append(head, len(starts))))) % RUN == 0
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(starts))), low[head]


def bucket_of(low: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each minimiser (32 bits of hash, of which small ones are frequent: mixed again)."""
    return ((mix(low.astype(U)) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def strings(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings of ``size`` bytes from each position, as binary."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    kind = np.int32 if len(buf) < 1 << 31 and off[-1] < 1 << 31 else np.int64
    data = buf[spread(first, size, kind)]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number in byte order (a view; gathers copy)."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), ">u8", pad, strides=(1,))


def sort_ranks(at: np.ndarray, words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Rank of each position by the 8-byte words at ``offsets`` from it; equal ones share a rank.  Each
    word is read only where the ones before it tie."""
    rank, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for o in offsets:
        key = words[at[live] + o].astype(U)
        by = np.lexsort((key, rank[live]))
        live, key = live[by], key[by]
        old, here = rank[live], np.arange(len(by))
        group, part = np.ones(len(by), bool), np.ones(len(by), bool)
        group[1:] = old[1:] != old[:-1]
        part[1:] = group[1:] | (key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(part, here, 0))
        rank[live] = old + head - np.maximum.accumulate(np.where(group, here, 0))
        more = ~part
        more[:-1] |= ~part[1:]
        live = live[more]
        if len(live) == 0:
            break
    return rank


def _least(rank: np.ndarray, tie: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Least owner among the items of equal (rank, tie)."""
    by = np.lexsort((tie, rank))
    r, t = rank[by], tie[by]
    new = np.ones(len(by), bool)
    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(new)
    out = np.empty(len(by), owner.dtype)
    out[by] = np.repeat(np.minimum.reduceat(owner[by], head), np.diff(np.append(head, len(by))))
    return out


def first_owners(buf: np.ndarray, off: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Least owner of each suffix of the strings buf[off[i]:off[i + 1]] (``length`` bytes at least),
    string after string."""
    size = np.diff(off)
    n = size - length + 1
    at = spread(off[:-1], n)
    if len(at) == 0:
        return np.zeros(0, owner.dtype)
    best, begin = np.repeat(owner, n), np.repeat(off[:-1], n)
    words = _words(buf)
    ends = sort_ranks(at, words, [0, length - 8])
    by = np.argsort(ends, kind="stable")
    tied = ends[by][1:] == ends[by][:-1]
    live = np.sort(by[np.append(tied, False) | np.append(False, tied)])
    if len(live) == 0:
        return best
    # ranks of the cover samples, length - PERIOD + 1 bytes each, of the strings with a tie
    width = length - PERIOD + 1
    some = np.zeros(len(size), bool)
    some[np.repeat(np.arange(len(size)), n)[live]] = True
    sample = spread(off[:-1][some], size[some] - width + 1)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    sample = sample[cover[(sample - np.repeat(off[:-1][some], size[some] - width + 1)) % PERIOD]]
    ranks = np.zeros(len(buf), np.int64)
    ranks[sample] = sort_ranks(sample, words, [*range(0, width - 8, 8), width - 8])
    # the two of a pair are both in the cover after one shift: every pair that ties meets there
    at, phase, ends, start = at[live], (at[live] - begin[live]) % PERIOD, ends[live], best[live]
    least = start.copy()
    for shift in range(PERIOD):
        pick = np.flatnonzero(cover[(phase + shift) % PERIOD])
        if len(pick):
            least[pick] = np.minimum(least[pick], _least(ends[pick], ranks[at[pick] + shift], start[pick]))
    best[live] = least
    return best
