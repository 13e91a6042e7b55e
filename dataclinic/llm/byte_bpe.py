"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern; each match (pre-token) is merged on
its own.  A queue holds one bucket for each merge rank: the positions (in a
linked list of parts) where a merge of that rank is possible.  A bitmap of two
levels, 256 bits a word, marks the ranks whose buckets are not empty, so the next
rank is two find-first-set steps.  Entries are never removed when a
neighbour changes: an entry whose pair no longer has its rank is stale and is
skipped.  A pre-token of n bytes costs O(n) queue steps, however long.

Each Python worker keeps the encodings of the pre-tokens that it has seen (bounded
by ``cache``); the ranks are read from a file that every executor has.

Edge cases: null and empty texts have no tokens; bytes without a rank of their
own raise an error (byte-level files have all 256); repeated rows are encoded
alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 1_200_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.  The rank queue is inline: ``bucket`` maps a rank to its
    positions (a heap, leftmost first), ``low`` a rank's upper part to a word with one
    bit for each rank in use, ``top`` has one bit for each word in use."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
    prev = list(range(-1, n))
    now = [None] * n  # rank of the pair whose first part starts here
    bucket: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for a in range(n - 1):
        now[a] = r = get(piece[a:a + 2])
        if r is not None:
            if r in bucket:
                bucket[r].append(a)  # ascending positions are a heap
            else:
                bucket[r] = [a]
                i = r >> 8
                low[i] = low.get(i, 0) | 1 << (r & 255)
                top |= 1 << i
    while top:
        i = (top & -top).bit_length() - 1
        w = low[i]
        rank = (i << 8) + (w & -w).bit_length() - 1
        b = bucket[rank]
        if len(b) > 1:
            a = heappop(b)
        else:
            a = b[0]
            del bucket[rank]
            low[i] = w = w & (w - 1)
            if not w:
                top &= top - 1
        if now[a] != rank:
            continue  # stale: a neighbour has changed
        mid = end[a]
        stop = end[mid]
        end[a], end[mid], now[mid] = stop, 0, None
        if stop < n:
            prev[stop] = a
            now[a] = r = get(piece[a:end[stop]])
            if r is not None:
                if r in bucket:
                    heappush(bucket[r], a)
                else:
                    bucket[r] = [a]
                    i = r >> 8
                    low[i] = low.get(i, 0) | 1 << (r & 255)
                    top |= 1 << i
        else:
            now[a] = None
        if a:
            c = prev[a]
            now[c] = r = get(piece[c:stop])
            if r is not None:
                if r in bucket:
                    heappush(bucket[r], c)
                else:
                    bucket[r] = [c]
                    i = r >> 8
                    low[i] = low.get(i, 0) | 1 << (r & 255)
                    top |= 1 << i
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a:end[a]]])
        a = end[a]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def exact_pattern(pattern: str) -> str:
    """The pattern with ``\\s`` spelled as the Unicode property that the public library uses."""
    white = r"\p{White_Space}"
    inside = pattern.replace(r"[^\s", "[^" + white)
    return inside.replace(r"\S", r"\P{White_Space}").replace(r"\s", white)


class Seen(dict):
    """Pre-token -> decimal ids joined by commas; computed when missing.  Two generations
    of at most ``cache`` / 2 entries: what was used since the last change of generation stays."""

    def __init__(self, ranks: dict[bytes, int], cache: int):
        super().__init__()
        self.ranks, self.old, self.most = ranks, {}, cache // 2

    def __missing__(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            got = ",".join(map(str, merge(word.encode(), self.ranks)))
            if len(word) > 64:  # very long pre-tokens hardly recur
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Codec:
    """Encoder and decoder; a Python worker keeps one for each file and pattern over its tasks."""

    kept: dict = {}

    @classmethod
    def of(cls, *how) -> "Codec":
        if how not in cls.kept:
            cls.kept[how] = cls(*how)
        return cls.kept[how]

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex
        self.find = regex.compile(exact_pattern(pattern)).findall
        self.ranks = load_ranks(path)
        self.bytes_of = {str(v): k for k, v in self.ranks.items()}
        self.seen = Seen(self.ranks, cache)

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        seen = self.seen
        return ",".join([seen[w] for w in self.find(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, tokens binary"


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
             with_ids: bool = True, cache: int = CACHE) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``with_ids``, the ids as little-endian binary (16 bits each, 32 beyond 65,536 ranks).  ``path``: a rank file on every executor; ``cache``: pre-tokens kept
    by a Python worker (about 220 bytes each)."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = Codec.of(path, pattern, cache)
        kind = "<u2" if max(codec.ranks.values()) < 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, d, ids = [], [], [], []
                for t in part.column(1):
                    s = codec.encode(t.as_py() or "")
                    n.append(s.count(",") + 1 if s else 0)
                    a.append(hashlib.sha256(s.encode()).hexdigest())
                    d.append(hashlib.sha256(codec.decode(s)).hexdigest())
                    ids.append((np.fromstring(s, "i8", sep=",") if s else np.zeros(0)).astype(kind).tobytes() if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()),
                     pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "tokens"])

    return src.mapInArrow(run, SCHEMA)
