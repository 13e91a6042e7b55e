"""Byte-level repeats of LENGTH bytes by blockwise suffix sorting with a difference cover.

Every UTF-8 byte position of a document with LENGTH bytes before its end starts a suffix, cut there.  Two equal
suffixes are a repeat; matches never cross documents.  Passes over the blocks of ``blocks.py``:

0. Whole copies: a text that also occurs under a smaller id is settled (all its suffixes start there) and
   sends nothing more.  Texts are equal by 128 bits of SHA-256.
1. Filter: a perfect difference set modulo ``PERIOD``.  For any two positions i, j some shift s < PERIOD puts
   both i + s and j + s (counted from their document starts) into the cover, so two equal suffixes hold equal cover
   samples of LENGTH - PERIOD + 1 bytes.  A suffix none of whose samples (5 of 21 positions) recurs by hash is
   unique.  A false match of a hash only keeps a suffix for the next pass.
2. The suffixes left travel to suffix buckets, as strings of neighbours (``suffix_buckets.py``).  A task sorts one
   bucket at a time, settles long ties by the ranks of cover samples, and answers each block which of its suffixes
   start in an earlier document: by their bytes, not by a hash.
3. Every block marks its suffixes and gives its rows.

Removed are the bytes covered by a suffix that also starts in a document of smaller id.

A block sends a string once, however many of its documents hold it, and a bucket sorts a string once,
however many blocks send it.

Edge cases: as in ``substring_dedup``, with bytes for words; the kept bytes may
cut a UTF-8 character and are binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import suffix_buckets as S
from .repeated import Windows, _Block, _Plan
from .substring_dedup import covered
from .words import byte_windows

LENGTH = 50
#: A perfect difference set (every non-zero residue is one difference).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


class ByteWindows(Windows):
    def __init__(self, length: int, with_text: bool):
        if length < PERIOD + 7:
            raise ValueError(f"length must be at least {PERIOD + 7}")
        self.length, self.with_text = length, with_text

    def items(self, buf, off):
        return {"buf": buf, "off": off}

    def row_of(self, it, pos):
        return np.searchsorted(it["off"], pos, side="right") - 1

    def _starts(self, it, live, width, step=None):
        """Positions of live rows with ``width`` bytes before the row's end; only those of the cover with ``step``."""
        sizes = np.diff(it["off"])
        n = np.where(live, np.maximum(sizes - width + 1, 0), 0)
        kind = np.int32 if len(it["buf"]) < 1 << 31 else np.int64  # positions of a block
        begin = (np.cumsum(n) - n).astype(kind)
        at = np.arange(int(n.sum()), dtype=kind)
        at += np.repeat(it["off"][:-1].astype(kind) - begin, n)
        if step:
            cover = np.zeros(PERIOD, bool)
            cover[list(COVER)] = True
            at = at[cover[(at - np.repeat(it["off"][:-1].astype(kind), n)) % PERIOD]]
        return at

    def sample(self, it, live):
        at = self._starts(it, live, self.length - PERIOD + 1, step=True)
        return at, byte_windows(it["buf"], at, self.length - PERIOD + 1, 1)

    def candidates(self, it, live, flagged):
        at = self._starts(it, live, self.length)
        seen = np.zeros(len(it["buf"]) + 1, np.int32)
        seen[flagged + 1] = 1
        seen = np.cumsum(seen, dtype=np.int32)
        return at[seen[at + PERIOD] > seen[at]]

    def all_starts(self, it, rows):
        return self._starts(it, rows, self.length)

    def rows(self, it, table, starts):
        buf, off = it["buf"], it["off"]
        mask = covered(len(buf), starts, self.length)
        gone = np.concatenate([[0], np.cumsum(mask)])
        begin = mask.copy()
        begin[1:] &= ~mask[:-1]
        heads = off[:-1][(off[:-1] < len(buf)) & (np.diff(off) > 0)]
        begin[heads] = mask[heads]
        spans = np.concatenate([[0], np.cumsum(begin)])
        digests, kept = [], []
        for i in range(len(off) - 1):
            a, b = off[i], off[i + 1]
            part = buf[a:b] if gone[b] == gone[a] else buf[a:b][~mask[a:b]]
            text = part.tobytes()
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text if self.with_text else None)
        return pa.table({"doc_id": table["doc_id"], "n_bytes": np.diff(off), "n_removed": gone[off[1:]] - gone[off[:-1]],
                         "n_spans": spans[off[1:]] - spans[off[:-1]], "kept_sha256": digests,
                         "kept": pa.array(kept, pa.binary())}).cast(_ARROW)


class _TextBlock(_Block):
    """A block whose whole copies are known by SHA-256, and whose suffixes are cut into strings for the buckets."""

    def __init__(self, plan, texts, answers):
        super().__init__(plan, texts, answers)
        raw = memoryview(np.ascontiguousarray(self.buf))
        both = b"".join(hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(self.off[:-1], self.off[1:]))
        both = np.frombuffer(both, np.uint64).reshape(-1, 2)
        self.texts = B.distinct_pairs(both[:, 0], both[:, 1])

    def cut(self):
        """Sets, of the strings that hold the suffixes to be sorted: ``first`` suffix and ``count``, ``which`` distinct
        string each is, ``owner``; of the distinct ones, bucket after bucket: ``strings``, ``counts``, ``owners``, ``edges``."""
        length = self.plan.windows.length
        self.starts = self.candidates()
        self.first, self.count, low = S.cut(self.buf, self.starts, length)
        begin = self.starts[self.first]
        self.owner = self.rank[self.plan.windows.row_of(self.it, begin)] if len(begin) else np.zeros(0, np.int64)
        found = S.strings(self.buf, begin, self.count + length - 1).dictionary_encode()
        index = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.full(len(found.dictionary), len(index), np.int64)
        head[index[::-1]] = np.arange(len(index))[::-1]
        bucket = S.bucket_of(low[head], self.plan.buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which, self.strings = place[index], found.dictionary.take(pa.array(order))
        self.counts, self.owners = self.count[head[order]], self.owner[head[order]]
        self.edges = np.searchsorted(bucket[order], np.arange(self.plan.buckets + 1))


def _pack(strings: pa.Array, counts: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes]:
    """(bytes of the strings, their sizes and owners), compressed."""
    codec = pa.Codec("zstd", compression_level=5)
    data = strings.buffers()[2]
    off = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    text = data[int(off[0]):int(off[-1])].to_pybytes()
    side = counts.astype(np.uint8).tobytes() + owners.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    sizes = np.array([len(counts), len(text)], "<i8").tobytes()
    return codec.compress(text, asbytes=True), sizes + codec.compress(side, asbytes=True)


def _unpack(text: bytes, side: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codec = pa.Codec("zstd")
    n, size = np.frombuffer(side, "<i8", 2).tolist()
    raw = np.frombuffer(codec.decompress(side[16:], decompressed_size=9 * n, asbytes=True), np.uint8)
    owners = np.ascontiguousarray(raw[n:].reshape(8, n).T).view("<i8").ravel()
    return np.frombuffer(codec.decompress(text, decompressed_size=size, asbytes=True), np.uint8), raw[:n].astype(np.int64), owners


def _sort_bucket(table: pa.Table, kind: int, length: int, nulls: int) -> pa.Table:
    """The answer to every block of one bucket: a bit a suffix, set where it starts in an earlier document.  Owners
    are (block, rank of the document in it); rows without an id count as one document."""
    blocks = table["block"].to_numpy()
    parts = [_unpack(t, s) for t, s in zip(table["hashes"].to_pylist(), table["check"].to_pylist())]
    counts = np.concatenate([p[1] for p in parts])
    rows = np.array([len(p[1]) for p in parts], np.int64)
    order = np.unique(np.minimum(blocks, nulls))
    # block by its place among this bucket's, then the document's rank
    ranks = np.concatenate([p[2] for p in parts])
    owner = np.repeat(np.searchsorted(order, np.minimum(blocks, nulls)), rows) * (int(ranks.max()) + 1) + ranks
    size = counts + length - 1
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = np.concatenate([p[0] for p in parts])
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode()
    index = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(len(found.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, index, owner)
    buf = np.frombuffer(found.dictionary.buffers()[2], np.uint8)
    cuts = np.frombuffer(found.dictionary.buffers()[1], np.int64, len(least) + 1)
    best = S.first_owners(buf, cuts, least, length)
    n = np.diff(cuts) - length + 1
    begin = np.cumsum(n) - n
    flag = best[S.spread(begin[index], counts)] < np.repeat(owner, counts)
    ends = np.cumsum(counts)[np.cumsum(rows) - 1]
    bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
    return pa.table({"block": pa.array(blocks, pa.int32()), "kind": pa.array([kind] * len(bits), pa.int32()),
                     "bucket": pa.array(table["bucket"].to_numpy(), pa.int32()), "bits": pa.array(bits, pa.binary())})


class _SuffixPlan(_Plan):
    """The passes, as functions of (texts, answers) of one block; the last two send and read suffix strings."""

    SORTED = 2  # kind of the buckets' answers

    def ask(self, stage: str):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            if texts.num_rows == 0:
                return B.ask_rows(0, np.zeros(0, np.uint64), 64, self.buckets)
            x = _TextBlock(self, texts, answers)
            if stage == "texts":
                h, c, _ = x.texts
                return B.ask_rows(x.block, h, 64, self.buckets, c.view(np.uint8).reshape(-1, 8))
            if stage == "samples":
                return B.ask_rows(x.block, B.distinct(x.samples()[1], self.bits)[0], self.bits, self.buckets)
            x.cut()
            full = np.flatnonzero(np.diff(x.edges))
            sent = [_pack(x.strings.slice(a, b - a), x.counts[a:b], x.owners[a:b])
                    for a, b in zip(x.edges[full], x.edges[full + 1])]
            return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([x.block] * len(full), pa.int32()),
                             "hashes": pa.array([t for t, _ in sent], pa.binary()),
                             "check": pa.array([s for _, s in sent], pa.binary())})
        return run

    def rows(self):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            if texts.num_rows == 0:
                return self.empty
            w, x = self.windows, _TextBlock(self, texts, answers)
            x.cut()
            at = np.concatenate([[0], np.cumsum(x.counts)]).astype(np.int64)
            flag = np.zeros(int(at[-1]), bool)
            for k, b, blob in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "bits"))):
                if k == self.SORTED:
                    lo, hi = at[x.edges[b]], at[x.edges[b + 1]]
                    flag[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo).view(bool)
            later = np.repeat(x.owner > x.owners[x.which], x.count)
            gone = x.starts[flag[S.spread(at[x.which], x.count)] | later]
            return w.rows(x.it, x.table, np.sort(np.concatenate([gone, w.all_starts(x.it, ~x.alive)])))
        return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` the kept bytes."""
    layout = B.Layout(docs, id_col, text_col)
    plan = _SuffixPlan(ByteWindows(length, with_text), layout, _ARROW.empty_table())
    texts = B.text_blocks(docs, layout, id_col, text_col)
    known = docs.sparkSession.createDataFrame([], B.ANSWER)
    nulls, kind = layout.nulls, plan.SORTED

    def pass_over(run, out: str) -> DataFrame:
        return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, out)

    known = known.unionByName(B.answers(pass_over(plan.ask("texts"), B.ASK), 0, True, nulls))
    known = known.unionByName(B.answers(pass_over(plan.ask("samples"), B.ASK), 1, False, nulls))
    sent = pass_over(plan.ask("suffixes"), B.ASK)
    known = known.unionByName(sent.groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, kind, length, nulls), B.ANSWER))
    return pass_over(plan.rows(), SCHEMA)
