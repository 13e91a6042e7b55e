"""Blockwise set membership in packed form: which hashes also occur in an earlier block.

The corpus is cut into blocks of a few MB in id order.  A block sends its
distinct sorted hashes, cut by value into buckets and delta-packed (2 to 6 bytes
a hash instead of a row of 25), through one Spark shuffle by bucket.  A bucket
holds about ``BUCKET_ITEMS`` hashes whatever the corpus size, sorts them, and
answers every block with one bit a hash.  The answers travel back by block,
where the block's texts recompute the hashes in the same order.  The texts
cross the network once: every pass reads the same exchange.

Blocks are ranges of ids that hold about ``BLOCK_BYTES`` each, whatever the spread of the ids and
wherever the long texts lie (``Layout``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

U = np.uint64
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
ROW_BYTES = 64  # what a row counts beside its text, so empty texts fill a block too
MAX_CUTS = 1 << 18  # the table of block boundaries that tasks get: 2 MB at most
_FINE = 4  # cells of the histogram for each block


def _histogram(sizes: DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and rows of each cell [starts[i], starts[i + 1]): one row per task and cell."""
    def count(batches):
        w, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for b in batches:
            cell = np.searchsorted(starts, b.column(0).to_numpy(zero_copy_only=False), side="right") - 1
            w += np.bincount(cell, b.column(1).to_numpy(zero_copy_only=False), len(starts)).astype(np.int64)
            n += np.bincount(cell, minlength=len(starts))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at]), pa.array(n[at])], ["cell", "w", "n"])

    rows = (sizes.mapInArrow(count, "cell bigint, w bigint, n bigint").groupBy("cell")
            .agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas())
    w, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    at = rows["cell"].to_numpy(np.int64)
    w[at], n[at] = rows["w"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return w, n


def _cuts(sizes: DataFrame, lo: int, hi: int, target: float) -> np.ndarray:
    """Starts of the blocks: a histogram over the ids whose cells are split until none of several rows and ids is
    heavier than a quarter of a block; neighbours then join up to ``target``."""
    starts, w, n, first = [lo], [0], [2], True
    while True:
        ends = [*starts[1:], hi + 1]
        split = []
        for a, b, x, rows in zip(starts, ends, w, n):
            parts = 1
            if first or (x > target / _FINE and rows > 1):
                parts = min(b - a, 4096 if first else max(16, math.ceil(x / target * _FINE)))
            split += [a + (b - a) * j // parts for j in range(parts)]
        if len(split) == len(starts) and not first:
            break
        starts, first = split, False
        w, n = _histogram(sizes, np.array(starts, np.int64))
        keep = [0] + [i for i in range(1, len(starts)) if n[i] or n[i - 1]]  # empty neighbours need one cell only
        starts, w, n = [starts[i] for i in keep], w[keep].tolist(), n[keep].tolist()
    cuts, held = [starts[0]], 0
    for a, x in zip(starts, w):
        if held and held + x > target:
            cuts.append(a)
            held = 0
        held += x
    return np.array(cuts, np.int64)


class Layout:
    """Cuts a corpus into blocks of about ``block_bytes``: consecutive ids, null ids last.

    The cuts are quantiles of the bytes, so outlying ids, gaps, clustered long texts and many empty texts leave the
    blocks alike; only the rows of one id are never cut.  A corpus of more than ``MAX_CUTS`` blocks cuts each range
    evenly further.  Rows without an id are one document for the substring operators; they lie in blocks of their own
    number, dealt by their text."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None):
        size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
        all_sizes = stored(docs.select(F.col(id_col).cast("bigint").alias("id"), size.alias("size")))
        weight = F.col("size") + ROW_BYTES
        r = all_sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("id"), F.min("id"), F.max("id"),
                          F.coalesce(F.sum(F.when(F.col("id").isNotNull(), weight)), F.lit(0)),
                          F.coalesce(F.sum(F.when(F.col("id").isNull(), weight)), F.lit(0))).first()
        self.total_bytes, self.rows = int(r[0]), int(r[1])
        self.block_bytes = block_bytes or BLOCK_BYTES
        target = max(self.block_bytes, r[4] / MAX_CUTS)
        self.pieces = math.ceil(target / self.block_bytes)
        self.cuts = np.zeros(1, np.int64)
        self.top = 0
        if self.rows:
            sizes = all_sizes.where("id is not null").select("id", weight.alias("w"))
            self.cuts, self.top = _cuts(sizes, int(r[2]), int(r[3]), target), int(r[3])
        self.nulls = len(self.cuts) * self.pieces  # the first block of rows without an id
        self.null_blocks = max(1, math.ceil(r[5] / self.block_bytes))
        self.blocks = self.nulls + self.null_blocks
        self.buckets = max(1, math.ceil(self.total_bytes / BUCKET_BYTES))

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Block of each (int64) id: non-decreasing."""
        cell = np.maximum(np.searchsorted(self.cuts, ids, side="right") - 1, 0)
        if self.pieces == 1:
            return cell.astype(np.int32)
        lo = self.cuts[cell].astype(np.float64)
        hi = np.append(self.cuts[1:], self.top)[cell].astype(np.float64) + 1
        part = np.floor((ids.astype(np.float64) - lo) / (hi - lo) * self.pieces).astype(np.int64)
        return (cell * self.pieces + np.clip(part, 0, self.pieces - 1)).astype(np.int32)

    def of(self, ids: pa.Array, texts: pa.Array) -> np.ndarray:
        """Block of each row; rows without an id are dealt by their text."""
        out = self.number(ids.fill_null(0).to_numpy(zero_copy_only=False))
        lost = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
        if len(lost):
            import xxhash
            raw = texts.take(pa.array(lost)).to_pylist()
            out[lost] = [self.nulls + xxhash.xxh3_64_intdigest(t or b"") % self.null_blocks for t in raw]
        return out

    def block(self, c: Column) -> Column:
        """Block of an id (a column of integers); null ids come in the first block after all others."""
        nulls, number = self.nulls, self.number

        @F.pandas_udf("int")
        def run(ids: pd.Series) -> pd.Series:
            return pd.Series(number(ids.to_numpy(np.int64)))
        # no null reaches pandas, so 64-bit integers stay exact
        return F.when(c.isNull(), F.lit(nulls)).otherwise(run(F.coalesce(c.cast("bigint"), F.lit(0)))).cast("int")


def pack(sorted_hashes: np.ndarray, bits: int) -> bytes:
    """Deltas of the top ``bits`` bits of sorted distinct hashes as byte planes from the
    lowest up; the two top planes, which are not uniform, are entropy-coded."""
    n = len(sorted_hashes)
    if n == 0:
        return b""
    v = sorted_hashes >> U(64 - bits)
    d = np.diff(v, prepend=U(0))
    first, d[0] = int(d[0]), 0
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :k].T)
    codec = pa.Codec("zstd", compression_level=1)
    out = [bytes([k]), first.to_bytes(8, "little"), n.to_bytes(4, "little")]
    for j in range(k):
        raw = planes[j].tobytes()
        if j >= k - 2:
            small = codec.compress(raw, asbytes=True)
            raw = small if len(small) < n else raw
        out += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(out)


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    k, n, at = blob[0], int.from_bytes(blob[9:13], "little"), 13
    d, codec = np.zeros((n, 8), np.uint8), pa.Codec("zstd")
    for j in range(k):
        size = int.from_bytes(blob[at:at + 4], "little")
        raw = blob[at + 4:at + 4 + size]
        raw = raw if size == n else codec.decompress(raw, decompressed_size=n, asbytes=True)
        d[:, j] = np.frombuffer(raw, np.uint8)
        at += 4 + size
    d = d.view(U).ravel()
    d[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(d, dtype=U)


def distinct(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of the top bits, index of each item among them)."""
    v = h >> U(64 - bits)
    order = np.argsort(v)
    s = v[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse


def bucket_edges(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Cuts of sorted values into ``buckets`` equal ranges of the value space."""
    steps = np.array([((b << bits) // buckets) for b in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(values, steps), [len(values)]])


ASK = "bucket int, block int, hashes binary, check binary"
ANSWER = "block int, kind int, bucket int, bits binary"


def ask_rows(block: int, values: np.ndarray, bits: int, buckets: int, check: np.ndarray | None = None) -> pa.Table:
    """Rows of ``ASK`` for a block's sorted distinct values (already cut to ``bits``)."""
    edges = bucket_edges(values, bits, buckets)
    full = np.flatnonzero(np.diff(edges))
    shifted = values << U(64 - bits)
    blobs = [pack(shifted[edges[b]:edges[b + 1]], bits) for b in full]
    if check is None:
        checks = [None] * len(full)
    else:
        width = check.shape[1]
        checks = [np.ascontiguousarray(check[edges[b]:edges[b + 1]].T).tobytes() if width else None for b in full]
    return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
                     "hashes": pa.array(blobs, pa.binary()), "check": pa.array(checks, pa.binary())})


def _answer(table: pa.Table, kind: int, earlier: bool, nulls: int | None = None) -> pa.Table:
    block = table["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    hashes, checks = table["hashes"].to_pylist(), table["check"].to_pylist()
    parts = [unpack(hashes[i]) for i in order]
    sizes = np.array([len(p) for p in parts], np.int64)
    h = np.concatenate(parts)
    if checks[0] is None:
        by = np.argsort(h, kind="stable")
        same = np.zeros(len(h) + 1, bool)
        s = h[by]
        same[1:-1] = s[1:] == s[:-1]
    else:
        width = len(checks[order[0]]) // len(parts[0])
        c = np.zeros((len(h), 8), np.uint8)
        at = 0
        for i, m in zip(order, sizes):
            c[at:at + m, :width] = np.frombuffer(checks[i], np.uint8).reshape(width, m).T
            at += m
        c = c.view(U).ravel()
        by = np.lexsort((c, h))  # stable: equal pairs stay in block order
        s, t = h[by], c[by]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    # earlier: the run begins in a smaller block, where those of rows without an id count as one; else: any run of
    # two or more
    flag = np.zeros(len(h), bool)
    if earlier:
        at = block[order] if nulls is None else np.minimum(block[order], nulls)
        at = np.repeat(at, sizes)[by]
        head = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(h))))
        flag[by] = at > at[head]
    else:
        flag[by] = same[:-1] | same[1:]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    bits = [np.packbits(flag[cuts[i]:cuts[i + 1]]).tobytes() for i in range(len(order))]
    return pa.table({"block": pa.array(block[order], pa.int32()), "kind": pa.array([kind] * len(order), pa.int32()),
                     "bucket": pa.array(table["bucket"].to_numpy()[order], pa.int32()), "bits": pa.array(bits, pa.binary())})


def answers(asks: DataFrame, kind: int, earlier: bool, nulls: int | None = None) -> DataFrame:
    """One answer for each ask: a bit a hash.  ``earlier``: the hash also occurs in a
    block of smaller number (blocks from ``nulls`` on count as one); else: in any other block."""
    return asks.groupBy("bucket").applyInArrow(lambda t: _answer(t, kind, earlier, nulls), ANSWER)


def read_answer(table: pa.Table, kind: int, values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bits of one kind for a block's sorted distinct values."""
    edges = bucket_edges(values, bits, buckets)
    flag = np.zeros(len(values), bool)
    for k, b, blob in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist()):
        if k == kind:
            m = edges[b + 1] - edges[b]
            flag[edges[b]:edges[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=m).view(bool)
    return flag


def distinct_pairs(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, index of each item among them) of the distinct pairs, sorted."""
    order = np.lexsort((c, h))
    s, t = h[order], c[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], t[new], inverse


def first_last(inverse: np.ndarray, n: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest rank of each distinct value; items are in rank order."""
    lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
    lo[inverse[::-1]] = rank[::-1]
    hi[inverse] = rank
    return lo, hi


BLOCK = "block int, texts binary"


def text_blocks(docs: DataFrame, layout: Layout, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, texts): compressed Arrow tables (doc_id, text) of rows of one block.
    A block has a row for each input batch that holds some of it."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def to_blocks(batches):
        opts = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            block = layout.of(batch.column(0), batch.column(1))
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
            ends = np.append(cut[1:], len(order))
            ids, blobs = [], []
            for a, b in zip(cut, ends):
                part = t.take(pa.array(order[a:b])).select(["doc_id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=opts) as w:
                    w.write_table(part.combine_chunks())
                ids.append(block[order[a]])
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["block", "texts"])

    return src.mapInArrow(to_blocks, BLOCK)


def read_block(table: pa.Table) -> pa.Table:
    """The (doc_id, text) rows of one block in id order, null ids last."""
    parts = [pa.ipc.open_stream(b).read_all() for b in table["texts"].to_pylist()]
    t = pa.concat_tables(parts).combine_chunks()
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
