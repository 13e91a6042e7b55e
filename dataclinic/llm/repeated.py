"""Windows that also start in a document of smaller id: the engine of the two substring operators.

Passes over the blocks of ``blocks.py``; the texts cross the network once, every
pass reads the same exchange.

0. Whole copies: every block sends the 128-bit hashes of its distinct texts.  A text
   that also occurs under a smaller id is settled (all its windows start there) and
   sends nothing more, so a text that fills a third of the table costs one text's
   hashes a block, and no join meets its rows.
1. Samples: the distinct hashes of a set of positions such that two equal windows
   share an equal sample, cut to ``filter_bits``.  The answer says which occur in another
   block; inside a block documents are compared directly.  Windows without a recurring
   sample occur once.
2. The windows left send 64 bits plus ``check_bytes`` more.  The answer says which occur
   in an earlier block, which means a smaller id; inside a block the smallest document
   of each hash is known.
3. Every block marks its windows and gives its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks as B
from .words import joined

U = np.uint64


class Windows:
    """What an operator supplies; positions index the concatenated items of a block."""

    check_bytes = 8

    def items(self, buf, off):
        """Anything the methods below need, from the texts of a block."""

    def sample(self, it, live):
        """(positions, 64-bit hashes) of the samples in live rows."""

    def candidates(self, it, live, flagged):
        """Starts of the windows that hold a flagged sample position."""

    def windows(self, it, starts, which):
        """The first (0) or second (1) 64-bit hash of each window."""

    def all_starts(self, it, rows):
        """Starts of all windows of the rows."""

    def rows(self, it, table, starts):
        """The result rows, given the starts of the windows to remove."""


def filter_bits(n: float) -> int:
    """Whole bytes of a hash such that a value meets one of ``n`` others by chance at most
    once in 32 times."""
    return min(64, 8 * math.ceil((math.log2(max(2, n)) + 5) / 8))


class _Block:
    """A block's texts with what the answers so far say about them."""

    def __init__(self, plan: "_Plan", texts: pa.Table, answers: pa.Table):
        self.plan, self.answers = plan, answers
        self.block = texts["block"][0].as_py()
        self.table = B.read_block(texts)
        self.buf, self.off = joined(self.table["text"])
        col = self.table["doc_id"].combine_chunks()
        ids, null = col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)
        change = np.ones(len(ids), bool)
        change[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        self.rank = np.cumsum(change)  # of the id of each row; null ids share the last
        raw = memoryview(np.ascontiguousarray(self.buf))
        both = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(self.off[:-1], self.off[1:]))
        both = np.frombuffer(both, U).reshape(-1, 2)
        self.texts = B.distinct_pairs(both[:, 0], both[:, 1])

    def live(self) -> np.ndarray:
        """Rows whose whole text does not occur under a smaller id."""
        h, _, inv = self.texts
        lo, _ = B.first_last(inv, len(h), self.rank)
        return ~(B.read_answer(self.answers, 0, h, 64, self.plan.buckets)[inv] | (self.rank > lo[inv]))

    def _recurring(self, kind, bits, hashes, rows):
        """Items that occur in another block, or in two documents of this one."""
        values, inv = B.distinct(hashes, bits)
        lo, hi = B.first_last(inv, len(values), self.rank[rows])
        return (B.read_answer(self.answers, kind, values, bits, self.plan.buckets) | (lo != hi))[inv]

    def samples(self):
        w = self.plan.windows
        self.it, self.alive = w.items(self.buf, self.off), self.live()
        return w.sample(self.it, self.alive)

    def candidates(self):
        """Starts of the windows with a recurring sample."""
        w = self.plan.windows
        pos, h = self.samples()
        return w.candidates(self.it, self.alive, pos[self._recurring(1, self.plan.bits, h, w.row_of(self.it, pos))])

    def identities(self, starts):
        w = self.plan.windows
        c = w.windows(self.it, starts, 1)
        c = c & U((1 << 8 * w.check_bytes) - 1) if w.check_bytes < 8 else c
        return B.distinct_pairs(w.windows(self.it, starts, 0), c)


class _Plan:
    """The passes, as functions of (texts, answers) of one block."""

    def __init__(self, windows: Windows, layout: B.Layout, empty: pa.Table):
        self.windows, self.empty, self.buckets = windows, empty, layout.buckets
        self.bits = filter_bits(layout.total_bytes)

    def ask(self, stage: str):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            if texts.num_rows == 0:
                return B.ask_rows(0, np.zeros(0, U), 64, self.buckets)
            x = _Block(self, texts, answers)
            if stage == "texts":
                h, c, _ = x.texts
                return B.ask_rows(x.block, h, 64, self.buckets, c.view(np.uint8).reshape(-1, 8))
            if stage == "samples":
                return B.ask_rows(x.block, B.distinct(x.samples()[1], self.bits)[0], self.bits, self.buckets)
            h, c, _ = x.identities(x.candidates())
            return B.ask_rows(x.block, h, 64, self.buckets, c.view(np.uint8).reshape(-1, 8)[:, :self.windows.check_bytes])
        return run

    def rows(self):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            if texts.num_rows == 0:
                return self.empty
            w, x = self.windows, _Block(self, texts, answers)
            starts = x.candidates()
            h, _, inv = x.identities(starts)
            rank = x.rank[w.row_of(x.it, starts)]
            lo, _ = B.first_last(inv, len(h), rank)
            gone = starts[B.read_answer(answers, 2, h, 64, self.buckets)[inv] | (rank > lo[inv])]
            return w.rows(x.it, x.table, np.sort(np.concatenate([gone, w.all_starts(x.it, ~x.alive)])))
        return run


def remove_repeated(docs: DataFrame, w: Windows, schema: str, empty: pa.Table, id_col: str, text_col: str) -> DataFrame:
    layout = B.Layout(docs, id_col, text_col)
    plan = _Plan(w, layout, empty)
    texts = B.text_blocks(docs, layout, id_col, text_col)
    known = docs.sparkSession.createDataFrame([], B.ANSWER)

    def pass_over(run, out: str) -> DataFrame:
        return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, out)

    for kind, stage in enumerate(("texts", "samples", "windows")):
        known = known.unionByName(B.answers(pass_over(plan.ask(stage), B.ASK), kind, stage != "samples", layout.nulls))
    return pass_over(plan.rows(), schema)
