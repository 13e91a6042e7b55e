"""Blocks of like size whatever the ids and texts; rows without an id in several blocks."""

import random

import numpy as np
import pyarrow as pa

from dataclinic.llm import blocks as B
from dataclinic.llm.substring_dedup import substring_dedup

ROW = B.ROW_BYTES


def weights(spark, rows, size):
    """Weight of every block, by the layout of ``rows`` (id, length)."""
    df = spark.createDataFrame([(i, "x" * n) for i, n in rows], "doc_id bigint, text string")
    layout = B.Layout(df, "doc_id", "text", size)
    ids = [i for i, _ in rows if i is not None]
    number = dict(zip(ids, layout.number(np.array(ids, np.int64)).tolist()))
    assert all(number[a] <= number[b] for a, b in zip(sorted(ids), sorted(ids)[1:]))
    got = {r["doc_id"]: r["b"] for r in df.select("doc_id", layout.block(df["doc_id"]).alias("b")).collect()}
    assert all(got[i] == number[i] for i in ids) and got.get(None, layout.nulls) == layout.nulls
    w = np.zeros(layout.blocks)
    of = layout.of(pa.array([i for i, _ in rows], pa.int64()), pa.array(["x" * n for _, n in rows]).cast(pa.binary()))
    np.add.at(w, of, [n + ROW for _, n in rows])
    return layout, w


def test_blocks_are_alike(spark):
    plain = [(i, 100) for i in range(20_000)]
    long = [(i, 9_000 if 5_000 <= i < 5_200 else 20) for i in range(20_000)]       # long texts on neighbouring ids
    empty = [(i, 0 if i < 15_000 else 400) for i in range(20_000)]
    far = [*plain, (10 ** 17, 100), (-(2 ** 63), 100), (2 ** 63 - 1, 100), (None, 100)]
    gaps = [(i * 7 + (i // 1000) * 10 ** 12, 100) for i in range(20_000)]
    for rows in (plain, long, empty, far, gaps):
        layout, w = weights(spark, rows, 40_000)
        w = w[:layout.nulls]
        assert len(w) > 30 and w.max() <= 40_000 and w.max() <= 2 * np.median(w)
    layout, w = weights(spark, [(5, 100_000), (6, 10), (None, 3)], 40_000)  # one text larger than a block
    assert layout.nulls == 2
    assert B.Layout(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").blocks == 2


def test_beyond_the_table_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_CUTS", 8)
    layout, w = weights(spark, [(i * 3, 100) for i in range(20_000)], 40_000)
    assert len(layout.cuts) <= 9 and layout.pieces > 5 and w.max() <= 2 * 40_000


def test_rows_without_an_id_fill_several_blocks(spark, as_docs, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    r = random.Random(3)
    text = lambda k: " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(k))
    shared = text(40)
    rows = [(None, text(60) + " " + shared) for _ in range(60)]
    df = as_docs(rows)
    assert B.Layout(df, "doc_id", "text", 3000).null_blocks > 2
    assert {x["n_removed"] for x in substring_dedup(df).collect()} == {0}  # one document: none removes from another
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup(as_docs([*rows, (1, shared)])).collect()}
    assert got == {1: 0, None: 40}
