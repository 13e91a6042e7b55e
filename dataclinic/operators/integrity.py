"""Integrity guards (D9, D10) and the order-free content fingerprint (V2).

The fingerprint is a multiset hash: every row is hashed with a mark for each NULL, so a value that moves across a
NULL changes it, and the row hashes are summed.  Sums merge, so the same hash is kept per key bucket in a two-level
tree (``FAN`` x ``FAN`` leaves): the root of the tree is the fingerprint of the table, an edit updates the leaves of the
changed rows only, and two trees are compared from the top, reading only the leaves below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_hex

# Fixed threshold from the reference: keeping fewer than half the rows is catastrophic.
DATA_LOSS_RATIO = 0.50
#: Hex digits of a key's md5 that name its node at the top, and its leaf below.
TOP_DIGITS, LEAF_DIGITS = 2, 4

_SUMS = ["n_rows", "hash_sum", "hash_xor"]


def row_hash(columns, seed: int = 0) -> Column:
    """64-bit hash of a row; NULLs count with their place (``xxhash64`` alone skips them)."""
    return F.xxhash64(F.lit(seed), *[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns])


def _sums(columns) -> list[Column]:
    return [F.count(F.lit(1)).cast("long").alias("n_rows"),
            F.coalesce(F.sum(row_hash(columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
            F.coalesce(F.bit_xor(row_hash(columns, 1)), F.lit(0).cast("long")).alias("hash_xor")]


def fingerprint(df: DataFrame) -> DataFrame:
    """V2: (row count, sum of a 64-bit row hash, xor of another).  Independent of row
    order and partitioning, computed in one partial-aggregated pass; the sum is
    kept as DECIMAL(38,0) so it cannot overflow."""
    return df.agg(*_sums(df.columns))


def content_tree(df: DataFrame, keys) -> DataFrame:
    """V2 by key bucket: leaves (bucket, n_rows, hash_sum, hash_xor), at most 16 ** ``LEAF_DIGITS`` rows.
    ``bucket``: the first digits of the md5 of the row's keys, so a row stays in its leaf when other columns change."""
    leaf = F.substring(hash_hex("bucket", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 1, LEAF_DIGITS)
    return df.groupBy(leaf.alias("bucket")).agg(*_sums(df.columns))


def _merged(tree: DataFrame, bucket: Column | str = "bucket") -> list[Column]:
    return [F.sum("n_rows").alias("n_rows"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"),
            F.bit_xor("hash_xor").alias("hash_xor")]


def update_tree(tree: DataFrame, removed: DataFrame, added: DataFrame, keys) -> DataFrame:
    """The leaves after an edit that took the rows ``removed`` away and put ``added`` in; reads the edit only."""
    minus = content_tree(removed, keys).select("bucket", (-F.col("n_rows")).alias("n_rows"),
                                               (-F.col("hash_sum")).cast("decimal(38,0)").alias("hash_sum"), "hash_xor")
    every = tree.select("bucket", *_SUMS).unionByName(minus).unionByName(content_tree(added, keys))
    out = every.groupBy("bucket").agg(*_merged(every))
    return out.where((F.col("n_rows") != 0) | (F.col("hash_sum") != 0) | (F.col("hash_xor") != 0))


def tree_root(tree: DataFrame) -> DataFrame:
    """The fingerprint of the table whose leaves these are."""
    zero = F.lit(0).cast("decimal(38,0)")
    return tree.agg(*_merged(tree)).select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                                           F.coalesce("hash_sum", zero).alias("hash_sum"),
                                           F.coalesce("hash_xor", F.lit(0)).alias("hash_xor"))


def _unlike(now: DataFrame, then: DataFrame) -> DataFrame:
    """Buckets whose sums differ, with both row counts."""
    a = now.select("bucket", *[F.col(c).alias(f"now_{c}") for c in _SUMS])
    b = then.select("bucket", *[F.col(c).alias(f"then_{c}") for c in _SUMS])
    same = F.lit(True)
    for c in _SUMS:
        same = same & F.col(f"now_{c}").eqNullSafe(F.col(f"then_{c}"))
    return a.join(b, "bucket", "full").where(~same)


def changed_buckets(now: DataFrame, then: DataFrame) -> DataFrame:
    """The leaves that differ between two trees: (bucket, now_rows, then_rows).  Nodes of the top level are
    compared first; only leaves below those that differ are."""
    def top(t):
        return t.groupBy(F.substring("bucket", 1, TOP_DIGITS).alias("bucket")).agg(*_merged(t))

    nodes = _unlike(top(now), top(then)).select(F.col("bucket").alias("node"))

    def below(t):
        return t.join(F.broadcast(nodes), F.substring(t["bucket"], 1, TOP_DIGITS) == nodes["node"]).drop("node")  # 256 rows

    return _unlike(below(now), below(then)).select(
        "bucket", F.coalesce("now_n_rows", F.lit(0)).alias("now_rows"), F.coalesce("then_n_rows", F.lit(0)).alias("then_rows"))


def rows_in(df: DataFrame, buckets: DataFrame, keys) -> DataFrame:
    """The rows of ``df`` in some leaves: the candidates behind a difference."""
    leaf = F.substring(hash_hex("bucket", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 1, LEAF_DIGITS)
    return df.join(buckets.select(F.col("bucket").alias("__leaf")), leaf == F.col("__leaf"), "left_semi")


def assert_unchanged(truth: DataFrame, recorded: DataFrame) -> DataFrame:
    """Compare the truth table's count and fingerprint with the recorded one
    (a one-row DataFrame from ``fingerprint`` taken when the episode started)."""
    now = fingerprint(truth)
    r = recorded.select(F.col("n_rows").alias("rec_rows"), F.col("hash_sum").alias("rec_sum"),
                        F.col("hash_xor").alias("rec_xor"))
    return now.crossJoin(F.broadcast(r)).select(
        "n_rows", "rec_rows", (F.col("n_rows") == F.col("rec_rows")).alias("count_ok"),
        ((F.col("hash_sum") == F.col("rec_sum")) & (F.col("hash_xor") == F.col("rec_xor"))).alias("content_ok"))


def data_loss(current: DataFrame, original_rows) -> DataFrame:
    """Rows / original < 0.50 is catastrophic."""
    cur = current.agg(F.count(F.lit(1)).cast("long").alias("current_rows"))
    if isinstance(original_rows, DataFrame):
        orig = F.broadcast(original_rows.select(F.col("original_rows").cast("long")))
    else:
        orig = current.sparkSession.range(1).select(F.lit(original_rows).cast("long").alias("original_rows"))
    j = cur.crossJoin(orig)
    ratio = F.col("current_rows") / F.greatest(F.col("original_rows"), F.lit(1))
    return j.select("current_rows", "original_rows", ratio.alias("ratio"),
                    (ratio < DATA_LOSS_RATIO).alias("catastrophic"))
