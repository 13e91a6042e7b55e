"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; null counts as empty.

1. One narrow pass gives each row the length of its normalised text and a hash
   of its first ``PREFIX`` characters.  Rows whose length occurs once are
   settled; of the others, rows whose (length, prefix hash) occurs once.
2. Only the rows that survive both get the full SHA-256, and only these are
   grouped by it.

All groups are aggregated (map-side partial), never windowed, so a group that
holds a third of the table costs one row per task.  The group table is stored
before it is joined back: both join sides are then plain exchanges, which AQE
splits where a group is hot.

Edge cases: null and empty texts are equal to each other; an empty table gives
an empty result; a null id sorts after all others; repeated rows with one id
are all rows of their group (``group_size`` counts rows) and share the flag of
their id; extra columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

PREFIX = 64


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.length(raw).alias("n_points"),
                       F.translate(raw, SPACES, "").alias("norm"))


def _narrow(m: DataFrame) -> DataFrame:
    return m.select("doc_id", "n_points", F.length("norm").alias("norm_len"),
                    F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"), "norm")


def _surviving(first: DataFrame) -> DataFrame:
    """The (length, prefix hash) pairs of more than one row, stored."""
    by_len = first.groupBy("norm_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("norm_len")
    by_prefix = (first.groupBy("norm_len", "prefix_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .join(by_len, "norm_len", "left_semi").select("norm_len", "prefix_hash"))
    return stored(by_prefix.withColumn("survives", F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: exactly one of each group of equal
    texts, also where rows repeat or have no id.  Only surviving groups are hashed in
    full and grouped; all other rows pass through."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    m = docs.select(row, F.col(id_col).alias("doc_id"), F.length(raw).alias("n_points"), F.translate(raw, SPACES, "").alias("norm"))
    m = m.select("row", *_narrow(m).columns[:2], F.length("norm").alias("norm_len"),
                 F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"), "norm")
    keys = _surviving(stored(m.select("norm_len", "prefix_hash")))
    j = m.join(keys, ["norm_len", "prefix_hash"], "left")
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull(), F.bitwise_not(F.col("doc_id")))
    one = (j.where("survives").withColumn("digest", F.sha2("norm", 256)).groupBy("norm_len", "digest")
           .agg(F.max_by("row", order).alias("row")).select("row.*"))
    return j.where("survives is null").select("row.*").unionByName(one)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text, then
    the smallest id, stays.  ``digest_all`` also gives the digest of rows that
    the refinement settled without one (else null); the full text of every row
    is then read in the first pass, and the later stages read none."""
    m = _narrow(_measured(docs, id_col, text_col))
    full = F.sha2("norm", 256)
    first = stored(m.withColumn("text_sha256", full).drop("norm") if digest_all else m.drop("norm"))
    keys = _surviving(first)
    rows = first.join(keys, ["norm_len", "prefix_hash"], "left")
    settled = rows.where(F.col("survives").isNull())
    if digest_all:
        surviving = rows.where("survives")
    else:
        surviving = m.join(keys, ["norm_len", "prefix_hash"], "left_semi").withColumn("text_sha256", full)
    surviving = surviving.select("doc_id", "n_points", "norm_len", "prefix_hash", "text_sha256")
    if not digest_all:
        surviving = stored(surviving)
        settled = settled.withColumn("text_sha256", F.lit(None).cast("string"))
    # the winner: most code points, then the smallest id (~id reverses the order without overflow), null ids last
    best = F.max(F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("has_id"),
                          F.bitwise_not(F.col("doc_id")).alias("rid")))
    groups = stored(surviving.groupBy("norm_len", "text_sha256").agg(
        best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "norm_len", "text_sha256", F.bitwise_not(F.col("best.rid")).alias("keep_id"), "group_size"))
    grouped = surviving.join(groups, ["norm_len", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = settled.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                           F.lit(True).alias("kept"), "text_sha256")
    return grouped.unionByName(alone)
