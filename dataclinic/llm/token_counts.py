"""Token counts of flat, unindexed token files by a separator scan.

A token file is a plain sequence of little-endian ids; every document ends with
the end-of-document id (the last one may lack it).  Files are cut into blocks of
``BLOCK_TOKENS`` ids that tasks read by range, so a file of any size is many
tasks.  A task searches its block with one vectorised comparison and gives a row
for each separator.  Boundaries are stitched by a prefix scan over the blocks:
a block's first document starts after the last separator of all earlier blocks
of its file (running maximum), and its ordinal follows the separators before it
(running sum).  The scan sees one row a block.

``write_token_files`` makes such files from documents with Spark's own writer:
word ids (hash of the word modulo the end-of-document id), the separator as
the writer's row separator.  Files and rows follow the document ids, so ordinals
can be joined back to ids.

Edge cases: an empty document has 0 tokens; empty files and folders give no rows;
a null text is empty; a null id comes last; repeated rows are documents of their
own; extra columns are not read; a file whose size is no multiple of the id width
is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Layout
from .common import shared_folder, stored
from .words import joined, word_hashes, word_spans

BLOCK_TOKENS = 128 << 10  # a shard is several blocks, so documents cross them
EOD = 50_256  # fixed value: the id after those of the 50,256 ranks
SHARD_BYTES = 8 << 20


def word_ids(docs: DataFrame, id_col: str, text_col: str, eod: int = EOD) -> DataFrame:
    """(doc_id, tokens): each text's word ids below ``eod`` as little-endian 16-bit binary."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                buf, off = joined(part.column(1))
                start, end, row = word_spans(buf, off)
                ids = (word_hashes(buf, start, end, 4) % np.uint64(eod)).astype("<u2")
                cut = 2 * np.searchsorted(row, np.arange(part.num_rows + 1))
                tokens = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cut.astype(np.int32)),
                                                                            pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], ["doc_id", "tokens"])

    return src.mapInArrow(run, "doc_id bigint, tokens binary")


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", eod: int = EOD) -> str:
    """Writes ``folder``/shard=k/*.txt (raw 16-bit ids) in the order of the ids, null ids last."""
    layout = Layout(docs, id_col, text_col, SHARD_BYTES)
    rows = word_ids(docs, id_col, text_col, eod).withColumn("shard", layout.block(F.col("doc_id")))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last())
    raw = rows.select("shard", F.col("tokens").cast("string").alias("value"))
    raw.write.partitionBy("shard").option("encoding", "ISO-8859-1").option(
        "lineSep", eod.to_bytes(2, "little").decode("latin-1")).text(folder)
    return folder


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length) of the token files under a folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(F.col("path").alias("file"), "length"))


def token_counts(files: DataFrame, width: int = 2, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: file, ordinal (0-based, over all files by length of name and
    name), file_start (token offset in its file), n_tokens, closed (its separator is there)."""
    files = stored(files)
    size = F.lit(block_tokens * width).cast("bigint")
    blocks = files.where("length > 0").select("file", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def scan(batches):
        from pyarrow import fs
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are no multiple of {width}")
                store, path = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:", "file://", 1))
                at = block * block_tokens * width
                with store.open_input_file(path) as f:
                    raw = f.read_at(min(block_tokens * width, length - at), at)
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == eod) + block * block_tokens
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()),
                     pa.array(np.arange(n), pa.int64()), pa.array(np.append(-1, ends)[:-1] if n else ends, pa.int64()),
                     pa.array(ends, pa.int64())], ["file", "block", "k", "before", "at"])

    found = stored(blocks.mapInArrow(scan, "file string, block bigint, k bigint, before bigint, at bigint"))
    tail = F.struct(F.length("file").alias("l"), "file")
    summary = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    lane = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = stored(summary.select("file", "block", F.coalesce(F.max("last").over(lane), F.lit(-1)).alias("carry"),
                                    F.coalesce(F.sum("n").over(lane), F.lit(0)).alias("earlier"), "n", "last"))
    per_file = files.join(summary.groupBy("file").agg(F.sum("n").alias("docs"), F.max("last").alias("last")), "file", "left")
    per_file = per_file.select("file", F.floor(F.col("length") / width).alias("tokens"),
                               F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("last", F.lit(-1)).alias("last"))
    per_file = per_file.withColumn("open", F.col("tokens") - 1 > F.col("last"))
    order = Window.orderBy(tail).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    per_file = stored(per_file.withColumns({
        "base": F.coalesce(F.sum(F.col("docs") + F.col("open").cast("int")).over(order), F.lit(0)),
        "token_base": F.coalesce(F.sum("tokens").over(order), F.lit(0))}))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.col("before")) + 1
    closed = (found.join(summary.select("file", "block", "carry", "earlier"), ["file", "block"])
              .join(per_file.select("file", "base", "token_base"), "file")
              .select("file", (F.col("base") + F.col("earlier") + F.col("k")).alias("ordinal"), start.alias("file_start"),
                      (F.col("token_base") + start).alias("token_start"), (F.col("at") - start).alias("n_tokens"),
                      F.lit(True).alias("closed")))
    last = per_file.where("open").select(
        "file", (F.col("base") + F.col("docs")).alias("ordinal"), (F.col("last") + 1).alias("file_start"),
        (F.col("token_base") + F.col("last") + 1).alias("token_start"), (F.col("tokens") - 1 - F.col("last")).alias("n_tokens"),
        F.lit(False).alias("closed"))
    return closed.unionByName(last)


def ordinals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal): 0-based position of each row by id, null ids last, numbered inside
    ranges of ids and shifted by the rows of earlier ranges."""
    layout = Layout(docs, id_col, text_col)
    ids = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), layout.block(F.col(id_col)).alias("block")))
    counts = ids.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = stored(counts.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    local = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_last())
    return ids.withColumn("i", F.row_number().over(local) - 1).join(shift, "block").select(
        "doc_id", (F.col("shift") + F.col("i")).alias("ordinal"))


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", eod: int = EOD) -> DataFrame:
    """Writes the documents' token files and scans them: doc_id, ordinal, token_start, n_tokens."""
    spark = docs.sparkSession
    folder = write_token_files(docs, shared_folder(spark), id_col, text_col, eod)
    counts = token_counts(token_files(spark, folder), 2, eod).select("ordinal", "token_start", "n_tokens")
    return ordinals(docs, id_col, text_col).join(counts, "ordinal").select("doc_id", "ordinal", "token_start", "n_tokens")
