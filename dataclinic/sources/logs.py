"""JSON-lines run logs, example files and metric tables (IO1-IO5).

Reads use an explicit schema in PERMISSIVE mode: blank lines are skipped,
malformed lines land in ``_corrupt_record`` and are counted, never fail the
job.  Normalisation keeps the reference's rules: old key names are mapped,
and a column missing from *every* record of a file gets its default (decided by
one aggregated row a file, so the plan stays lazy).
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import round_to
from ..session import cut_lineage

LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()), T.StructField("episode", T.LongType()),
    T.StructField("task", T.StringType()), T.StructField("level", T.IntegerType()),
    T.StructField("reward", T.DoubleType()), T.StructField("accuracy_gain", T.DoubleType()),
    T.StructField("steps_used", T.IntegerType()), T.StructField("success", T.BooleanType()),
    T.StructField("curriculum_stage", T.StringType()), T.StructField("note", T.StringType()),
    # step-log keys (old format)
    T.StructField("step", T.LongType()), T.StructField("stage", T.StringType()),
    T.StructField("mean_total_reward", T.DoubleType()), T.StructField("mean_env_reward", T.DoubleType()),
    T.StructField("mean_format_reward", T.DoubleType()), T.StructField("format_rate", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])
SUCCESS_GAIN = 0.05
EXAMPLE_SCHEMA = "prompt string, response string"
FILES_A_FOLDER = 1000


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    found = fs.globStatus(p)  # a path or a pattern
    return found is not None and len(found) > 0


def write_runs(lines: DataFrame, path: str, run: str = "run_id", order: str = "episode", value: str = "value",
               files_a_folder: int = FILES_A_FOLDER) -> None:
    """One file a run (an integer, or null: a run like any other), lines in ``order``; ``path`` is new.

    On a shared ``file:`` folder the tasks write the files themselves: there Hadoop starts processes for each file
    to set modes, and a folder a run makes the listing one Spark task a run.  Any other store gets Spark's own writer."""
    rows = lines.repartition(run).sortWithinPartitions(run, order).select(run, value)
    fs, p = _hadoop(lines.sparkSession, path)
    if fs.getUri().getScheme() != "file":
        rows.write.partitionBy(run).text(path)
        return
    root = unquote(urlparse(fs.makeQualified(p).toUri().toString()).path)
    os.makedirs(root)
    # a task's folders are its own until it has ended, and only those of ended tasks are moved into place
    folders = rows.mapInArrow(_run_files(f"{root}/_temporary", files_a_folder), "folder string").collect()
    for i, (folder,) in enumerate(folders):
        os.rename(folder, f"{root}/folder={i}")


def _run_files(root: str, most: int):
    """mapInArrow function: writes (run, line) rows, sorted by run, to one file a run in new folders under ``root``
    of at most ``most`` files, and returns the folders."""
    def write(batches):
        folders, files, now, out = [], 0, None, None
        for batch in batches:
            runs, values = batch.columns
            ids, null = runs.fill_null(0).to_numpy(), runs.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero((np.diff(ids) != 0) | (null[1:] != null[:-1])) + 1
            bounds = [0, *starts.tolist(), len(batch)] if len(batch) else [0]
            for a, b in zip(bounds, bounds[1:]):
                name = "null" if null[a] else str(ids[a])
                if name != now:
                    if out:
                        out.close()
                    if files % most == 0:
                        folders.append(f"{root}/{uuid.uuid4().hex}")
                        os.makedirs(folders[-1])
                    now, out, files = name, open(f"{folders[-1]}/{name}.jsonl", "wb"), files + 1
                out.writelines(f"{x or ''}\n".encode() for x in values.slice(a, b - a).to_pylist())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string())], ["folder"])
    return write


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """IO1: all records plus ``_file`` and ``_pos`` (order inside the file);
    an empty frame when the path does not exist.  Malformed lines keep
    ``_corrupt_record`` set (see ``corrupt_count``)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA).withColumns(
            {"_file": F.lit(None).cast("string"), "_pos": F.lit(None).cast("long")})
    raw = (spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"),
                           "__mid": F.monotonically_increasing_id()})
    # parse once into a parquet table (shared folder): later stages never re-parse JSON,
    # and the ids taken from the scan (consecutive inside a split of a file) are frozen
    raw = cut_lineage(raw)
    # position inside each file: the id less the split's first, plus the rows of the file's earlier splits
    blocks = raw.groupBy("_file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    earlier = Window.partitionBy("_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    blocks = blocks.select("_file", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1)
                           .alias("__shift"))
    d = raw.join(blocks, ["_file", "__block"], "left")  # left: dropped where no position is asked for
    return d.select(*[c for c in raw.columns if c not in ("__block", "__mid")],
                    (F.col("__mid") + F.col("__shift")).cast("bigint").alias("_pos"))


def corrupt_count(records: DataFrame) -> DataFrame:
    """Malformed lines (``read_runs`` output is a parquet table, so the corrupt
    column can be queried on its own)."""
    return records.agg(F.sum(F.col("_corrupt_record").isNotNull().cast("long")).alias("corrupt_lines"))


def normalize(records: DataFrame) -> DataFrame:
    """IO2, per file: rename mean_total_reward -> reward, mean_env_reward ->
    accuracy_gain, stage -> task (task wins when both exist); default episode =
    position (0-based) in the file, level = 0, success = gain > 0.05, gain = reward
    = 0.0 -- each default only when the key is absent from every record of its file.
    ``run_id`` names the file without its extension, so the output feeds the run-log
    analytics; rows are numbered by episode there, no global order is imposed here."""
    good = records.where(F.col("_corrupt_record").isNull())
    flags = ("episode", "level", "success", "reward", "mean_total_reward", "accuracy_gain", "mean_env_reward")
    present = good.groupBy("_file").agg(*[F.max(F.col(c).isNotNull()).alias(f"__has_{c}") for c in flags])
    present = present.withColumnRenamed("_file", "__f")
    d = good.join(present, good["_file"].eqNullSafe(present["__f"]))
    has = lambda c: F.col(f"__has_{c}")
    reward = F.when(has("reward"), F.col("reward")).when(has("mean_total_reward"), F.col("mean_total_reward"))
    gain = F.when(has("accuracy_gain"), F.col("accuracy_gain")).when(has("mean_env_reward"), F.col("mean_env_reward"))
    reward_any = has("reward") | has("mean_total_reward")
    gain_any = has("accuracy_gain") | has("mean_env_reward")
    return d.select(
        "_file", F.regexp_extract("_file", r"([^/]*?)(\.[^./]*)?$", 1).alias("run_id"),
        F.when(has("episode"), F.col("episode")).otherwise(F.col("_pos") - 1).alias("episode"),
        F.coalesce(F.col("task"), F.col("stage")).alias("task"),
        F.when(has("level"), F.col("level")).otherwise(F.lit(0)).alias("level"),
        F.when(reward_any, reward).otherwise(F.lit(0.0)).alias("reward"),
        F.when(gain_any, gain).otherwise(F.lit(0.0)).alias("accuracy_gain"),
        F.when(has("success"), F.col("success")).otherwise(
            F.when(gain_any, gain > SUCCESS_GAIN).otherwise(F.lit(False))).alias("success"),
        "ts", "steps_used", "curriculum_stage", "note")


def append(df: DataFrame, path: str) -> None:
    """IO3: append one JSON record per episode; reward and gain rounded to 4."""
    df.withColumns({"reward": round_to("reward", 4), "accuracy_gain": round_to("accuracy_gain", 4)}) \
        .write.mode("append").json(path)


def append_stream(sdf: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """IO3 streaming form: a file sink with a checkpoint (exactly-once appends of
    JSON records); returns the StreamingQuery."""
    out = sdf.withColumns({"reward": round_to("reward", 4), "accuracy_gain": round_to("accuracy_gain", 4)})
    w = out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return w.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def write_examples(df: DataFrame, path: str) -> None:
    """IO4: {prompt, response} per line."""
    df.select("prompt", "response").write.mode("overwrite").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """IO4."""
    return spark.read.schema(EXAMPLE_SCHEMA).option("mode", "PERMISSIVE").json(path)


def write_metrics(episodes: DataFrame, summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO5: the per-episode table and the summary table (task NULL = overall)."""
    episodes.write.mode("overwrite").format(fmt).save(f"{path}/episodes")
    summary.write.mode("overwrite").format(fmt).save(f"{path}/summary")


def read_metrics(spark: SparkSession, path: str, fmt: str = "parquet"):
    return spark.read.format(fmt).load(f"{path}/episodes"), spark.read.format(fmt).load(f"{path}/summary")
