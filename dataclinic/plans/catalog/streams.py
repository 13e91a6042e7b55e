"""Family T: Structured Streaming forms.  Their oracles are the batch rules in SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...session import cut_lineage, ensure_checkpoint_dir
from ...sources import tables as TB
from ...sources import trajectories as TJ
from ...streaming.audit_stream import audit_stream
from ...streaming.curriculum_stream import curriculum_stream
from ...streaming.monitor import RANK_ERROR, merged_profile, quality_monitor
from ...streaming.ordered import rocksdb_state
from . import register
from .common import r6
from .profiling import LI_FEATS, stats_sql
from .runlogs import curriculum_sql
from .sqlgen import r6 as s6
from .trajectories import _DBL, _LIMITS_SQL, _fsm_sql


def _scratch(spark, tag):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex[:8]}"


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def table_stream(spark, sf, name, schema, files_per_trigger=None):
    """One driver table as a file stream.  A folder of part files is the source itself; a
    single file is its directory, filtered to that name."""
    path, r = f"{sf.rstrip('/')}/{name}.parquet", spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf.rstrip("/"))


#: Event time of the marker that ends a replay: it takes the watermark past every row and timer.
END = dt.datetime(9000, 1, 1)
#: No episode or run of a stored table is given up as idle.
NEVER_US = 100 * 365 * 24 * 3600 * 1_000_000
#: Rows of a stored table wait in buckets of a day.
DAY_US = 24 * 3600 * 1_000_000
#: A shard of a stored table has about so many rows; its files come in so many batches at most.
SHARD_ROWS, BATCHES = 20_000, 8


def disorder(table, ts="ts"):
    """Seconds by which rows of a file are older than the newest row of earlier files (in the stream's order: by
    time of change): the least watermark delay that loses none when a batch is a file.  One row a file."""
    f = table.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).agg(
        F.min(ts).cast("timestamp").alias("lo"), F.max(ts).cast("timestamp").alias("hi"))
    # a file may be met in any batch of its millisecond, so all files of an equal time count as earlier
    w = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.max("hi").over(w).cast("double") - F.col("lo").cast("double")
    return float(f.select(back.alias("b")).agg(F.max("b")).first()[0] or 0.0)


class Replay:
    """A stored events table as a stream of many batches, ended by a marker.

    The files come in ``BATCHES`` batches at most, in no order of time; the watermark's delay covers their disorder.  A second, small
    source holds the marker rows: it is empty in the first run; the second run, from the same checkpoint, reads the
    markers, which release what still waits and fire the timers that are left."""

    def __init__(self, spark, sf):
        self.spark, self.markers = spark, _scratch(spark, "markers")
        path = f"{sf.rstrip('/')}/events.parquet"
        table = spark.read.parquet(path)
        several = _is_folder(spark, path)
        self.watermark = f"{max(600, int(disorder(table)) + 1) if several else 600} seconds"
        files = len(table.inputFiles()) if several else 1
        self.parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        self.shards = max(4 * self.parts, -(-table.count() // SHARD_ROWS))
        self.empty = table.limit(0)
        self.empty.write.parquet(self.markers)
        marks = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(self.markers)
        self.rows = table_stream(spark, sf, "events", table.schema, -(-files // BATCHES)).unionByName(marks)

    def run(self, build, tag):
        out, ck = _scratch(self.spark, tag), _scratch(self.spark, tag + "-ck")
        with rocksdb_state(self.spark, self.parts):
            for last in (False, True):
                if last:
                    for k in range(2):  # the first moves the watermark, the second is the batch that sees it
                        mark = self.spark.range(1).select(*[
                            F.lit(END + dt.timedelta(days=k)).cast(f.dataType).alias(f.name) if f.name == "ts" else
                            F.lit(None).cast(f.dataType).alias(f.name) for f in self.empty.schema.fields])
                        mark.coalesce(1).write.mode("append").parquet(self.markers)
                q = build().writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
                    .outputMode("append").trigger(availableNow=True).start()
                q.awaitTermination()
        return self.spark.read.parquet(out)


_T1_SQL = f"""{_fsm_sql()},
{_LIMITS_SQL.split("AS budget_remaining FROM e0),", 1)[-1].lstrip()}
, fs AS (SELECT episode_id, min(epoch_us(ts)) + 300000000 AS due, min(epoch_us(ts)) FILTER (WHERE cmd = 'submit') AS done
  FROM e GROUP BY episode_id)
SELECT e.episode_id, e.step, e.event_id, epoch_us(e.ts) AS ts_us, e.cmd, false AS forced,
  CASE WHEN e.cmd = 'validate' THEN o.allowed END AS validate_allowed,
  CASE WHEN e.cmd = 'validate' THEN o.allowed AND o.cache = 0 END AS validate_counted,
  CASE WHEN o.allowed AND o.cache = 0 THEN CASE WHEN o.cnt < 3 THEN 0.02 ELSE -0.01 END ELSE 0.0 END::DOUBLE AS validate_bonus,
  e.budget_used::BIGINT AS budget_used,
  e.budget_total - (e.budget_used - CASE WHEN e.cmd IN ({_DBL}) THEN 1 ELSE 0 END) < 0 AS exhausted,
  epoch_us(e.ts) > fs.due AS timed_out,
  CASE WHEN e.cmd <> 'apply' THEN NULL WHEN j.arg < 1 THEN 'invalid_id' WHEN j.applies_before >= 3 THEN 'session_limit'
    WHEN j.dup THEN 'duplicate' WHEN NOT j.offered THEN 'stale' ELSE 'ok' END AS apply_outcome, 0.0::DOUBLE AS penalty
FROM e JOIN o ON o.episode_id = e.episode_id AND o.step = e.step JOIN fs ON fs.episode_id = e.episode_id
  LEFT JOIN j ON j.episode_id = e.episode_id AND j.step = e.step
UNION ALL
SELECT fs.episode_id, NULL, NULL, fs.due, 'submit', true, NULL, NULL, 0.0,
  (SELECT coalesce(max(e.budget_used), 0) FROM e WHERE e.episode_id = fs.episode_id AND epoch_us(e.ts) <= fs.due)::BIGINT,
  false, true, NULL, -0.10 FROM fs WHERE done IS NULL OR done > due"""


@register("t1_audit_stream", _T1_SQL)
def t1_audit_stream(spark, sf):
    r = Replay(spark, sf)
    e = r.rows.withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.select("event_id", "ts", *[F.expr(TJ._EXPRS[k]).alias(k) for k in ("episode_id", "action", "n_recs")])
    return r.run(lambda: audit_stream(a, TJ.BUDGET, r.watermark, NEVER_US, END, DAY_US, r.shards), "audit")


@register("t2_curriculum_stream", f"""WITH {TB.sql_ctes('runs')}, {curriculum_sql(5, 0.6)}
SELECT run_id, episode, CAST(level AS INTEGER) AS level, advanced FROM rl""")
def t2_curriculum_stream(spark, sf):
    r = Replay(spark, sf)
    e = r.rows.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                      (F.col("value") > 50).alias("success"))
    return r.run(lambda: curriculum_stream(e, 5, 0.6, watermark=r.watermark, idle_us=NEVER_US, end=END, bucket_us=DAY_US,
                                          shards=r.shards),
                 "curriculum")


def _monitored(spark, sf, sketches=False):
    path = f"{sf.rstrip('/')}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    cols = TB.LINEITEM_COLS
    stream = table_stream(spark, sf, "lineitem", schema, files_per_trigger=1).select(*cols)
    out, ck, sk = _scratch(spark, "monitor"), _scratch(spark, "monitor-ck"), _scratch(spark, "monitor-sketch")
    q = quality_monitor(stream, TB.lineitem_clean(spark, sf), out, ck, "l_returnflag", TB.LINEITEM["keys"],
                        sketch_path=sk if sketches else None)
    q.awaitTermination()
    return spark.read.parquet(sk if sketches else out)


@register("t3_quality_monitor", f"""WITH {TB.sql_ctes('lineitem_clean')}, w AS ({stats_sql('lineitem_clean', LI_FEATS)})
SELECT col_name, (SELECT count(*) FROM lineitem_clean)::BIGINT AS n_rows, (SELECT count(*) FROM lineitem_clean)::BIGINT - n::BIGINT
  AS n_missing, 0::BIGINT AS type_errors, round(mean, 3) AS mean, round(std, 3) AS std, 0.0::DOUBLE AS drift, 'NONE' AS level,
  0::BIGINT AS batch_id FROM w""")
def t3_quality_monitor(spark, sf):
    return _monitored(spark, sf).withColumns({c: F.round(c, 3) for c in ("mean", "std")})


@register("t3_merged_sketches", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, count({c})::BIGINT AS n, {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std, "
    f"true AS median_in_bound FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def t3_merged_sketches(spark, sf):
    """All batches' sketches merged: exact moments, and a median whose rank in the table is within the stated error."""
    sk = _monitored(spark, sf, sketches=True)
    prof = cut_lineage(merged_profile(sk, ["col_name"]))
    t = TB.lineitem_clean(spark, sf)
    cols = [r["col_name"] for r in prof.select("col_name").collect()]  # the profiled columns
    med = prof.groupBy().pivot("col_name", cols).agg(F.first("median"))
    med = med.select(*[F.col(f"`{c}`").alias(f"__m_{c}") for c in cols])
    ranks = t.crossJoin(F.broadcast(med)).agg(*[x for c in cols for x in (  # one row
        F.avg((F.col(c) < F.col(f"__m_{c}")).cast("double")).alias(f"lo_{c}"),
        F.avg((F.col(c) <= F.col(f"__m_{c}")).cast("double")).alias(f"hi_{c}"))])
    ok = ranks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), (
        (F.col(f"lo_{c}") <= 0.5 + RANK_ERROR) & (F.col(f"hi_{c}") >= 0.5 - RANK_ERROR)).alias("median_in_bound")) for c in cols])).alias("r")).select("r.*")
    return r6(prof.join(ok, "col_name").select("col_name", "n", "mean", "std", "median_in_bound"))
