"""Micro-batch quality monitor with ``foreachBatch``.

Every micro-batch is profiled (one-pass stats) and compared with a fixed
baseline profile (drift per column); one row per (batch, column) is appended
to a metrics table in shared storage.  With ``sketch_path`` the batch's power sums and a quantile sketch (KLL) of
each column are kept too: both merge, so any span of batches has a profile without reading the batches again
(``span_profile``), and each batch can be compared with the span before it (``trailing_drift``).  The batch id makes the
append idempotent on retry (rows of a replayed batch overwrite their own partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import drift_label, to_number
from ..operators import drift as DR
from ..operators import profile as P
from ..session import cut_lineage

SKETCH_K = 400
#: Rank error of a merged median that callers may rely on (the sketch's own bound at this size is under 1 %).
RANK_ERROR = 0.02


def _append(out: DataFrame, batch_id: int, path: str) -> None:
    (out.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def batch_sketch(batch: DataFrame, centres: dict, k: int = SKETCH_K) -> DataFrame:
    """(col_name, centre, n, s1, s2, s3, sketch) per column of ``centres`` (column -> number near its mean): power sums
    about the centre and a quantile sketch, from one pass."""
    x = {c: to_number(c, batch.schema[c].dataType) for c in centres}
    aggs = []
    for i, (c, m) in enumerate(centres.items()):
        d = x[c] - F.lit(float(m))
        aggs += [F.count(x[c]).alias(f"n{i}"), *[F.coalesce(F.sum(F.pow(d, F.lit(p))), F.lit(0.0)).alias(f"s{p}_{i}") for p in (1, 2, 3)],
                 F.kll_sketch_agg_double(x[c], F.lit(k)).alias(f"k{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(float(m)).alias("centre"), F.col(f"n{i}").alias("n"),
                              *[F.col(f"s{p}_{i}").alias(f"s{p}") for p in (1, 2, 3)], F.col(f"k{i}").alias("sketch"))
                     for i, (c, m) in enumerate(centres.items())])
    return batch.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def merged_profile(sketches: DataFrame, by) -> DataFrame:
    """Sketch rows merged within ``by`` (which holds col_name): n, mean, std, skew, median."""
    m = sketches.where("n > 0").groupBy(*by).agg(F.first("centre").alias("c"), F.sum("n").alias("n"), *[F.sum(f"s{p}").alias(f"s{p}") for p in (1, 2, 3)],
                                 F.kll_merge_agg_double("sketch").alias("sketch"))
    n = F.col("n").cast("double")
    a, b, t = (F.col(f"s{p}") / n for p in (1, 2, 3))
    m2, m3 = b - a * a, t - 3 * a * b + 2 * a * a * a
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) * n / (n - 1))).otherwise(0.0)
    skew = F.when((F.col("n") > 2) & (m2 > 0), m3 / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    return m.select(*by, "n", (F.col("c") + a).alias("mean"), std.alias("std"), skew.alias("skew"),
                    F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"))


def span_profile(sketches: DataFrame, first: int, last: int) -> DataFrame:
    """Profile of the batches first..last: one row a column."""
    return merged_profile(sketches.where(F.col("batch_id").between(first, last)), ["col_name"])


def trailing_drift(sketches: DataFrame, span: int) -> DataFrame:
    """Each batch against the ``span`` batches before it: shift of the median in standard deviations of the span,
    change of the skew.  Works on one row per batch and column."""
    own = merged_profile(sketches, ["batch_id", "col_name"])
    ahead = sketches.withColumn("batch_id", F.explode(F.sequence(F.col("batch_id") + 1, F.col("batch_id") + span)))
    base = merged_profile(ahead, ["batch_id", "col_name"]).select(
        "batch_id", "col_name", F.col("median").alias("m0"), F.col("std").alias("sd0"), F.col("skew").alias("k0"), F.col("n").alias("n_span"))
    return own.join(base, ["batch_id", "col_name"]).select(
        "batch_id", "col_name", "n", "n_span", ((F.col("median") - F.col("m0")) / (F.col("sd0") + DR.DRIFT_EPS)).alias("median_shift"),
        (F.col("skew") - F.col("k0")).alias("skew_change"))


def make_batch_fn(baseline_profile: DataFrame, out_path: str, label: str, keys, sketch_path: str | None = None):
    centres = {r["col_name"]: r["mean"] or 0.0 for r in baseline_profile.collect()} if sketch_path else {}  # a row a column

    def fn(batch: DataFrame, batch_id: int) -> None:
        st = P.column_stats(batch, label, keys, with_median=False).persist()  # one row a column: one read of the batch
        try:
            dr = DR.between(st, baseline_profile).select("col_name", "drift")
            out = st.select("col_name", "n_rows", "n_missing", "type_errors", "mean", "std").join(dr, "col_name")
            _append(out.withColumn("level", drift_label("drift")), batch_id, out_path)
        finally:
            st.unpersist()
        if sketch_path:
            _append(batch_sketch(batch, centres), batch_id, sketch_path)

    return fn


def quality_monitor(stream: DataFrame, baseline: DataFrame, out_path: str, checkpoint: str, label: str, keys,
                    trigger: dict | None = None, sketch_path: str | None = None):
    """Start the monitor; returns the StreamingQuery.  The baseline table is profiled once
    and its profile stored; micro-batches never read the table."""
    profile = cut_lineage(DR.profile(baseline, label, keys))
    w = stream.writeStream.foreachBatch(make_batch_fn(profile, out_path, label, keys, sketch_path)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
