"""Repair plans: the flagship slice and the heuristic sequence.

The plan loop runs on the driver, but every stage is a Spark job: profiling,
advice, repairs and model fits.  The driver only reads the advice table (at
most four rows) and one-row metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import recommend as RC
from ..operators import repair as RP
from ..operators.versions import VersionedTable
from ..sources import tables as TB

# Task constants from the reference (easy task): accuracy target.
TARGET_ACCURACY = 0.79


def _payload(row, label_type) -> dict:
    d = row.asDict()
    p = {"action": d["action_type"], "column": d.get("col_name"), "strategy": d.get("strategy"),
         "n_synth": d.get("n_synth"), "target_count": d.get("target_count")}
    if d.get("cls") is not None:
        p["class"] = label_type(d["cls"])
    return p


def _label_type(df: DataFrame, label: str):
    t = df.schema[label].dataType.simpleString()
    return int if t in ("int", "bigint", "smallint", "tinyint") else (float if t in ("double", "float") else str)


def apply_top(df: DataFrame, recs: DataFrame, k: int, label: str, keys, seed=42) -> DataFrame:
    """Apply proposals 1..k in id order (the advice table is at most 4 rows)."""
    lt = _label_type(df, label)
    out = df
    for row in recs.where(F.col("rec_id") <= k).orderBy("rec_id").collect():
        out = RP.apply_action(out, _payload(row, lt), label, keys, seed)
    return out


def flagship(spark, sf_dir: str) -> DataFrame:
    """§7.3 slice: dirty documents -> profile -> cleaner advice -> apply top 2 ->
    quality score before and after (one row per stage, lazily evaluated)."""
    dirty = TB.dq_dirty(spark, sf_dir)
    truth = TB.dq_train(spark, sf_dir)
    orig = dirty.agg(F.count(F.lit(1)).alias("original_rows"))
    init = P.total_missing(dirty).select(F.col("total_missing").alias("initial_missing"))
    recs = RC.clean(dirty, "target", ["doc_id"])
    repaired = apply_top(dirty, recs, 2, "target", ["doc_id"])
    q0 = Q.components(dirty, truth, orig, "target", ["doc_id"], None, init).select(
        F.lit("before").alias("stage"), "wc_rows", "wc_missing", "wc_dups", "quality")
    q1 = Q.components(repaired, truth, orig, "target", ["doc_id"], None, init).select(
        F.lit("after_top2").alias("stage"), "wc_rows", "wc_missing", "wc_dups", "quality")
    return q0.unionByName(q1)


def auto_repair(spark, sf_dir: str, target_accuracy: float = TARGET_ACCURACY) -> DataFrame:
    """Inspect -> clean -> apply 1, 2 -> validate -> (below target) balance ->
    apply 1 -> validate.  One row per stage with rows, quality and RF / LR accuracy."""
    label, keys = "target", ["doc_id"]
    dirty = TB.dq_dirty(spark, sf_dir)
    truth = TB.dq_train(spark, sf_dir)
    n0 = dirty.count()
    init = P.total_missing(dirty).first()["total_missing"]
    vt = VersionedTable(dirty, checkpoint_every=1)  # each stage is measured several times: materialise it once
    stages = []

    def measure(stage, validate):
        q = Q.score(vt.current, truth, n0, label, keys, None, init).first()["quality"]
        rows = vt.current.count()
        rf = lr = None
        if validate:
            pred, _, _ = EV.run(vt.current, truth, label, keys)
            m = pred.agg(F.avg((F.col("label") == F.col("rf_pred")).cast("double")).alias("rf"),
                         F.avg((F.col("label") == F.col("lr_pred")).cast("double")).alias("lr")).first()
            rf, lr = m["rf"], m["lr"]
        stages.append((len(stages) + 1, stage, rows, float(q), rf, lr))
        return rf

    measure("inspect", False)
    recs = RC.clean(vt.current, label, keys)
    lt = _label_type(dirty, label)
    for row in recs.where(F.col("rec_id") <= 2).orderBy("rec_id").collect():
        vt.apply(RP.apply_action, _payload(row, lt), label, keys)
        measure(f"apply {row['action_type']} {row['col_name'] or ''}".strip(), False)
    acc = measure("validate", True)
    if acc is not None and acc < target_accuracy:
        bal = RC.balance(vt.current, label)
        for row in bal.where(F.col("rec_id") == 1).collect():
            vt.apply(RP.apply_action, _payload(row, lt), label, keys)
            measure(f"apply {row['action_type']}", False)
        measure("validate", True)
    schema = "step int, stage string, n_rows long, quality double, rf_accuracy double, lr_accuracy double"
    return spark.createDataFrame(stages, schema)
