"""Distribution drift (D5-D6): one stats pass per side, joined on the column name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_to

from ..functions.expr import drift_label
from .profile import column_stats, feature_columns

DRIFT_EPS = 1e-8
TOP_N = 5


def profile(df: DataFrame, label: str = "target", keys=(), features=None) -> DataFrame:
    """What drift needs of a table: one row a column (col_name, pos, n, mean, std)."""
    return column_stats(df, label, keys, features, with_median=False).select("col_name", "pos", "n", "mean", "std")


def between(working: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drift of one profile against another, for the columns of ``working``."""
    w = working.select("col_name", "pos", F.col("n").alias("n_w"), F.col("mean").alias("mean_w"), F.col("std").alias("std_w"))
    t = baseline.select("col_name", F.col("n").alias("n_t"), F.col("mean").alias("mean_t"), F.col("std").alias("std_t"))
    j = w.join(t, "col_name", "left")
    score = (F.abs(F.col("mean_w") - F.col("mean_t")) / (F.col("std_t") + DRIFT_EPS)
             + F.abs(1.0 - F.col("std_w") / (F.col("std_t") + DRIFT_EPS)))
    ok = (F.col("n_w") > 0) & F.coalesce(F.col("n_t") > 0, F.lit(False))
    return j.select("col_name", "pos", F.when(ok, round_to(score, 3)).otherwise(F.lit(0.0)).alias("drift"))


def compute(working: DataFrame, truth: DataFrame, label: str = "target", keys=()) -> DataFrame:
    """Per working feature: |mean_w - mean_t| / (std_t + 1e-8) + |1 - std_w / (std_t + 1e-8)|,
    rounded to 3; 0 when either side has no numeric value or the column is absent in truth."""
    feats = feature_columns(working, label, keys)
    shared = [c for c in feats if c in truth.columns]
    return between(profile(working, label, keys, feats), profile(truth, label, keys, shared))


def top(drift: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n most drifted columns with their label (TakeOrderedAndProject)."""
    return (drift.orderBy(F.col("drift").desc(), F.col("pos").asc()).limit(n)
            .select("col_name", "drift", drift_label("drift").alias("level")))
