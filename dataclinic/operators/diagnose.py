"""Analyst diagnosis (B8-B10): severities, ranked problems and an action plan.

Severities come from one-row aggregates; ranking and the plan operate on a
three-row table, so the small windows here are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import severity_label
from .profile import column_stats, feature_columns, total_missing

# Fixed values from the reference analyst.
MISSING_WEIGHT = 5.0
TYPE_WEIGHT = 10.0
PLAN_MIN_SEVERITY = 0.1
PLAN_MAX_PROBLEMS = 3
LOW_BUDGET = 8
CLOSE_GAP = 0.02
NEAR_GAP = 0.05
PRIORITY_MIN = 0.2
# problem name, specialist, tie order (stable sort keeps this order on equal severity)
PROBLEMS = (("class imbalance", "query_balancer", 0), ("missing values", "query_cleaner", 1),
            ("type errors", "query_cleaner", 2))


def severities(df: DataFrame, label: str = "target", keys=(), rules=None, current_accuracy: float = 0.0,
               target_accuracy: float = 0.0) -> DataFrame:
    """One row with missing / imbalance / type severities and the accuracy gap."""
    feats = feature_columns(df, label, keys)
    st = column_stats(df, label, keys, rules=rules, with_median=False).agg(
        F.max("n_rows").alias("n_rows"), F.coalesce(F.sum("type_errors"), F.lit(0)).alias("type_errors"))
    tm = total_missing(df)
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    cls = c.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    j = st.crossJoin(tm).crossJoin(cls)
    cells = F.greatest(F.col("n_rows"), F.lit(1)) * F.lit(max(len(feats), 1))
    return j.select(
        F.least(F.lit(1.0), F.col("total_missing") / cells * MISSING_WEIGHT).alias("missing_severity"),
        F.when(F.col("n_classes") >= 2, 1.0 - F.col("min_n") / F.col("max_n")).otherwise(F.lit(0.0))
        .alias("imbalance_severity"),
        F.least(F.lit(1.0), F.col("type_errors") / cells * TYPE_WEIGHT).alias("type_severity"),
        F.greatest(F.lit(0.0), F.lit(float(target_accuracy)) - F.lit(float(current_accuracy))).alias("accuracy_gap"))


def rank(sev: DataFrame) -> DataFrame:
    """The three problems by severity desc (ties keep imbalance, missing, type), labelled."""
    arr = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(c).alias("severity"), F.lit(s).alias("specialist"),
                             F.lit(o).alias("tie"))
                    for (n, s, o), c in zip(PROBLEMS, ["imbalance_severity", "missing_severity", "type_severity"])])
    p = sev.select(F.explode(arr).alias("p")).select("p.*")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("severity").desc(), F.col("tie"))
    return p.select(F.row_number().over(w).alias("rank"), "problem", "severity",
                    severity_label("severity").alias("level"), "specialist")


def plan(sev: DataFrame, budget_remaining: int) -> DataFrame:
    """Ordered steps (up to 3 specialists with severity >= 0.1, validate, then submit
    guidance) and an optional priority note."""
    r = rank(sev).where(F.col("severity") >= PLAN_MIN_SEVERITY).where(F.col("rank") <= PLAN_MAX_PROBLEMS)
    fix = r.select(F.col("rank").alias("ord"), F.concat(F.col("specialist"), F.lit(" -> apply best recommendation"))
                   .alias("action"))
    gap = F.col("accuracy_gap")
    tail_guidance = (F.when(F.lit(budget_remaining) <= LOW_BUDGET, F.lit(
        f"submit NOW - budget is critically low ({budget_remaining} steps left)"))
        .when(gap < CLOSE_GAP, F.lit("submit - you are very close to target"))
        .otherwise(F.lit("Repeat if accuracy gap remains > 0.02, then submit")))
    note = (F.when((F.col("imbalance_severity") > F.col("missing_severity")) & (F.col("imbalance_severity") > PRIORITY_MIN),
                   F.lit("PRIORITY NOTE: Class imbalance is the dominant issue - fix this first."))
            .when(F.col("missing_severity") > PRIORITY_MIN,
                  F.lit("PRIORITY NOTE: High missing-value rate - clean data before augmenting.")))
    tail = sev.select(F.explode(F.array(
        F.struct(F.lit(10).alias("ord"), F.lit("validate (check accuracy improvement)").alias("action")),
        F.struct(F.lit(11).alias("ord"), tail_guidance.alias("action")),
        F.struct(F.lit(12).alias("ord"), F.when(F.lit(budget_remaining) <= LOW_BUDGET,
                                                F.lit("NOTE: Skip query_validator (costs 2 budget).")).alias("action")),
        F.struct(F.lit(13).alias("ord"), note.alias("action")))).alias("t")).select("t.*").where(F.col("action").isNotNull())
    u = fix.unionByName(tail)
    w = Window.partitionBy(F.lit(0)).orderBy("ord")
    return u.select(F.row_number().over(w).alias("step"), "action")
