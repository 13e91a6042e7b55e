"""Lightweight quality score (D7) and its per-repair delta.

One aggregate over the working table gives missing cells, duplicates, type errors
and rows, one over the truth its duplicates; the one-row results are cross-joined,
so the plan stays lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import normalize_missing, round_to, to_number

from .profile import NUMERIC_DTYPES, duplicates, expected_dtype, feature_columns, rules_dict

# Fixed weights from the reference score: missing, duplicates, types, rows.
WEIGHTS = (0.40, 0.20, 0.20, 0.20)


def components(working: DataFrame, truth: DataFrame, original_rows, label: str = "target", keys=(),
               rules=None, initial_missing=None) -> DataFrame:
    """One row: the four sub-scores, their inputs and the total.

    ``original_rows`` / ``initial_missing`` may be ints, one-row DataFrames with
    a column of that name, or None (initial_missing)."""
    rules = rules_dict(rules)
    feats = feature_columns(working, label, keys)
    rule_cols = [c for c in (rules.keys() if rules else feats) if c in feats]
    numeric_cols = [c for c in rule_cols if expected_dtype(rules, c) in NUMERIC_DTYPES]
    one = _counts(working, numeric_cols).crossJoin(duplicates(truth).select(F.col("n_duplicates").alias("gt_dups")))
    one = one.crossJoin(_scalar(working, original_rows, "original_rows"))
    if initial_missing is None:
        one = one.withColumn("initial_missing", F.lit(None).cast("long"))
    else:
        one = one.crossJoin(_scalar(working, initial_missing, "initial_missing"))
    return _scored(one)


def _scored(one: DataFrame) -> DataFrame:
    """Sub-scores and total from one row of counts."""
    denom = F.when(F.col("initial_missing").isNotNull() & (F.col("initial_missing") > 0), F.col("initial_missing")) \
        .otherwise(F.greatest(F.col("wc_missing"), F.lit(1)))
    missing_score = F.greatest(F.lit(0.0), 1.0 - F.col("wc_missing") / denom)
    dup_score = (F.when((F.col("gt_dups") == 0) & (F.col("wc_dups") == 0), F.lit(1.0))
                 .when(F.col("gt_dups") == 0, F.greatest(F.lit(0.0), 1.0 - F.col("wc_dups") / F.greatest(F.col("wc_rows"), F.lit(1))))
                 .otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("wc_dups") / F.greatest(F.col("gt_dups"), F.lit(1)))))
    type_score = F.when(F.col("type_total") > 0, F.col("type_ok") / F.col("type_total")).otherwise(F.lit(1.0))
    rows_score = F.least(F.col("wc_rows") / F.greatest(F.col("original_rows"), F.lit(1)), F.lit(1.0))
    total = (WEIGHTS[0] * missing_score + WEIGHTS[1] * dup_score + WEIGHTS[2] * type_score + WEIGHTS[3] * rows_score)
    return one.select("wc_missing", "wc_dups", "gt_dups", "type_ok", "type_total", "wc_rows", "original_rows",
                      missing_score.alias("missing_score"), dup_score.alias("dup_score"),
                      type_score.cast("double").alias("type_score"), rows_score.alias("rows_score"),
                      round_to(F.least(total, F.lit(1.0)), 4).alias("quality"))


def _counts(df: DataFrame, numeric_cols) -> DataFrame:
    """One row from one pass: rows, duplicates, missing cells (NaN too) and numeric columns
    without a type error.  Grouping by the whole row carries all four."""
    d = normalize_missing(df)
    g = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("__c"))
    cells = sum((F.col(c).isNull().cast("long") for c in d.columns), F.lit(0).cast("long"))
    wrong = [F.max(F.col(c).isNotNull() & to_number(c, d.schema[c].dataType).isNull()) for c in numeric_cols]
    ok = sum((F.when(F.coalesce(w, F.lit(False)), 0).otherwise(1) for w in wrong), F.lit(0)).cast("long")
    return g.agg(F.coalesce(F.sum(cells * F.col("__c")), F.lit(0)).alias("wc_missing"),
                 F.coalesce(F.sum("__c"), F.lit(0)).alias("wc_rows"),
                 F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("wc_dups"),
                 F.lit(len(numeric_cols)).cast("long").alias("type_total"), ok.alias("type_ok"))


# ---- counts kept under repairs ---------------------------------------------------------------

def kept_counts(df: DataFrame, numeric_cols) -> DataFrame:
    """One row that D7 and the C8 report need of a table, in a form that changes can update: rows, missing cells,
    duplicates and for each numeric column its type errors."""
    d = normalize_missing(df)
    one = d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("__after")).withColumn("__before", F.lit(0).cast("long"))
    return _difference(one, d.columns, numeric_cols)


def _difference(changes: DataFrame, cols, numeric_cols) -> DataFrame:
    """What rows whose copies went from ``__before`` to ``__after`` add to the counts."""
    by = F.col("__after") - F.col("__before")
    cells = sum((F.col(f"`{c}`").isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    spare = F.greatest(F.col("__after") - 1, F.lit(0)) - F.greatest(F.col("__before") - 1, F.lit(0))
    wrong = {c: F.col(c).isNotNull() & to_number(c, changes.schema[c].dataType).isNull() for c in numeric_cols}
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return changes.agg(total(by).alias("n_rows"), total(by * cells).alias("n_missing"), total(spare).alias("n_duplicates"),
                       *[total(F.when(w, by).otherwise(0)).alias(f"errors_{c}") for c, w in wrong.items()])


def updated_counts(counts: DataFrame, changes: DataFrame, numeric_cols) -> DataFrame:
    """``kept_counts`` after a repair, from the rows that it changed (``ChangeLog.changes``): the table is not read."""
    cols = [c for c in changes.columns if not c.startswith("__")]
    names = counts.columns
    return counts.unionByName(_difference(changes, cols, numeric_cols)).agg(*[F.sum(c).cast("long").alias(c) for c in names])


def score_counts(counts: DataFrame, numeric_cols, gt_dups, original_rows, initial_missing) -> DataFrame:
    """D7 from kept counts: the row of ``components``."""
    ok = sum((F.when(F.col(f"errors_{c}") == 0, 1).otherwise(0) for c in numeric_cols), F.lit(0)).cast("long")
    one = counts.select(F.col("n_missing").alias("wc_missing"), F.col("n_rows").alias("wc_rows"),
                        F.col("n_duplicates").alias("wc_dups"), F.lit(len(numeric_cols)).cast("long").alias("type_total"),
                        ok.alias("type_ok"), F.lit(gt_dups).cast("long").alias("gt_dups"),
                        F.lit(original_rows).cast("long").alias("original_rows"),
                        F.lit(initial_missing).cast("long").alias("initial_missing"))
    return _scored(one)


def _scalar(df: DataFrame, v, name: str) -> DataFrame:
    if isinstance(v, DataFrame):
        return F.broadcast(v.select(F.col(name).cast("long").alias(name)))
    return df.sparkSession.range(1).select(F.lit(v).cast("long").alias(name))


def score(working, truth, original_rows, label="target", keys=(), rules=None, initial_missing=None) -> DataFrame:
    """One row, ``quality`` in [0, 1] rounded to 4."""
    return components(working, truth, original_rows, label, keys, rules, initial_missing).select("quality")


def delta(before: DataFrame, after: DataFrame, truth: DataFrame, original_rows, label="target", keys=(),
          rules=None, initial_missing=None) -> DataFrame:
    """Quality before and after a repair and the change."""
    qb = score(before, truth, original_rows, label, keys, rules, initial_missing).select(F.col("quality").alias("q_before"))
    qa = score(after, truth, original_rows, label, keys, rules, initial_missing).select(F.col("quality").alias("q_after"))
    return qb.crossJoin(qa).select("q_before", "q_after", round_to(F.col("q_after") - F.col("q_before"), 4).alias("delta"))
