"""Repair recommendations (family B): ranked tables of proposed fixes.

Every proposal is computed from the one-pass stats table (one row per column)
or the class-count table (one row per class); windows used here only run over
those small tables (bounded by the number of columns or classes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import round_to

from ..functions.expr import impute_strategy, missing_risk
from .integrity import fingerprint
from .profile import class_entropy, column_stats, duplicates

# Fixed values from the reference specialists ---------------------------------------------------
CLEAN_KEEP = 4
FILL_CONF = (0.92, 0.5, 0.60)          # confidence = max(0.60, 0.92 - 0.5 * frac)
FILL_IMPACT = (0.03, 0.3, 0.12)        # impact = min(0.03 + 0.3 * frac, 0.12)
DEDUPE_IMPACT = (0.02, 0.15, 0.08)
DEDUPE_CONF = 0.92
TYPE_IMPACT = (0.04, 0.2, 0.10)
TYPE_CONF = 0.88
AUGMENT_IMPACT = (0.04, 0.4, 0.10)
AUGMENT_CONF = 0.82
AUGMENT_TOP = 3
AUGMENT_MIN_SYNTH = 5
OVERSAMPLE_IMPACT = (0.05, 0.15, 0.12)
OVERSAMPLE_CONF = 0.80
UNDERSAMPLE_IMPACT = (0.03, 0.08, 0.08)
UNDERSAMPLE_CONF = 0.75
UNDERSAMPLE_BELOW = 0.5
RISK_RATIO = 0.3

KIND = 1 << 40  # emission order: kind of proposal, then column position
REC_COLS = ["rec_id", "action_type", "col_name", "strategy", "cls", "n_synth", "target_count",
            "estimated_impact", "confidence", "risk", "description"]


def _rec(action, col=None, strategy=None, cls=None, n_synth=None, target=None, impact=None, conf=None,
         risk=None, desc=None, emit_pos=None):
    s, i, d, l_ = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit
    return [l_(action).alias("action_type"), (col if col is not None else s).alias("col_name"),
            (strategy if strategy is not None else s).alias("strategy"),
            (cls.cast("string") if cls is not None else s).alias("cls"),
            (n_synth.cast("long") if n_synth is not None else i).alias("n_synth"),
            (target.cast("long") if target is not None else i).alias("target_count"),
            impact.alias("estimated_impact"), conf.cast("double").alias("confidence"),
            (risk if risk is not None else s).alias("risk"), (desc if desc is not None else s).alias("description"),
            emit_pos.cast("bigint").alias("emit_pos")]


def fill_missing(stats: DataFrame) -> DataFrame:
    """B1 over ``profile.column_stats`` rows."""
    s = stats.where(F.col("n_missing") > 0)
    frac = F.col("n_missing") / F.col("n_rows")
    strat, val, reason = impute_strategy("skew", "mean", "median")
    conf = round_to(F.greatest(F.lit(FILL_CONF[2]), FILL_CONF[0] - frac * FILL_CONF[1]), 2)
    impact = round_to(F.least(FILL_IMPACT[0] + frac * FILL_IMPACT[1], F.lit(FILL_IMPACT[2])), 3)
    risk = missing_risk(frac)
    desc = F.format_string("Fill %d/%d (%.1f%%) missing values in '%s' using %s (%.2f). Reason: %s. Risk: %s.",
                           F.col("n_missing"), F.col("n_rows"), frac * 100, F.col("col_name"), strat, val, reason, risk)
    return s.select(*_rec("fill_missing", F.col("col_name"), strat, impact=impact, conf=conf, risk=risk, desc=desc,
                          emit_pos=F.col("pos")))


def dedupe(df: DataFrame) -> DataFrame:
    """B2 from the duplicate count."""
    d = duplicates(df).where(F.col("n_duplicates") > 0)
    frac = F.col("n_duplicates") / F.col("n_rows")
    impact = round_to(F.least(DEDUPE_IMPACT[0] + frac * DEDUPE_IMPACT[1], F.lit(DEDUPE_IMPACT[2])), 3)
    desc = F.format_string("Remove %d duplicate rows (%.1f%% of dataset). Risk: LOW.", F.col("n_duplicates"), frac * 100)
    return d.select(*_rec("remove_duplicates", impact=impact, conf=F.lit(DEDUPE_CONF), risk=F.lit("LOW"), desc=desc,
                          emit_pos=F.lit(KIND)))


def type_fix(stats: DataFrame) -> DataFrame:
    """B3 over numeric-typed columns with non-numeric values."""
    s = stats.where(F.col("numeric_expected") & (F.col("type_errors") > 0))
    frac = F.col("type_errors") / F.col("n_rows")
    impact = round_to(F.least(TYPE_IMPACT[0] + frac * TYPE_IMPACT[1], F.lit(TYPE_IMPACT[2])), 3)
    desc = F.format_string("Fix %d type errors (%.1f%%) in '%s' (non-numeric values coerced, then filled with mean). "
                           "Risk: LOW.", F.col("type_errors"), frac * 100, F.col("col_name"))
    return s.select(*_rec("fix_type_errors", F.col("col_name"), impact=impact, conf=F.lit(TYPE_CONF),
                          risk=F.lit("LOW"), desc=desc, emit_pos=F.lit(2 * KIND) + F.col("pos")))


def clean(df: DataFrame, label: str = "target", keys=(), rules=None, keep: int = CLEAN_KEEP,
          stats: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """B1-B3 unioned, sorted by impact desc (stable on emission order), top ``keep``, ids from 1.
    ``rejected`` proposals (B12) leave before the ranking, so the next one moves up.
    The window runs over at most 2 x columns + 1 rows."""
    st = stats if stats is not None else column_stats(df, label, keys, rules=rules)
    u = fill_missing(st).unionByName(dedupe(df)).unionByName(type_fix(st))
    if rejected is not None:
        u = exclude(u, rejected)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("estimated_impact").desc(), F.col("emit_pos"))
    return (u.withColumn("rec_id", F.row_number().over(w)).where(F.col("rec_id") <= keep)
            .select(*REC_COLS))


def _class_table(df: DataFrame, label: str) -> DataFrame:
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("total"))
    mx = c.agg(F.max("count").alias("max_count"), F.min("count").alias("min_count"),
               F.count(F.lit(1)).alias("n_classes"))
    return c.crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(mx))


def augment(df: DataFrame, label: str = "target", class_name=None) -> DataFrame:
    """Synthetic samples for the given class, or for the top 3 classes by count."""
    c = _class_table(df, label)
    if class_name is not None:
        c = c.where(F.col(label).cast("string") == F.lit(str(class_name)))
    else:
        c = c.orderBy(F.col("count").desc(), F.col(label).asc()).limit(AUGMENT_TOP)
    gap = F.col("max_count") - F.col("count")
    c = c.where(gap > 0)
    n_synth = F.least(gap, F.greatest(F.lit(AUGMENT_MIN_SYNTH), F.floor(gap * 0.5))).cast("long")
    ratio = F.col("count") / F.col("max_count")
    impact = round_to(F.least(AUGMENT_IMPACT[0] + n_synth / F.col("total") * AUGMENT_IMPACT[1],
                             F.lit(AUGMENT_IMPACT[2])), 3)
    risk = F.when(ratio < RISK_RATIO, "MEDIUM").otherwise("LOW")
    desc = F.format_string("Generate %d synthetic samples for class '%s' by a shift of 0.1 std. "
                           "Imbalance ratio before: %.2f -> after: %.2f. Risk: %s.", n_synth,
                           F.col(label).cast("string"), ratio, (F.col("count") + n_synth) / F.col("max_count"), risk)
    out = c.select(*_rec("augment_class", cls=F.col(label), n_synth=n_synth, impact=impact,
                         conf=F.lit(AUGMENT_CONF), risk=risk, desc=desc, emit_pos=F.lit(0)),
                   F.col("count").alias("__c"), F.col(label).alias("__l"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("__c").desc(), F.col("__l").asc())
    return out.withColumn("rec_id", F.row_number().over(w)).select(*REC_COLS)


def balance(df: DataFrame, label: str = "target") -> DataFrame:
    """B6 (oversample the smallest class to the majority count) and B7
    (undersample the majority to 2 x minority when the ratio < 0.5).  Ties on
    counts pick the smallest label."""
    c = _class_table(df, label)
    ext = c.groupBy("n_classes", "min_count", "max_count", "total").agg(
        F.min(F.when(F.col("count") == F.col("min_count"), F.col(label))).alias("min_cls"),
        F.min(F.when(F.col("count") == F.col("max_count"), F.col(label))).alias("max_cls")).where(F.col("n_classes") >= 2)
    ent = class_entropy(df, label).select("entropy_pct")
    ext = ext.crossJoin(F.broadcast(ent))
    ratio = F.col("min_count") / F.col("max_count")
    over = ext.select(F.lit(1).alias("rec_id"), *_rec(
        "oversample", cls=F.col("min_cls"), target=F.col("max_count"),
        impact=round_to(F.least(OVERSAMPLE_IMPACT[0] + (1 - ratio) * OVERSAMPLE_IMPACT[1], F.lit(OVERSAMPLE_IMPACT[2])), 3),
        conf=F.lit(OVERSAMPLE_CONF), risk=F.when(ratio < RISK_RATIO, "MEDIUM").otherwise("LOW"),
        desc=F.format_string("Upsample minority class %s from %d to %d rows. Imbalance ratio: %.2f. "
                             "Class entropy: %.1f%% of maximum.", F.col("min_cls").cast("string"), F.col("min_count"),
                             F.col("max_count"), ratio, F.col("entropy_pct")),
        emit_pos=F.lit(0)))
    under = ext.where(ratio < UNDERSAMPLE_BELOW).select(F.lit(2).alias("rec_id"), *_rec(
        "undersample", cls=F.col("max_cls"), target=F.col("min_count") * 2,
        impact=round_to(F.least(UNDERSAMPLE_IMPACT[0] + (1 - ratio) * UNDERSAMPLE_IMPACT[1],
                               F.lit(UNDERSAMPLE_IMPACT[2])), 3),
        conf=F.lit(UNDERSAMPLE_CONF), risk=F.lit("MEDIUM"),
        desc=F.format_string("Downsample majority class %s from %d to %d rows; loses %d rows.",
                             F.col("max_cls").cast("string"), F.col("max_count"), F.col("min_count") * 2,
                             F.col("max_count") - F.col("min_count") * 2),
        emit_pos=F.lit(1)))
    return over.unionByName(under).select(*REC_COLS)


def oversample(df, label="target"):
    """B6 alone."""
    return balance(df, label).where(F.col("action_type") == "oversample")


def undersample(df, label="target"):
    """B7 alone."""
    return balance(df, label).where(F.col("action_type") == "undersample")


def stamp(recs: DataFrame, df: DataFrame) -> DataFrame:
    """Stamp each proposal with ``rec_set_id`` = a digest of the input's
    order-free fingerprint, so stale ids can be refused later."""
    fp = fingerprint(df).select(F.sha2(F.concat_ws("|", "n_rows", "hash_sum", "hash_xor"), 256)
                                .substr(1, 16).alias("rec_set_id"))
    return recs.crossJoin(F.broadcast(fp))


def check_fresh(recs: DataFrame, df: DataFrame) -> DataFrame:
    """One row per proposal with ``fresh`` = its rec_set_id matches the current table."""
    cur = stamp(df.sparkSession.range(1).select(F.lit(0).alias("__x")), df).select(
        F.col("rec_set_id").alias("__cur"))
    return recs.crossJoin(F.broadcast(cur)).select(*recs.columns, (F.col("rec_set_id") == F.col("__cur")).alias("fresh"))


def exclude(recs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Drop proposals the user rejected, matched on (action_type, col_name) null-safely."""
    r = rejected.select(F.col("action_type").alias("__a"), F.col("col_name").alias("__c"))
    cond = (recs["action_type"] == r["__a"]) & recs["col_name"].eqNullSafe(r["__c"])
    return recs.join(r, cond, "left_anti")
