"""Repair transforms (family C).  Each is a lazy ``DataFrame -> DataFrame``.

Fill values and thresholds come from one-row aggregates that are broadcast
cross-joined (one row: a proven bound), so nothing is collected.  Sampling
(augment / oversample / undersample) uses exact md5 ranks and hashed draws
from ``functions.ranking``: a class holding a third of the table is split over
hash buckets, never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import to_number
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import bucketed_rank, draw_counts, draw_with_replacement, hash_hex, hash_int, lazy_range, unfold
from . import inject, integrity, recommend
from .profile import duplicates, feature_columns, total_missing

# Fixed value from the reference augmenter: shift = 0.1 x std of the drawn rows.
AUGMENT_SHIFT = 0.1
DEFAULT_TRIM_PCT = 5


def _quantile_row(df: DataFrame, x, q: float, exact: bool, name: str) -> DataFrame:
    if exact:
        return exact_quantiles(df, {name: x}, q)
    return df.agg(F.percentile_approx(x, q, 100000).cast("double").alias(name))


def fill_missing(df: DataFrame, col: str, strategy: str = "mean", exact: bool = True) -> DataFrame:
    """Coerce ``col`` to DOUBLE (bad values become missing too) and fill every
    missing value with the column mean or median (exact, banded quantile)."""
    x = to_number(col, df.schema[col].dataType)
    if strategy == "median":
        v = _quantile_row(df, x, 0.5, exact, "__fill")
    else:
        v = df.agg(F.avg(x).cast("double").alias("__fill"))
    return df.crossJoin(F.broadcast(v)).withColumn(col, F.coalesce(x, F.col("__fill"))).drop("__fill")


def dedupe(df: DataFrame) -> DataFrame:
    """Drop rows repeated on all columns (copies are identical, so 'keep
    first' needs no order).  One shuffle with map-side partial dedupe."""
    return df.dropDuplicates()


def fix_types(df: DataFrame, col: str) -> DataFrame:
    """Coerce to number, fill all missing (genuine ones too) with the mean."""
    return fill_missing(df, col, "mean")


def _class_pool(df: DataFrame, label: str, cls, seed, keys, tag: str):
    part = df.where(F.col(label) == F.lit(cls))
    d = part.withColumn("__h", hash_hex(seed, F.lit(tag), *keys))
    pool = bucketed_rank(d, "__h", tie_cols=inject.tie_columns(part, keys), rank_col="_rank").drop("__h")
    n = part.agg(F.count(F.lit(1)).alias("__n"))
    return part, pool, n


def _draw(df, label, cls, k_col, seed, keys, tag, index=False):
    """``k_col``: Column over (__n) giving the number of draws."""
    part, pool, n = _class_pool(df, label, cls, seed, keys, tag)
    counts = n.select("__n", k_col.cast("bigint").alias("__k")).where(F.col("__n") > 0)
    draws = lazy_range(counts, "__k")
    out = draw_with_replacement(pool, draws.withColumnRenamed("i", "__i"), seed, tag + "-draw", index_col="__i", keep_index=True)
    return out.select(*df.columns, *["__i"] * index)


def augment_class(df: DataFrame, label: str, cls, n_synth: int, seed=42, keys=(), features=None,
                  mode: str = "shift") -> DataFrame:
    """C4: draw ``n_synth`` rows of the class with replacement, add 0.1 x std of
    the drawn column to every feature (coerced to number), append.  An integer
    feature becomes DOUBLE, so the shift is not cut off; text stays text.  ``mode``
    "gaussian" multiplies the shift by a standard normal number of (seed, draw, column)
    (Box-Muller from two 60-bit hashes)."""
    if mode not in ("shift", "gaussian"):
        raise ValueError(f"unknown mode {mode!r}")
    feats = feature_columns(df, label, keys, features)
    drawn = _draw(df, label, cls, F.lit(n_synth), seed, keys, "augment", index=True)
    nums = {c: to_number(c, df.schema[c].dataType) for c in feats}
    drawn = drawn.select(*[nums[c].alias(c) if c in nums else F.col(c) for c in df.columns], "__i")
    sd = drawn.agg(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"__sd_{c}") for c in feats])

    def kept_type(c):
        dt = df.schema[c].dataType
        return T.DoubleType() if isinstance(dt, T.IntegralType) else dt

    def factor(c):
        if mode == "shift":
            return F.lit(1.0)
        u = [(hash_int(hash_hex(seed, F.lit(f"noise{j}|{c}"), "__i")) + 1) / F.lit(float(1 << 60)) for j in (1, 2)]
        return F.sqrt(-2.0 * F.log(u[0])) * F.cos(2.0 * math.pi * u[1])

    shifted = drawn.crossJoin(F.broadcast(sd)).select(*[
        (F.col(c) + AUGMENT_SHIFT * factor(c) * F.col(f"__sd_{c}")).cast(kept_type(c)).alias(c) if c in nums
        else F.col(c) for c in df.columns])
    return df.unionByName(shifted)


def oversample(df: DataFrame, label: str, cls, target_count, seed=42, keys=(), mode: str = "draw") -> DataFrame:
    """Append exact copies drawn with replacement until the class has ``target_count`` rows.
    ``mode`` "replicate": every row of the class gets as many copies as any other, the
    remainder going to the smallest hashes.  ``mode`` "split": drawn with replacement too, as a count per row
    by splitting the draws down a tree of hash digits (``ranking.draw_counts``): no join on a drawn rank."""
    if mode == "replicate":
        part = df.where(F.col(label) == F.lit(cls))
        n = part.count()
        more = max(0, int(target_count) - n) if n else 0
        d, (hit,) = inject._marked(part, seed, ["replicate"], keys, lambda _: F.lit(more % n if n else 0))
        copies = F.lit(more // n if n else 0) + hit.cast("int")
        extra = d.withColumn("__c", copies).where("__c > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__c"))))
        return df.unionByName(extra.select(*df.columns))
    if mode == "split":
        part = df.where(F.col(label) == F.lit(cls))
        n = part.count()
        more = max(0, int(target_count) - n) if n else 0
        return df.unionByName(unfold(draw_counts(part, more, seed, keys), "__draws").select(*df.columns)) if more else df
    if mode != "draw":
        raise ValueError(f"unknown mode {mode!r}")
    k = F.greatest(F.lit(0), F.lit(target_count) - F.col("__n"))
    return df.unionByName(_draw(df, label, cls, k, seed, keys, "oversample"))


def undersample(df: DataFrame, label: str, cls, target_count, seed=42, keys=()) -> DataFrame:
    """Keep ``target_count`` rows of the class (exact sample without replacement)."""
    return inject.undersample_class(df, label, cls, target_count, seed, keys)


def trim_low(df: DataFrame, col: str, pct: float = DEFAULT_TRIM_PCT, exact: bool = True) -> DataFrame:
    """Keep rows whose value is >= the pct-th percentile (linear
    interpolation); missing or non-numeric values there are dropped too."""
    x = to_number(col, df.schema[col].dataType)
    q = pct / 100.0
    thr = _quantile_row(df, x, q, exact, "__thr")
    return df.crossJoin(F.broadcast(thr)).where(x >= F.col("__thr")).drop("__thr")


ACTIONS = ("fill_missing", "remove_duplicates", "fix_type_errors", "augment_class", "oversample",
           "undersample", "remove_outlier_rows")


def apply_action(df: DataFrame, payload: dict, label: str = "target", keys=(), seed=42) -> DataFrame:
    """C8 dispatch: payload ``{"action": ..., "column"/"strategy"/"class"/...}``."""
    a = payload.get("action", "")
    if a == "fill_missing":
        return fill_missing(df, payload["column"], payload.get("strategy") or "mean")
    if a == "remove_duplicates":
        return dedupe(df)
    if a == "fix_type_errors":
        return fix_types(df, payload["column"])
    if a == "augment_class":
        return augment_class(df, label, payload["class"], int(payload["n_synth"]), seed, keys)
    if a == "oversample":
        return oversample(df, label, payload["class"], int(payload["target_count"]), seed, keys)
    if a == "undersample":
        return undersample(df, label, payload["class"], int(payload["target_count"]), seed, keys)
    if a == "remove_outlier_rows":
        return trim_low(df, payload["column"], float(payload.get("pct") or DEFAULT_TRIM_PCT))
    raise ValueError(f"unknown action {a!r}")


def apply_checked(df: DataFrame, recs: DataFrame, payload: dict, original_rows: int, label: str = "target", keys=(),
                  seed=42) -> DataFrame:
    """C8 with its guards: refuses a proposal set that was stamped on another table
    and a repair that leaves under half of the original rows (D10)."""
    stale = recommend.check_fresh(recs, df).where(~F.col("fresh"))
    if not stale.isEmpty():
        raise ValueError("stale recommendation set: query again")
    out = apply_action(df, payload, label, keys, seed)
    if integrity.data_loss(out, int(original_rows)).first()["catastrophic"]:
        raise ValueError("the repair would leave under half of the original rows")
    return out


def health_report(before: DataFrame, after: DataFrame, original_rows) -> DataFrame:
    """C8 report: missing cells, duplicate rows and row count before and after,
    one row per metric."""
    def one(df, tag):
        m = total_missing(df).select(F.col("total_missing").alias(f"missing_{tag}"))
        d = duplicates(df).select(F.col("n_duplicates").alias(f"dups_{tag}"), F.col("n_rows").alias(f"rows_{tag}"))
        return m.crossJoin(d)
    j = one(before, "before").crossJoin(one(after, "after"))
    if isinstance(original_rows, DataFrame):
        j = j.crossJoin(F.broadcast(original_rows.select(F.col("original_rows").cast("long"))))
    else:
        j = j.withColumn("original_rows", F.lit(original_rows).cast("long"))
    rows = F.array(
        F.struct(F.lit("missing").alias("metric"), F.col("missing_before").alias("before"), F.col("missing_after").alias("after")),
        F.struct(F.lit("duplicates").alias("metric"), F.col("dups_before").alias("before"), F.col("dups_after").alias("after")),
        F.struct(F.lit("rows").alias("metric"), F.col("rows_before").alias("before"), F.col("rows_after").alias("after")))
    return j.select(F.explode(rows).alias("r"), "original_rows").select(
        "r.metric", F.col("r.before").cast("long").alias("before"), F.col("r.after").cast("long").alias("after"),
        (F.col("r.after") / F.greatest(F.col("original_rows"), F.lit(1))).alias("after_frac_of_original"))
