"""Table profiling (family A).

All per-column statistics come from ONE ``agg`` pass over all columns (partial
aggregation on the map side, one tiny final merge), then are unpivoted to one
row per column with ``explode(array(struct))``.  Nothing is collected: the
driver only ever sees one-row-per-column summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantiles as Q
from ..functions.expr import normalize_missing, to_number

NUMERIC_DTYPES = ("float64", "int64")
DEFAULT_DTYPE = "float64"
ENTROPY_EPS = 1e-9


def rules_dict(rules) -> dict:
    """Column rules as ``{column: {expected_dtype, lo, hi, categories, nullable}}``.

    Accepts a dict or a (small, one row per column) DataFrame; the rule table is
    configuration, bounded by the number of columns."""
    if rules is None:
        return {}
    if isinstance(rules, dict):
        return rules
    out = {}
    for r in rules.collect():
        d = r.asDict()
        out[d["col_name"]] = d
    return out


def feature_columns(df: DataFrame, label: str = "target", keys=(), features=None) -> list[str]:
    if features is not None:
        return [c for c in features if c in df.columns]
    return [c for c in df.columns if c != label and c not in set(keys)]


def expected_dtype(rules: dict, col: str) -> str:
    return (rules.get(col) or {}).get("expected_dtype") or DEFAULT_DTYPE


def column_stats(df: DataFrame, label: str = "target", keys=(), features=None, rules=None,
                 exact: bool = True, accuracy: int = 100000, with_median: bool = True) -> DataFrame:
    """A1, A6, A7, A8 in one pass.  One row per feature column:
    column, pos, n_rows, n_missing, missing_frac, numeric_expected, type_errors,
    n, mean, median, std, skew, min, max, max_z."""
    rules = rules_dict(rules)
    feats = feature_columns(df, label, keys, features)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(feats):
        dt = df.schema[c].dataType
        x = to_number(c, dt)
        raw = F.col(c)
        missing = raw.isNull() if not isinstance(dt, (T.DoubleType, T.FloatType)) else (raw.isNull() | F.isnan(raw))
        if not with_median or exact:
            med = F.lit(None).cast("double")  # exact medians are counted below
        else:
            med = F.percentile_approx(x, 0.5, accuracy)
        aggs += [
            F.sum(missing.cast("long")).alias(f"m{i}"),
            F.sum((raw.isNotNull() & ~missing & x.isNull()).cast("long")).alias(f"e{i}"),
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"a{i}"),
            med.cast("double").alias(f"p{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.skewness(x).alias(f"k{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
    banded = with_median and exact and bool(feats)
    qexprs = {f"p{i}": to_number(c, df.schema[c].dataType) for i, c in enumerate(feats)}
    one = df.agg(*aggs)
    if banded:  # one row on either side
        one = one.drop(*[f"p{i}" for i in range(len(feats))]).crossJoin(Q.exact_quantiles(df, qexprs, 0.5))
    rows = []
    for i, c in enumerate(feats):
        numeric_expected = expected_dtype(rules, c) in NUMERIC_DTYPES
        n = F.col(f"n{i}")
        g1 = F.nanvl(F.col(f"k{i}"), F.lit(None).cast("double"))
        skew = F.when(n > 2, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))).otherwise(F.lit(0.0))
        std = F.when(n > 1, F.coalesce(F.col(f"s{i}"), F.lit(0.0))).otherwise(F.lit(0.0))
        mean = F.when(n > 0, F.col(f"a{i}")).otherwise(F.lit(0.0))
        rows.append(F.struct(
            F.lit(c).alias("col_name"), F.lit(i).alias("pos"),
            F.col("__rows").alias("n_rows"), F.col(f"m{i}").alias("n_missing"),
            (F.col(f"m{i}") / F.greatest(F.col("__rows"), F.lit(1))).alias("missing_frac"),
            F.lit(numeric_expected).alias("numeric_expected"),
            (F.col(f"e{i}") if numeric_expected else F.lit(0).cast("long")).alias("type_errors"),
            n.cast("long").alias("n"), mean.alias("mean"),
            F.when(n > 0, F.col(f"p{i}")).otherwise(F.lit(0.0)).alias("median"),
            std.alias("std"), skew.alias("skew"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            (F.abs(F.col(f"hi{i}") - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)).alias("max_z"),
        ))
    if not rows:
        schema = ("col_name string, pos int, n_rows long, n_missing long, missing_frac double, "
                  "numeric_expected boolean, type_errors long, n long, mean double, median double, "
                  "std double, skew double, min double, max double, max_z double")
        return df.sparkSession.createDataFrame([], schema)
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def missing(df: DataFrame, label: str = "target", keys=(), features=None, include_label=False) -> DataFrame:
    """A1: missing count and % per column, only columns with missing cells (NaN is missing)."""
    df = normalize_missing(df)
    cols = feature_columns(df, label, keys, features) + ([label] if include_label else [])
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    st = [F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("pos"), F.col(f"m{i}").alias("n_missing"),
                   (F.col(f"m{i}") * 100.0 / F.greatest(F.col("__rows"), F.lit(1))).alias("pct_missing"))
          for i, c in enumerate(cols)]
    return (one.select(F.explode(F.array(*st)).alias("s")).select("s.*")
            .where(F.col("n_missing") > 0))


def total_missing(df: DataFrame) -> DataFrame:
    """A2: all missing cells (NaN is missing), label included (one row)."""
    df = normalize_missing(df)
    expr = [F.sum(F.col(c).isNull().cast("long")) for c in df.columns]
    total = expr[0]
    for e in expr[1:]:
        total = total + e
    return df.agg(F.coalesce(total, F.lit(0)).cast("long").alias("total_missing"))


def duplicates(df: DataFrame) -> DataFrame:
    """A3: rows equal on all columns to an earlier row (NULLs equal).  One
    shuffle; partial aggregation collapses hot duplicate groups map-side."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows"),
                 F.count(F.lit(1)).cast("long").alias("n_distinct"),
                 F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def class_counts(df: DataFrame, label: str = "target") -> DataFrame:
    """A4: rows per class and % of all rows, null label excluded, by label."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return (c.crossJoin(F.broadcast(total))
            .select(F.col(label).alias("label"), "count",
                    (F.col("count") * 100.0 / F.col("__total")).alias("pct"))
            .orderBy("label"))


def shape(df: DataFrame, label: str = "target", keys=(), original_rows=None) -> DataFrame:
    """A5: rows, features, preserved fraction, one row per column with its dtype."""
    feats = feature_columns(df, label, keys)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    orig = F.lit(original_rows).cast("long") if original_rows is not None else F.col("n_rows")
    dtypes = F.array(*[F.struct(F.lit(f.name).alias("col_name"), F.lit(f.dataType.simpleString()).alias("dtype"))
                       for f in df.schema.fields])
    return n.select("n_rows", F.lit(len(feats)).alias("n_features"),
                    (F.col("n_rows") / F.greatest(orig, F.lit(1))).alias("preserved"),
                    F.explode(dtypes).alias("d")).select("n_rows", "n_features", "preserved", "d.col_name", "d.dtype")


def numeric_stats(df: DataFrame, label: str = "target", keys=(), features=None, exact=True,
                  with_median=True) -> DataFrame:
    """A6 + A8: mean, median, std, skew (G1), n, min, max, max_z per column."""
    return column_stats(df, label, keys, features, exact=exact, with_median=with_median).select(
        "col_name", "pos", "n", "mean", "median", "std", "skew", "min", "max", "max_z")


def type_errors(df: DataFrame, label: str = "target", keys=(), features=None, rules=None) -> DataFrame:
    """Non-null values that do not parse as a number, per numeric-typed column."""
    return (column_stats(df, label, keys, features, rules, with_median=False).where("numeric_expected")
            .select("col_name", "pos", "n_rows", "type_errors"))


def class_entropy(df: DataFrame, label: str = "target") -> DataFrame:
    """-sum p*log2(p+1e-9) and its % of log2(k)."""
    c = class_counts(df, label)
    tot = F.sum("count").over(Window.partitionBy(F.lit(0)))
    p = c.select((F.col("count") / tot).alias("p"))
    return p.agg(F.count(F.lit(1)).alias("n_classes"),
                 F.coalesce(F.sum(-F.col("p") * F.log2(F.col("p") + ENTROPY_EPS)), F.lit(0.0)).alias("entropy")
                 ).select("n_classes", "entropy",
                          F.when(F.col("n_classes") > 1, F.col("entropy") / F.log2(F.col("n_classes")) * 100.0)
                          .otherwise(F.lit(0.0)).alias("entropy_pct"))


def imbalance(df: DataFrame, label: str = "target") -> DataFrame:
    """A10: min/max class counts, their labels (ties -> smallest label), ratio."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    st = c.agg(F.count(F.lit(1)).alias("n_classes"), F.min("count").alias("min_count"),
               F.max("count").alias("max_count"))
    j = c.crossJoin(F.broadcast(st))
    return j.groupBy("n_classes", "min_count", "max_count").agg(
        F.min(F.when(F.col("count") == F.col("min_count"), F.col(label))).alias("min_label"),
        F.min(F.when(F.col("count") == F.col("max_count"), F.col(label))).alias("max_label"),
    ).select("n_classes", "min_label", "max_label", "min_count", "max_count",
             (F.col("min_count") / F.col("max_count")).alias("imbalance_ratio"))
