"""Rule validation (D1-D4) in one aggregation pass.

Rules are configuration (one row per column), so they are read on the driver
to build Column expressions; the data itself is scanned once: every rule
becomes conditional sums inside a single ``agg``, then the results are
unpivoted to one violation row per broken rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import normalize_missing, to_number
from .profile import NUMERIC_DTYPES, expected_dtype, feature_columns, rules_dict

# Fixed thresholds from the reference validator.
DTYPE_CRITICAL_PCT = 10.0
RANGE_CRITICAL_Z = 5.0

VIOLATION_COLS = ["col_name", "rule", "count", "pct", "observed_min", "observed_max", "max_z", "severity"]


def _explode(one: DataFrame, structs) -> DataFrame:
    if not structs:
        schema = ("col_name string, rule string, count long, pct double, observed_min double, "
                  "observed_max double, max_z double, severity string")
        return one.sparkSession.createDataFrame([], schema)
    return one.select(F.explode(F.array(*structs)).alias("v")).select("v.*").where(F.col("count") > 0)


def _v(col, rule, count, pct=None, lo=None, hi=None, z=None, severity=None):
    nul = F.lit(None).cast("double")
    return F.struct(F.lit(col).alias("col_name"), F.lit(rule).alias("rule"), count.cast("long").alias("count"),
                    (pct if pct is not None else nul).alias("pct"), (lo if lo is not None else nul).alias("observed_min"),
                    (hi if hi is not None else nul).alias("observed_max"), (z if z is not None else nul).alias("max_z"),
                    (severity if severity is not None else F.lit("WARNING")).alias("severity"))


def violations(df: DataFrame, rules=None, label: str = "target", keys=(), checks=("dtype", "range", "category",
                                                                                  "not_null", "expression")) -> DataFrame:
    """All rule violations, one row per broken rule (count > 0); NaN is missing."""
    df = normalize_missing(df)
    rules = rules_dict(rules)
    feats = feature_columns(df, label, keys)
    cols = [c for c in df.columns if c not in set(keys)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    out = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        r = rules.get(c) or {}
        x = to_number(c, dt)
        if "dtype" in checks and c in feats and expected_dtype(rules, c) in NUMERIC_DTYPES:
            aggs.append(F.sum((F.col(c).isNotNull() & x.isNull()).cast("long")).alias(f"te{i}"))
            pct = F.col(f"te{i}") * 100.0 / F.col("__rows")
            out.append(_v(c, f"dtype={expected_dtype(rules, c)}", F.col(f"te{i}"), pct=pct,
                          severity=F.when(pct > DTYPE_CRITICAL_PCT, "CRITICAL").otherwise("WARNING")))
        if "range" in checks and r.get("lo") is not None and r.get("hi") is not None:
            lo, hi = float(r["lo"]), float(r["hi"])
            aggs += [F.sum(((x < lo) | (x > hi)).cast("long")).alias(f"ro{i}"), F.min(x).alias(f"mn{i}"),
                     F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
            sd = F.coalesce(F.col(f"sd{i}"), F.lit(0.0))
            z = F.abs(F.col(f"mx{i}") - F.col(f"av{i}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
            out.append(_v(c, f"range=[{lo},{hi}]", F.col(f"ro{i}"), lo=F.col(f"mn{i}"), hi=F.col(f"mx{i}"), z=z,
                          severity=F.when(z > RANGE_CRITICAL_Z, "CRITICAL").otherwise("WARNING")))
        cats = r.get("categories")
        if "category" in checks and cats:
            arr = F.array(*[F.lit(v) for v in cats])
            aggs.append(F.sum((F.col(c).isNotNull() & ~F.array_contains(arr, F.col(c).cast("string")))
                              .cast("long")).alias(f"ca{i}"))
            out.append(_v(c, "categories", F.col(f"ca{i}")))
        if "not_null" in checks and r.get("nullable") is False:
            aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"nn{i}"))
            out.append(_v(c, "not_null", F.col(f"nn{i}")))
    if "expression" in checks:
        for j, (name, r) in enumerate(sorted(rules.items())):
            e = r.get("expression")
            if e:
                aggs.append(F.sum((~F.expr(e)).cast("long")).alias(f"ex{j}"))
                out.append(_v(name, f"expr: {e}", F.coalesce(F.col(f"ex{j}"), F.lit(0))))
    one = df.agg(*aggs)
    return _explode(one, out)


def dtype_rule(df, rules=None, label="target", keys=()):
    """D1."""
    return violations(df, rules, label, keys, checks=("dtype",))


def range_rule(df, rules=None, label="target", keys=()):
    """D2."""
    return violations(df, rules, label, keys, checks=("range",))


def category_rule(df, rules=None, label="target", keys=()):
    """D3 (categories)."""
    return violations(df, rules, label, keys, checks=("category",))


def not_null_rule(df, rules=None, label="target", keys=()):
    """D3 (nullability)."""
    return violations(df, rules, label, keys, checks=("not_null",))


def expression_rule(df, rules=None, label="target", keys=()):
    """Any boolean SQL expression as a rule."""
    return violations(df, rules, label, keys, checks=("expression",))
