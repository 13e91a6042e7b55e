"""Scalar Column builders (inventory X1-X9) and missing-value normalisation.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference behaviour -------------------------
# Number syntax accepted as numeric (decision 4 of the survey).
NUMERIC_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Risk bands for missing share (fraction): < 0.05 LOW, < 0.20 MEDIUM, else HIGH.
MISSING_RISK_BANDS = (0.05, 0.20)
# Drift bands: < 0.2 NONE, < 0.5 LOW, < 1.0 MEDIUM, else HIGH.
DRIFT_BANDS = (0.2, 0.5, 1.0)
# Severity bands: < 0.05 NONE, < 0.3 LOW, < 0.6 MEDIUM, else HIGH.
SEVERITY_BANDS = (0.05, 0.3, 0.6)
# Skew bands for imputation: |skew| > 1.0 median, > 0.5 median, else mean.
SKEW_BANDS = (1.0, 0.5)
MAX_ACTION_CHARS = 200
TRUNCATION_PENALTY = -0.02


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def to_number(c, dtype: T.DataType | None = None) -> Column:
    """Coerce to DOUBLE; unparsable text and NaN become NULL.

    Numeric columns only lose NaN; text goes through the fixed number pattern
    and ``try_cast`` (ANSI-safe).
    """
    col = _c(c)
    if dtype is not None and is_numeric_type(dtype):
        d = col.cast("double")
        return F.nanvl(d, F.lit(None).cast("double"))
    s = F.trim(col.cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def normalize_missing(df: DataFrame) -> DataFrame:
    """Decision 1: NaN -> NULL on every float/double column, once, at the door."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def impute_strategy(skew, mean, median):
    """Returns (strategy, value, reason) Columns from per-column stats."""
    a = F.abs(_c(skew))
    strategy = F.when(a > SKEW_BANDS[0], "median").when(a > SKEW_BANDS[1], "median").otherwise("mean")
    value = F.when(strategy == "median", _c(median)).otherwise(_c(mean))
    sk = F.format_string("%.2f", _c(skew))
    reason = (F.when(a > SKEW_BANDS[0], F.concat(F.lit("right-skewed (skew="), sk, F.lit("), median more robust")))
              .when(a > SKEW_BANDS[1], F.concat(F.lit("moderately skewed (skew="), sk, F.lit("), median preferred")))
              .otherwise(F.concat(F.lit("near-symmetric (skew="), sk, F.lit("), mean appropriate"))))
    return strategy, value, reason


def missing_risk(frac) -> Column:
    """Risk label from the missing fraction (0..1)."""
    f = _c(frac)
    return (F.when(f < MISSING_RISK_BANDS[0], "LOW").when(f < MISSING_RISK_BANDS[1], "MEDIUM")
            .otherwise("HIGH"))


def drift_label(score) -> Column:
    """X4."""
    s = _c(score)
    return (F.when(s < DRIFT_BANDS[0], "NONE").when(s < DRIFT_BANDS[1], "LOW")
            .when(s < DRIFT_BANDS[2], "MEDIUM").otherwise("HIGH"))


def severity_label(sev) -> Column:
    """X5."""
    s = _c(sev)
    return (F.when(s < SEVERITY_BANDS[0], "NONE").when(s < SEVERITY_BANDS[1], "LOW")
            .when(s < SEVERITY_BANDS[2], "MEDIUM").otherwise("HIGH"))


def rescale(c, lo, hi, new_lo: float = 18.0, new_hi: float = 80.0) -> Column:
    """Min-max rescale to [new_lo, new_hi] given column min/max Columns."""
    return (_c(c) - _c(lo)) / (_c(hi) - _c(lo) + F.lit(1e-9)) * F.lit(new_hi - new_lo) + F.lit(new_lo)


def truncate_action(c, max_chars: int = MAX_ACTION_CHARS):
    """(text cut to max_chars, was_truncated, penalty)."""
    col = _c(c)
    cut = F.length(col) > max_chars
    return (F.when(cut, F.substring(col, 1, max_chars)).otherwise(col), cut,
            F.when(cut, F.lit(TRUNCATION_PENALTY)).otherwise(F.lit(0.0)))


def parse_command(c):
    """(cmd, arg) from an action text.  cmd = first token lower-cased
    ('' when empty); arg = second token as BIGINT, -1 when absent or not an integer of 64 bits."""
    toks = F.split(F.trim(_c(c)), r"\s+")
    first = F.lower(F.element_at(toks, 1))
    cmd = F.coalesce(first, F.lit(""))
    second = F.when(F.size(toks) > 1, F.element_at(toks, 2))
    arg = F.coalesce(F.when(second.rlike(r"^[+-]?[0-9]+$"), second.try_cast("bigint")), F.lit(-1).cast("bigint"))
    return cmd, arg


def round_to(c, digits: int) -> Column:
    """Round like the reference (and DuckDB): scale, round to integer, unscale.

    Spark's ``round(x, d)`` rounds the shortest decimal string of x half-up, so
    a double printed as ...5 goes up even when its exact binary value is below
    the tie; scaling first rounds the binary value, as Python's round does."""
    m = float(10 ** digits)
    return F.round(_c(c) * F.lit(m)) / F.lit(m)


def clip(c, lo: float, hi: float) -> Column:
    """X9."""
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))
