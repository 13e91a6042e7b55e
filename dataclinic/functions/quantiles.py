"""Exact quantiles by counting: nothing is collected and no large sketch is merged.

1. ``percentile_approx`` with a small accuracy brackets the target (its rank error
   is at most n / accuracy); the widest bracket, [min, max], always qualifies.
2. Values below the bracket are counted; the values inside are counted by value
   (map-side partial), so a value that fills half the column is one row per task.
3. The distinct values are cut into ``BINS`` equal bins of the bracket; a prefix sum
   over the bins (at most BINS rows per column) finds the bins that hold the two
   middle ranks, and only the distinct values of these bins are ordered.

The result is the linearly interpolated quantile (pandas / DuckDB ``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
BINS = 65_536
DELTAS = (None, 1e-3, 1e-2, 1e-1, 1.0)  # None = 2 / accuracy


def _deltas(accuracy):
    return [2.0 / accuracy if d is None else d for d in DELTAS]


def _pcts(q, accuracy):
    out = []
    for d in _deltas(accuracy):
        out += [max(0.0, q - d), min(1.0, q + d)]
    return out


def _bracket(b: Column, n: Column, accuracy: int):
    """Narrowest bracket whose width covers the sketch error plus 4 ranks."""
    lo = hi = None
    for j, d in reversed(list(enumerate(_deltas(accuracy)))):
        ok = F.lit(d) >= F.lit(1.0 / accuracy) + F.lit(4.0) / F.greatest(n.cast("double"), F.lit(1.0))
        lo = b[2 * j] if lo is None else F.when(ok, b[2 * j]).otherwise(lo)
        hi = b[2 * j + 1] if hi is None else F.when(ok, b[2 * j + 1]).otherwise(hi)
    return lo, hi


def exact_quantiles(df: DataFrame, exprs: dict, q: float, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One row with column ``k`` = exact q-quantile of each expression (NULL without values)."""
    pcts = F.array(*[F.lit(p) for p in _pcts(q, accuracy)])
    names = list(exprs)
    one = df.agg(*[a for k, e in exprs.items() for a in (
        F.count(e).alias(f"n_{k}"), F.percentile_approx(e, pcts, accuracy).alias(f"b_{k}"))])
    bounds = []
    for i, k in enumerate(names):
        lo, hi = _bracket(F.col(f"b_{k}"), F.col(f"n_{k}"), accuracy)
        bounds.append(F.struct(F.lit(i).alias("k"), F.col(f"n_{k}").alias("n"), lo.cast("double").alias("lo"),
                               hi.cast("double").alias("hi")))
    bounds = one.select(F.explode(F.array(*bounds)).alias("s")).select("s.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), e.cast("double").alias("x"))
                                         for i, e in enumerate(exprs.values())])).alias("s")).select("s.k", "s.x")
    inside = long.where("x is not null").join(F.broadcast(bounds), "k").where("x <= hi")  # one row a column
    # -0.0 and 0.0 are one value; all values below the bracket are one group
    value = F.when(F.col("x") >= F.col("lo"), F.col("x") + 0.0)
    counts = inside.groupBy("k", value.alias("x")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"),
                                                       F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    width = F.col("hi") - F.col("lo")
    share = (F.col("x") - F.col("lo")) / F.when((width > 0) & (width < F.lit(float("inf"))), width)
    bin_ = F.when(F.col("x").isNull(), F.lit(-1)).otherwise(
        F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
    counts = counts.withColumn("bin", bin_.cast("int"))
    upto = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (counts.groupBy("k", "bin").agg(F.sum("c").alias("m"), F.max("n").alias("n"))
            .withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))))
    rank = F.lit(q) * (F.col("n") - 1)
    i, j = F.floor(rank), F.least(F.floor(rank) + 1, F.col("n") - 1)  # 0-based ranks
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("m"))
    hit = bins.where((F.col("bin") >= 0) & (holds(i) | holds(j))).select("k", "bin", "before")
    lane = Window.partitionBy("k", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    vals = counts.join(hit, ["k", "bin"]).withColumn("at", F.col("before") + F.coalesce(F.sum("c").over(lane), F.lit(0)))
    takes = lambda r: F.max(F.when((F.col("at") <= r) & (r < F.col("at") + F.col("c")), F.col("x")))
    pair = vals.groupBy("k").agg(takes(i).alias("a"), takes(j).alias("b"), F.first(rank - F.floor(rank)).alias("f"))
    result = F.col("a") + F.when(F.col("f") > 0, F.col("f") * (F.col("b") - F.col("a"))).otherwise(F.lit(0.0))
    return pair.agg(*[F.max(F.when(F.col("k") == i_, result)).alias(k) for i_, k in enumerate(names)])
