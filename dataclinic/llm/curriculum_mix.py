"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: piecewise
linear, given by its values at equally spaced knots.  Its share of the mix is
the target; the schedule says when the source's words are used.

1. Sizes (words) are summed per source.  Targets share all words by weight and
   stop at ``max_epochs`` times the source's size; what a capped source cannot
   take is shared again by weight.  That fixed point is
   ``min(cap, level * weight)`` with one common level, read off prefix sums
   over the sources ordered by cap / weight.
2. Documents of a source are laid out in hash order.  A cumulative word count
   per source comes from two levels: a window inside a hash bucket and a prefix
   sum over the bucket totals, so a source with a third of all rows is spread
   over all buckets.  A source with target T and size S passes floor(T / S)
   times over all its documents and once over the first (T mod S) words.
3. Each pass places a document at a cumulative word count c of its source's
   demand T.  The integral of the schedule, scaled to 1, is inverted at c / T:
   the segment is found by its cumulative area and the quadratic solved.  The
   documents are range-sorted by the position.

Edge cases: a null text has size 0 and takes nothing; a null source is one
source, last in order; null ids and repeated rows are rows like others; a
text of any length counts whole; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Base weights by source rank, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules by source rank, repeating: heavy sources fade out, the others fade in.
SCHEDULES = ((1.25, 1.0, 0.75), (0.75, 1.0, 1.25), (0.5, 1.0, 1.5))
MAX_EPOCHS = 3
BUCKETS = 4096


def _by_rank(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) -> plus ``source_rank``, ``weight``, ``target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("source_rank", F.row_number().over(order) - 1)
    w = w.withColumn("weight", _by_rank(weights, F.col("source_rank")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    # sources by cap / weight: those before the level are full, the rest share what is left by weight
    lane = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, rest = lane.rowsBetween(Window.unboundedPreceding, -1), lane.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(rest))
    # the level is that of the first source that it does not fill
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"),
                                                                                    "source_rank", "level"))).over(every)
    w = w.withColumn("level", level["level"])
    return w.select("source", "source_size", "source_rank", "weight",
                    F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
                        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).alias("target"))


def invert_schedule(u: Column, schedules, rank: Column) -> Column:
    """Time t at which the scaled integral of the source's schedule reaches ``u``."""
    out = None
    for i, knots in enumerate(schedules):
        segs, area, step = [], 0.0, 1.0 / (len(knots) - 1)
        for a, b in zip(knots, knots[1:]):
            segs.append((area, a, b))
            area += (a + b) / 2 * step
        t = None
        for k, (start, a, b) in enumerate(segs):
            need = u * area - start  # area inside this segment
            slope = (b - a) / step
            if abs(slope) < 1e-12:
                x = need / F.lit(max(a, 1e-300))
            else:
                x = (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * need, F.lit(0.0))) - a) / slope
            here = F.lit(k * step) + F.least(F.greatest(x, F.lit(0.0)), F.lit(step))
            t = here if t is None else F.when(u * area >= start, here).otherwise(t)
        out = t if out is None else F.when(F.pmod(rank, F.lit(len(schedules))) == i, t).otherwise(out)
    return out


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   weights=WEIGHTS, schedules=SCHEDULES, max_epochs: float = MAX_EPOCHS, seed: int = 7,
                   row_col: str | None = None) -> DataFrame:
    """One row per document, range-sorted by the position of its first use:
    doc_id, source, size, source_size, target, taken, positions (one for each
    use, the last of which may be a part of the document; empty where nothing is taken).
    ``row_col``: a number of the row, kept as ``row`` and read for nothing else."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != row_col]
    row = [F.col(row_col).alias("row")] if row_col else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                       F.xxhash64(F.lit(seed), id_col, F.xxhash64(text_col)).alias("h"),
                       (F.xxhash64(*others) if row_col else F.lit(0)).alias("tie"), *row)
    base = stored(base)
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    rows = base.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    offsets = stored(offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).drop(targets["source"]))
    lane = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumn("upto", F.sum("size").over(lane))
    o = offsets.withColumnRenamed("source", "o_source").withColumnRenamed("bucket", "o_bucket")
    j = laid.join(o, laid["source"].eqNullSafe(o["o_source"]) & (laid["bucket"] == o["o_bucket"]))
    quota = F.round("target").cast("bigint")
    size, whole = F.col("source_size"), F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0))
    start = F.col("offset") + F.col("upto") - F.col("size")
    j = j.withColumns({"quota": quota, "start": start}).withColumn("whole", whole.cast("bigint"))
    part = F.least(F.greatest(F.col("quota") - F.col("whole") * size - F.col("start"), F.lit(0)), F.col("size"))
    j = j.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("bigint"))
    last = F.col("whole") + F.when(part > 0, F.lit(0)).otherwise(F.lit(-1))  # number of the last use

    def position(use):
        u = (use * size + F.col("start")) / F.col("quota")
        return invert_schedule(F.least(u, F.lit(1.0)), schedules, F.col("source_rank"))

    positions = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last), position)).otherwise(
        F.array().cast("array<double>"))
    out = j.select("doc_id", "source", "size", "source_size", "target", "taken", positions.alias("positions"),
                   *["row"] * len(row))
    first = F.try_element_at("positions", F.lit(1))
    return out.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **options) -> DataFrame:
    """The documents of the mix with all their columns, whole, once for each use (the part
    that ends a source's quota counts from half a document), range-sorted by position.
    Every row is placed by itself: rows that share an id or a text keep their own uses."""
    # numbered once: the stored number identifies a row whatever its id
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
                  .withColumn("n", F.monotonically_increasing_id()))
    number = "__row"
    while number in docs.columns:
        number = "_" + number
    plan = curriculum_mix(rows.select("row.*", F.col("n").alias(number)), id_col, text_col, source_col, row_col=number, **options)
    uses = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = plan.where("taken > 0").select(F.col("row").alias("n"), "doc_id", F.slice("positions", 1, uses).alias("positions"))
    j = rows.join(stored(plan.where(F.size("positions") > 0)), "n")
    j = j.select("row", F.explode("positions").alias("position"), "doc_id")
    return j.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")
