"""Ordered-sequence primitives that never put one whole sequence in one task.

Trajectories and run logs are ordered per key (episode, run, conversation).
One key may hold a large share of all rows, so ``Window.partitionBy(key)``
over raw rows is avoided; instead:

* ``ordered_rank`` / ``range_rank``: exact 1-based position within the key.  Level 1 numbers
  rows inside (key, order-preserving bucket) -- e.g. the day of ``ts`` --;
  level 2 prefix-sums the bucket counts (one row per bucket); the offsets are
  joined back.
* chunks: once positions exist, ``chunk = (pos - 1) div C`` splits every key
  into bounded pieces.  ``halo_window`` copies the last ``lookback`` rows of
  each chunk into the next one, so ``lag``/bounded frames are exact inside a
  (key, chunk) window of at most C + lookback rows.
* ``running_sum``: cumulative sums as local sums inside (key, chunk) plus the
  prefix sum of earlier chunk totals.
* ``next_marked``: the next marked position at or after each row, by a window inside chunks
  and one row per chunk beyond.
* ``fsm_scan``: a left fold of a small finite-state machine (e.g. the
  validate cooldown).  Transition functions of chunks, and of runs of chunks, are composed
  in SQL; start states come down the same two levels; each chunk's rows are scanned as one
  array that carries their columns, so nothing is joined back and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import _null_safe_join

DEFAULT_CHUNK = 1 << 16


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def ordered_rank(df: DataFrame, part_cols, order_cols, bucket: Column | None = None, rank_col: str = "step",
                 num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by part order by order_cols)``.

    With ``bucket`` (an integer, non-decreasing in the order and of bounded size, e.g.
    ``floor(turn / C)``) rows are numbered inside (key, bucket) and the bucket
    offsets are joined back (``_offsets``: also where order values are so wide that nearly
    every row is its own bucket, no window holds a whole key).  Without it the frame is
    range-partitioned on (key, order) -- sampled boundaries split a hot key over many
    partitions -- and see ``range_rank``."""
    if bucket is None:
        return range_rank(df, part_cols, order_cols, rank_col, num_partitions)
    p = list(part_cols)
    b = "__obucket"
    d0 = df.withColumn(b, bucket)
    d = d0.withColumn("__olocal", F.row_number().over(Window.partitionBy(*p, b).orderBy(*_cols(order_cols))))
    counts = d0.groupBy(*p, b).agg(F.count(F.lit(1)).alias("__on"))
    out = _null_safe_join(d, _offsets(counts, p, b), p + [b])
    return out.withColumn(rank_col, (F.col("__ooff") + F.col("__olocal")).cast("bigint")).drop(b, "__olocal", "__ooff")


def _offsets(counts: DataFrame, p: list[str], b: str, levels: int = 2) -> DataFrame:
    """Rows of the key before each bucket: (part, bucket, __ooff) of ``counts`` (part, bucket, __on).

    Prefix sums inside runs of 2^16 buckets, plus the rows before a run, found alike over runs: three levels
    cover buckets of 48 bits (64-bit values over 2^16) with windows of at most 2^16 rows."""
    before = lambda *by: Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *by: F.coalesce(F.sum("__on").over(before(*by)), F.lit(0))
    if levels == 0:
        return counts.select(*p, b, inside(*p).alias("__ooff"))
    run = f"{b}{levels}"
    d = counts.withColumn(run, F.shiftright(F.col(b).cast("bigint"), 16))
    runs = d.groupBy(*p, run).agg(F.sum("__on").alias("__on")).withColumnRenamed(run, b)
    above = _offsets(runs, p, b, levels - 1).withColumnRenamed(b, run).withColumnRenamed("__ooff", "__oabove")
    local = d.select(*p, b, run, inside(*p, run).alias("__oin"))
    return (_null_safe_join(local, above, p + [run])
            .select(*p, b, (F.col("__oabove") + F.col("__oin")).alias("__ooff")))


def range_rank(df: DataFrame, part_cols, order_cols, rank_col: str = "step",
               num_partitions: int | None = None) -> DataFrame:
    """Exact per-key positions from a range-partitioned, sorted frame, JVM side only.

    Every sorted partition numbers its rows (``monotonically_increasing_id``: the
    partition in the upper bits, the row below); the numbered frame is stored before
    anything is derived from it, so partition numbers and rows stay the same however
    often it is read.  A row's position is its number less the first number of its key
    in that partition, plus the key's rows in earlier partitions: one aggregated row per
    (key, partition), joined back.  NULL is a key like any other."""
    from ..session import cut_lineage
    p = list(part_cols)
    keys = p + list(order_cols)
    d = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    d = cut_lineage(d.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    d = d.withColumn("__pid", F.shiftright("__id", 33))
    counts = d.groupBy(*p, "__pid").agg(F.count(F.lit(1)).alias("__c"), F.min("__id").alias("__first"))
    w = Window.partitionBy(*p).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*p, "__pid", "__first", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    out = _null_safe_join(d, offs, p + ["__pid"])
    pos = F.col("__off") + F.col("__id") - F.col("__first") + 1
    return out.withColumn(rank_col, pos.cast("bigint")).drop("__pid", "__id", "__first", "__off")


def with_chunk(df: DataFrame, pos_col: str = "step", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    return df.withColumn("__chunk", F.floor((F.col(pos_col) - 1) / chunk).cast("bigint"))


def halo_window(df: DataFrame, part_cols, pos_col: str, lookback: int, build, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Evaluate window columns that look back at most ``lookback`` rows.

    ``build(df, w)`` receives the chunked frame and a WindowSpec partitioned by
    (part, chunk) ordered by ``pos_col`` and must return df with new columns."""
    if lookback >= chunk:
        raise ValueError("lookback must be smaller than the chunk size")
    d = with_chunk(df, pos_col, chunk)
    in_tail = F.pmod(F.col(pos_col) - 1, F.lit(chunk)) >= chunk - lookback
    copies = F.when(in_tail & F.lit(lookback > 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    d = d.withColumn("__halo", F.explode(copies))
    d = d.withColumn("__chunk", F.col("__chunk") + F.col("__halo").cast("bigint"))
    w = Window.partitionBy(*part_cols, "__chunk").orderBy(pos_col)
    out = build(d, w)
    return out.where(~F.col("__halo")).drop("__halo", "__chunk")


def running_sum(df: DataFrame, part_cols, pos_col: str, values: dict, chunk: int = DEFAULT_CHUNK,
                inclusive: bool = True) -> DataFrame:
    """Cumulative sums of ``values`` (name -> numeric Column) in ``pos_col`` order."""
    p = list(part_cols)
    d = with_chunk(df, pos_col, chunk)
    tmp = {f"__v_{k}": v for k, v in values.items()}
    d = d.withColumns(tmp)
    lw = Window.partitionBy(*p, "__chunk").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__l_{k}": F.sum(f"__v_{k}").over(lw) for k in values})
    tot = d.groupBy(*p, "__chunk").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    cw = Window.partitionBy(*p).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*p, "__chunk", *[F.coalesce(F.sum(f"__t_{k}").over(cw), F.lit(0)).alias(f"__o_{k}")
                                       for k in values])
    out = _null_safe_join(d, offs, p + ["__chunk"])
    res = {}
    for k in values:
        s = F.col(f"__o_{k}") + F.col(f"__l_{k}")
        res[k] = s if inclusive else s - F.col(f"__v_{k}")
    out = out.withColumns(res)
    drop = [c for c in out.columns if c.startswith(("__v_", "__l_", "__o_"))] + ["__chunk"]
    return out.drop(*drop)


def sequence_features(df: DataFrame, part_cols, pos_col: str, lags: dict, sums: dict, lookback: int,
                      chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Lags and running sums in ONE chunked window pass plus one offsets join.

    ``lags``: name -> (column, k) with k <= lookback; ``sums``: name ->
    (Column, inclusive).  Halo rows come first inside a (key, chunk) window, so
    masking them out of the sums gives exact chunk-local running sums; the sum
    of earlier chunk totals is added from a per-chunk aggregate."""
    p = list(part_cols)
    tmp = {f"__v_{k}": c.cast("long") if not isinstance(c, str) else F.col(c) for k, (c, _) in sums.items()}

    def build(d, w):
        d = d.withColumns(tmp)
        cols = {k: F.lag(c, n).over(w) for k, (c, n) in lags.items()}
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        for k in sums:
            cols[f"__l_{k}"] = F.sum(F.when(~F.col("__halo"), F.col(f"__v_{k}")).otherwise(F.lit(0))).over(run)
        d = d.withColumns(cols)
        return d.withColumn("__keep_chunk", F.col("__chunk"))

    out = halo_window(df, p, pos_col, lookback, build, chunk)
    if not sums:
        return out.drop("__keep_chunk")
    tot = out.groupBy(*p, "__keep_chunk").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    cw = Window.partitionBy(*p).orderBy("__keep_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*p, "__keep_chunk", *[F.coalesce(F.sum(f"__t_{k}").over(cw), F.lit(0)).alias(f"__o_{k}")
                                            for k in sums])
    out = _null_safe_join(out, offs, p + ["__keep_chunk"])
    res = {}
    for k, (_, inclusive) in sums.items():
        s_ = F.col(f"__o_{k}") + F.col(f"__l_{k}")
        res[k] = s_ if inclusive else s_ - F.col(f"__v_{k}")
    out = out.withColumns(res)
    drop = [c for c in out.columns if c.startswith(("__v_", "__l_", "__o_"))] + ["__keep_chunk"]
    return out.drop(*drop)


def next_marked(df: DataFrame, part_cols, pos_col: str, mark: str, out_col: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``out_col``: the smallest position >= the row's own whose row has ``mark``, in the same key.
    Inside a chunk by a window, beyond it by the first marked position of later chunks (one row a chunk)."""
    p = list(part_cols)
    d = with_chunk(df, pos_col, chunk)
    hit = F.when(F.col(mark), F.col(pos_col))
    rest = Window.partitionBy(*p, "__chunk").orderBy(pos_col).rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("__here", F.min(hit).over(rest))
    firsts = d.groupBy(*p, "__chunk").agg(F.min(hit).alias("__first"))
    later = Window.partitionBy(*p).orderBy("__chunk").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(*p, "__chunk", F.min("__first").over(later).alias("__later"))
    out = _null_safe_join(d, firsts, p + ["__chunk"])
    return out.withColumn(out_col, F.coalesce("__here", "__later")).drop("__chunk", "__here", "__later")


#: Rows of a chunk, and chunks of a run of chunks, in a state scan.
SCAN = 1024


def _table_sql(table: list[list[int]]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(str(x) for x in row) + ")" for row in table) + ")"


def _states_sql(items: str, step: str, start: str) -> str:
    """SQL of the state before each item: a scan of ``items`` from ``start``; ``step``: the next state from acc.s and x."""
    return (f"aggregate({items}, named_struct('s', {start}, 'out', cast(array() as array<int>)), "
            f"(acc, x) -> named_struct('s', {step}, 'out', array_append(acc.out, acc.s)), acc -> acc.out)")


def fsm_scan(df: DataFrame, part_cols, pos_col: str, code: Column, table: list[list[int]], start: int = 0,
             chunk: int = SCAN, state_col: str = "state_before") -> DataFrame:
    """Adds ``state_col`` = FSM state before each row, folding ``table[code][state]``
    in ``pos_col`` order per key (positions are dense and start at 1).  All in the JVM:

    1. up: the transition function (one state per start state) of every full chunk of ``chunk`` rows is composed, and
       those of every full run of ``chunk`` chunks;
    2. down: start states of the runs of a key, from them of its chunks, by scans of these functions;
    3. the rows of a chunk are one array, which is scanned from the chunk's start state and unfolded again: rows
       carry their columns through, so no state is joined back to a row.

    A key no longer than one chunk takes step 3 only.  A task holds ``chunk`` rows at a time."""
    p = list(part_cols)
    n = len(table[0])
    lit = _table_sql(table)
    by_code = f"element_at(element_at({lit}, x.__code + 1), acc.s + 1)"
    identity = f"sequence(0, {n - 1})"
    d = with_chunk(df, pos_col, chunk).withColumns({"__code": code.cast("int"), "__pos": F.col(pos_col).cast("bigint")})

    slim = d.groupBy(*p, "__chunk").agg(F.expr("array_sort(collect_list(struct(__pos, __code)))").alias("__a"))
    compose = f"transform(acc, s -> element_at(element_at({lit}, x.__code + 1), s + 1))"
    funcs = slim.where(F.size("__a") == chunk).select(*p, "__chunk", F.expr(f"aggregate(__a, {identity}, (acc, x) -> {compose})").alias("__f"))
    runs = funcs.withColumn("__run", F.floor(F.col("__chunk") / chunk).cast("bigint")).groupBy(*p, "__run").agg(
        F.expr("array_sort(collect_list(struct(__chunk, __f)))").alias("__a"))
    whole = runs.where(F.size("__a") == chunk).select(*p, "__run", F.expr(
        f"aggregate(__a, {identity}, (acc, x) -> transform(acc, s -> element_at(x.__f, s + 1)))").alias("__f"))
    # one row a key: its runs of chunk ** 2 rows
    tops = whole.groupBy(*p).agg(F.expr("array_sort(collect_list(struct(__run, __f)))").alias("__a"))

    def scan(items, number, first):
        """Rows (number of the next item, its start state) of a scan of functions."""
        step = "element_at(x.__f, acc.s + 1)"
        states = (f"aggregate({items}, named_struct('s', {first}, 'out', cast(array() as array<int>)), (acc, x) -> "
                  f"named_struct('s', {step}, 'out', array_append(acc.out, {step})), acc -> acc.out)")
        return F.expr(f"inline(transform({states}, (s, i) -> named_struct('__n', {items}[i].{number} + 1, '__start', s)))")

    run_start = tops.select(*p, scan("__a", "__run", f"{start}")).withColumnRenamed("__n", "__run")
    runs = _null_safe_join(runs, run_start, p + ["__run"], how="left").withColumn("__s0", F.coalesce("__start", F.lit(start)))
    in_runs = runs.select(*p, scan("__a", "__chunk", "__s0")).withColumnRenamed("__n", "__chunk")
    # the first chunk of a run starts where the run does
    heads = run_start.select(*p, (F.col("__run") * chunk).alias("__chunk"), "__start")
    starts = in_runs.where(F.col("__chunk") % chunk != 0).unionByName(heads)

    keep = [c for c in d.columns if c not in ("__chunk", "__code", "__pos")]
    rows = d.groupBy(*p, "__chunk").agg(F.array_sort(F.collect_list(F.struct(
        "__pos", "__code", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))),
        lambda a, b: F.signum(a["__pos"] - b["__pos"]).cast("int")).alias("__a"))  # rows may hold maps, which have no order
    rows = _null_safe_join(rows, starts, p + ["__chunk"], how="left")
    states = _states_sql("__a", by_code, f"coalesce(__start, {start})")
    out = rows.select(F.col("__a.__row").alias("__rows"), F.expr(states).alias("__states"))
    out = out.select(F.explode(F.arrays_zip("__rows", "__states")).alias("__z"))
    return out.select(*[F.col(f"__z.__rows.`{c}`").alias(c) for c in keep], F.col("__z.__states").alias(state_col))
