"""Dirty-data injection (family F): reproducible faults in any keyed table.

Every injector picks its rows by the exact md5 rank of ``seed|tag|column|key``, so
counts are exact and the same rows are chosen by a DuckDB ``row_number() over
(order by md5(...))`` oracle.  The k smallest hashes are those up to the k-th:
that key is one row (``smallest_keys``: bucket counts plus one ordered bucket),
and the injection is a projection of the table, without a sort or a join of it.
A recipe takes each hash once: hashes are even, so the k-th of n lies near k / n, and
a row is stored with its place before, in or after a bracket around it; only rows in
the bracket are ordered.  Counts prove the bracket; where keys repeat so often that it
misses the rank, all rows are counted.  Only copies (F2) are drawn by rank.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import to_number
from ..functions.ranking import bucketed_rank, draw_with_replacement, hash_hex, hash_int, lazy_range, smallest_keys, up_to

# Fixed values from the reference injectors.
TYPE_ERROR_TOKEN = "ERR"
OUTLIER_VALUES = (999.0, -999.0)
#: Half width of a bracket as a share of all hashes, and in standard deviations of the rank of an even hash.
BRACKET, BRACKET_SIGMAS = 1 / 512, 8


ATOMIC = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def tie_columns(df: DataFrame, keys) -> list[str]:
    """Keys first, then every other atomic column: rows that tie on the hash
    (copies made by ``inject_duplicates``) get one deterministic order."""
    rest = [f.name for f in df.schema.fields
            if f.name not in keys and not f.name.startswith("__") and isinstance(f.dataType, ATOMIC)]
    return list(keys) + rest


def _ranked(df: DataFrame, seed, tag: str, keys, rank_col: str, partition_cols=()) -> DataFrame:
    h = f"__h_{rank_col}"
    d = df.withColumn(h, hash_hex(seed, F.lit(tag), *keys))
    return bucketed_rank(d, h, partition_cols, tie_cols=tie_columns(df, keys), rank_col=rank_col).drop(h)


def _key(df: DataFrame, seed, tag: str, keys):
    """Ordering key of a row: its hash, then its other columns, NULLs last."""
    ties = [x for c in tie_columns(df, keys) for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(hash_hex(seed, F.lit(tag), *keys).alias("h"), *[x.alias(f"t{i}") for i, x in enumerate(ties)])


def _marked(df: DataFrame, seed, tags, keys, k):
    """(df with one threshold row attached, a condition for each tag: among the k smallest)."""
    ks = [_key(df, seed, t, keys) for t in tags]
    d = df.crossJoin(F.broadcast(smallest_keys(df, ks, k)))  # one row
    return d, [up_to(c, F.col(f"__t{i}")) for i, c in enumerate(ks)]


class _Step:
    """An injection that keeps all rows: the tags by which rows are picked, how many, and the change of a picked row."""

    def __init__(self, tags, k, change):
        self.tags, self.k, self.change = tags, k, change


def _inject(df: DataFrame, steps: list, seed, keys) -> DataFrame:
    """Several such steps in order, with one threshold pass: rows are picked by hashes of their keys, which no step
    changes (rows that share their keys are ordered by their values before the first step)."""
    steps = [s for s in steps if s.tags]
    if not steps:
        return df
    ks = [_key(df, seed, t, keys) for s in steps for t in s.tags]
    d = df.crossJoin(F.broadcast(smallest_keys(df, ks, [s.k for s in steps for _ in s.tags])))  # one row
    return _changed(df, d, steps, [up_to(c, F.col(f"__t{i}")) for i, c in enumerate(ks)])


def _changed(df: DataFrame, d: DataFrame, steps: list, hits: list) -> DataFrame:
    """``steps`` applied to ``d``, the rows of ``df`` with what ``hits`` read: a condition for each tag."""
    d = d.select(*df.columns, *[h.alias(f"__hit{i}") for i, h in enumerate(hits)])
    at = 0
    for s in steps:
        d = s.change(d, [F.col(f"__hit{i}") for i in range(at, at + len(s.tags))])
        at += len(s.tags)
    return d.select(*df.columns)


def _bracket(k: int, n: int) -> tuple[str, str]:
    """Hex bounds around the k-th smallest of n hashes; all of a small table."""
    f = k / max(n, 1)
    half = max(BRACKET, BRACKET_SIGMAS * math.sqrt(f * (1 - f) / max(n, 1)) + 16 / max(n, 1))
    bound = lambda x: "" if x <= 0 else "g" if x >= 1 else f"{int(x * (1 << 48)):012x}"
    return bound(f - half), bound(f + half)


def _inject_stored(df: DataFrame, steps: list, seed, keys) -> DataFrame:
    """``_inject`` by a stored table: every hash is taken once, and only rows in the brackets of the thresholds are
    ordered.  What returns is a projection of stored tables."""
    from ..session import cut_lineage
    steps = [s for s in steps if s.tags]
    if not steps:
        return df
    tags = [t for s in steps for t in s.tags]
    n = df.agg(F.count(F.lit(1)).alias("n"))
    n, *wanted = n.select("n", *[F.least(s.k(F.col("n")).cast("bigint"), F.col("n")) for s in steps for _ in s.tags]).first()
    bounds = [_bracket(k, n) for k in wanted]
    # the keys are written out once for all tags: ``hash_hex`` of the tag and the keys is md5(seed|tag + rest)
    rest = F.when(F.coalesce(*[F.col(c).cast("string") for c in keys]).isNotNull(), F.concat(
        F.lit("|"), F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))).otherwise("") if keys else F.lit("")
    d = df.withColumn("__rest", rest)
    d = d.select(*df.columns, *[F.md5(F.concat(F.lit(f"{seed}|{t}"), F.col("__rest"))).alias(f"__h{i}") for i, t in enumerate(tags)])
    place = [F.when(F.col(f"__h{i}") < lo, -1).when(F.col(f"__h{i}") < hi, 0).otherwise(1) for i, (lo, hi) in enumerate(bounds)]
    d = cut_lineage(d.select(*df.columns, *[p.cast("tinyint").alias(f"__p{i}") for i, p in enumerate(place)]))
    at = [F.col(f"__p{i}") for i in range(len(tags))]
    seen = d.agg(*[F.count(F.when(p == v, 1)) for p in at for v in (-1, 0)]).first()
    before, inside = seen[0::2], seen[1::2]
    if not all(k == 0 or b < k <= b + m for k, b, m in zip(wanted, before, inside)):
        return cut_lineage(_inject(d.select(*df.columns), steps, seed, keys))  # repeated keys: a bracket misses its rank
    ks = [_key(df, seed, t, keys) for t in tags]
    open_ = reduce(lambda a, b: a | b, [p == 0 for p in at])
    near = cut_lineage(d.where(open_))
    ranks = [lambda _, r=max(k - b, 0): F.lit(r) for k, b in zip(wanted, before)]
    edges = smallest_keys(near, [F.when(p == 0, c) for p, c in zip(at, ks)], ranks)
    settled = _changed(df, d.where(~open_), steps, [p < 0 for p in at])
    hits = [F.when(p == 0, up_to(c, F.col(f"__t{i}"))).otherwise(p < 0) for i, (p, c) in enumerate(zip(at, ks))]
    return settled.unionByName(cut_lineage(_changed(df, near.crossJoin(F.broadcast(edges)), steps, hits)))  # one row


def _at_least_one(frac):
    return lambda n: F.greatest(F.lit(1), F.floor(n * frac))


def _missing(columns, seed, keys, cols, frac):
    cols = [c for c in cols if c in columns]

    def change(d, hits):
        return d.withColumns({c: F.when(h, F.lit(None).cast(d.schema[c].dataType)).otherwise(F.col(c)) for c, h in zip(cols, hits)})
    return _Step([f"missing|{c}" for c in cols], lambda n: F.floor(n * F.lit(frac)), change)


def _type_errors(columns, seed, keys, col, frac):
    return _Step([f"type|{col}"], _at_least_one(frac), lambda d, hits: d.withColumn(
        col, F.when(hits[0], F.lit(TYPE_ERROR_TOKEN)).otherwise(F.col(col).cast("string"))))


def _outliers(columns, seed, keys, col, frac):
    sign = F.pmod(hash_int(hash_hex(seed, F.lit(f"sign|{col}"), *keys)), F.lit(2))
    val = F.when(sign == 0, F.lit(OUTLIER_VALUES[0])).otherwise(F.lit(OUTLIER_VALUES[1]))

    def change(d, hits):
        dt = d.schema[col].dataType
        new = val if isinstance(dt, T.NumericType) else val.cast("string")
        return d.withColumn(col, F.when(hits[0], new.cast(dt)).otherwise(F.col(col)))
    return _Step([f"outlier|{col}"], _at_least_one(frac), change)


def _cross_column(columns, seed, keys, a, b, frac):
    def change(d, hits):
        ta, tb = d.schema[a].dataType, d.schema[b].dataType
        na, nb = to_number(a, ta), to_number(b, tb)
        hit = hits[0] & na.isNotNull() & nb.isNotNull() & (na >= nb)
        return d.withColumns({a: F.when(hit, (nb - 1.0).cast(ta)).otherwise(F.col(a)),
                              b: F.when(hit, (na + 1.0).cast(tb)).otherwise(F.col(b))})
    return _Step([f"cross|{a}|{b}"], _at_least_one(frac), change)


def inject_missing(df: DataFrame, cols, frac: float, seed=42, keys=()) -> DataFrame:
    """for each column independently, int(n*frac) rows become NULL."""
    return _inject(df, [_missing(df.columns, seed, keys, cols, frac)], seed, keys)


def inject_duplicates(df: DataFrame, frac: float, seed=42, keys=()) -> DataFrame:
    """max(1, int(n*frac)) rows drawn with replacement and appended."""
    pool = _ranked(df, seed, "dup-pool", keys, "_rank")
    counts = df.agg(F.count(F.lit(1)).alias("__n"))
    draws = lazy_range(counts.select(F.col("__n"), F.greatest(F.lit(1), F.floor(F.col("__n") * frac))
                                     .cast("bigint").alias("__k")), "__k")
    extra = draw_with_replacement(pool, draws, seed, "dup-draw")
    return df.unionByName(extra.select(*df.columns))


def undersample_class(df: DataFrame, label: str, cls, target_count, seed=42, keys=(),
                      tag: str = "undersample") -> DataFrame:
    """Keep ``target_count`` rows of class ``cls`` (exact hash sample without
    replacement); every other row passes.  No-op when the class is already small."""
    is_cls = F.col(label) == F.lit(cls)
    part = df.where(is_cls)
    rest = df.where(~is_cls | F.col(label).isNull())
    d, (hit,) = _marked(part, seed, [tag], keys, lambda n: F.lit(target_count))
    return rest.unionByName(d.where(hit).select(*df.columns))


def inject_imbalance(df: DataFrame, label: str, ratio: float, cls=None, seed=42, keys=()) -> DataFrame:
    """cut class ``cls`` (default: smallest label value) to int(n*ratio) rows if above it."""
    one = df.agg(F.floor(F.count(F.lit(1)) * ratio).alias("__major"),
                 (F.min(label) if cls is None else F.lit(cls)).alias("__cls"))
    d = df.crossJoin(F.broadcast(one))  # one row
    is_cls = F.col(label) == F.col("__cls")
    part = d.where(is_cls)
    rest = d.where(~is_cls | F.col(label).isNull())
    key = _key(df, seed, "imbalance", keys)
    major = int(one.first()["__major"])
    kth = smallest_keys(part.select(*df.columns), [key], lambda n: F.lit(major))
    kept = part.crossJoin(F.broadcast(kth)).where(up_to(key, F.col("__t0")))
    return rest.select(*df.columns).unionByName(kept.select(*df.columns))


def inject_type_errors(df: DataFrame, col: str, frac: float, seed=42, keys=()) -> DataFrame:
    """max(1, int(n*frac)) cells become 'ERR'; the column becomes STRING."""
    return _inject(df, [_type_errors(df.columns, seed, keys, col, frac)], seed, keys)


def inject_outliers(df: DataFrame, col: str, frac: float, seed=42, keys=()) -> DataFrame:
    """max(1, int(n*frac)) cells become +999 or -999 (sign from the hash)."""
    return _inject(df, [_outliers(df.columns, seed, keys, col, frac)], seed, keys)


def inject_cross_column(df: DataFrame, a: str, b: str, frac: float, seed=42, keys=()) -> DataFrame:
    """among max(1, int(n*frac)) rows, where a >= b set (a, b) := (b - 1, a + 1)."""
    return _inject(df, [_cross_column(df.columns, seed, keys, a, b, frac)], seed, keys)


INJECTORS = {
    "missing": inject_missing,
    "duplicates": inject_duplicates,
    "imbalance": inject_imbalance,
    "type_errors": inject_type_errors,
    "outliers": inject_outliers,
    "cross_column": inject_cross_column,
}


#: Steps that keep all rows: neighbours share one threshold pass and one projection.
_VALUE_STEPS = {"missing": _missing, "type_errors": _type_errors, "outliers": _outliers, "cross_column": _cross_column}


def recipe(df: DataFrame, steps, seed=42, keys=(), checkpoint: bool = True) -> DataFrame:
    """fold a list of ``(injector name, kwargs)`` over the DataFrame.

    Neighbouring steps that keep all rows are one pass for their thresholds and one projection.  An injector
    reads its input twice; with ``checkpoint`` the lineage is cut (a parquet table in
    ``spark.checkpoint.dir``, never ``localCheckpoint``) after each such run and after a step that adds or takes rows."""
    from ..session import cut_lineage
    out, run = df, []

    def flush(out):
        inject = _inject_stored if checkpoint else _inject  # stored already
        return inject(out, [_VALUE_STEPS[n](out.columns, seed, keys, **kw) for n, kw in run], seed, keys)

    for name, kw in steps:
        if name in _VALUE_STEPS:
            run.append((name, kw))
            continue
        if run:
            out = flush(out)
            run = []
        out = INJECTORS[name](out, seed=seed, keys=keys, **kw)
        out = cut_lineage(out) if checkpoint else out
    if run:
        out = flush(out)
    return out
