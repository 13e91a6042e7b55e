"""Run-log analytics (R1-R9): rolling curves, level changes, summaries.

Curves are per run ordered by episode.  Bounded frames (fixed window w) use
``halo_window`` (chunks of C episodes plus w-1 halo rows); per-run adaptive
windows use prefix sums and an equi-join on (run, position - w), which is exact
for any w and never holds a run in one task.  Positions are numbered here, so
episodes may have gaps and start anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import hash_hex, hash_int
from ..functions.sequence import DEFAULT_CHUNK, halo_window, ordered_rank, running_sum

MIN_WINDOW = 3
LEVEL_WINDOW = 10
SAMPLE_EVERY = 10
SAMPLE_K = 3
SAMPLE_BUCKETS = 1024


def _run_sizes(df, run):
    return df.groupBy(run).agg(F.count(F.lit(1)).alias("__n"))


def _numbered(df: DataFrame, run: str, pos: str, chunk: int, name: str = "__p") -> DataFrame:
    """1-based dense position of each row in its run by ``pos``: episodes may start at 0 and
    have gaps, so ``pos`` itself is never used as a position."""
    return ordered_rank(df, [run], [pos], F.floor(F.col(pos) / F.lit(chunk)), name)


def rolling(df: DataFrame, value: str, w: int, run: str = "run_id", pos: str = "episode",
            out: str | None = None, require_full: bool = True, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Mean of the last ``w`` values (min_periods=1) per run; NULL
    for runs shorter than ``w`` when ``require_full`` (the reference draws the
    curve only when n >= w)."""
    out = out or f"{value}_rolling"

    def build(d, wspec):
        return d.withColumn(out, F.avg(value).over(wspec.rowsBetween(-(w - 1), 0)))

    r = halo_window(_numbered(df, run, pos, chunk), [run], "__p", w - 1, build, chunk).drop("__p")
    if require_full:
        r = r.join(_run_sizes(df, run), run).withColumn(out, F.when(F.col("__n") >= w, F.col(out))).drop("__n")
    return r


def adaptive_window(df: DataFrame, requested: int, run: str = "run_id") -> DataFrame:
    """R2: per run w = max(3, min(requested, n // 3))."""
    return _run_sizes(df, run).select(run, F.greatest(F.lit(MIN_WINDOW), F.least(
        F.lit(requested), F.floor(F.col("__n") / 3))).cast("long").alias("window"))


def adaptive_rolling(df: DataFrame, value: str, requested: int, run: str = "run_id", pos: str = "episode",
                     chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """R2: rolling mean with each run's own adaptive window, via prefix sums:
    mean_t = (S_t - S_{t-w}) / min(t, w).  The prefix sums are DECIMAL(38,10),
    so the difference is exact (no cancellation error however long the run)."""
    d = running_sum(_numbered(df, run, pos, chunk), [run], "__p", {"__s": F.col(value).cast("decimal(38,10)")}, chunk)
    d = d.join(adaptive_window(df, requested, run), run)
    prev = d.select(run, (F.col("__p") + F.col("window")).alias("__p"), F.col("__s").alias("__sp"))
    j = d.join(prev, [run, "__p"], "left")
    diff = F.col("__s") - F.coalesce(F.col("__sp"), F.lit(0).cast("decimal(38,10)"))
    mean = diff.cast("double") / F.least(F.col("__p"), F.col("window")).cast("double")
    return j.withColumn(f"{value}_rolling", mean).drop("__s", "__sp", "__p")


def level_changes(df: DataFrame, run: str = "run_id", pos: str = "episode", level: str = "level",
                  chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Episodes where the level differs from the previous one (the first
    episode counts) and level > 0."""
    def build(d, w):
        return d.withColumn("__prev_level", F.lag(level).over(w))

    r = halo_window(_numbered(df, run, pos, chunk), [run], "__p", 1, build, chunk)
    return r.where((F.col("__prev_level").isNull() | (F.col("__prev_level") != F.col(level))) & (F.col(level) > 0)) \
        .drop("__prev_level", "__p")


def success_rate(df: DataFrame, w: int, run: str = "run_id", pos: str = "episode", level: str = "level",
                 success: str = "success", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Rolling success rate per (run, level) in episode order."""
    d = df.withColumn("__s", F.col(success).cast("double"))
    d = ordered_rank(d, [run, level], [pos], F.floor(F.col(pos) / F.lit(chunk)), "__lpos")

    def build(x, wspec):
        return x.withColumn("success_rate", F.avg("__s").over(wspec.rowsBetween(-(w - 1), 0)))

    return halo_window(d, [run, level], "__lpos", w - 1, build, chunk).drop("__s", "__lpos")


def summary(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Episodes, avg / min / max reward, success rate and max level per run.  The mean comes from a DECIMAL sum,
    so it does not depend on the order in which rows are added."""
    mean = F.sum(F.col("reward").cast("decimal(38,10)")).cast("double") / F.count("reward")
    return df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_episodes"), mean.alias("avg_reward"),
        F.min("reward").alias("min_reward"), F.max("reward").alias("max_reward"),
        F.avg(F.col("success").cast("double")).alias("success_rate"), F.max("level").alias("max_level"))


def step_metrics(rewards: DataFrame, group: str, episode: str = "episode_id", step: str = "step",
                 total: str = "total", env: str = "env", fmt: str = "format") -> DataFrame:
    """Mean final total reward per episode, mean env and format reward over
    all actions and the share of actions with a positive format reward."""
    per_ep = rewards.groupBy(group, episode).agg(F.max_by(total, step).alias("__final"))
    a = per_ep.groupBy(group).agg(F.avg("__final").alias("mean_total_reward"))
    b = rewards.groupBy(group).agg(F.avg(env).alias("mean_env_reward"), F.avg(fmt).alias("mean_format_reward"),
                                   (F.sum((F.col(fmt) > 0).cast("long")) / F.greatest(F.count(F.lit(1)), F.lit(1)))
                                   .alias("format_rate"))
    return a.join(b, group)


def samples(df: DataFrame, train_step: str, member: str, value_cols, every: int = SAMPLE_EVERY, k: int = SAMPLE_K,
            buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """At every ``every``-th training step, the first ``k`` members (by id)
    with their values.  Two-level top-k: top k inside (step, hash bucket), then
    top k over the at most k x buckets survivors."""
    d = df.where(F.col(train_step) % every == 0)
    d = d.withColumn("__b", F.pmod(hash_int(hash_hex(0, member)), F.lit(buckets)))
    w1 = Window.partitionBy(train_step, "__b").orderBy(member)
    d = d.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k)
    w2 = Window.partitionBy(train_step).orderBy(member)
    return (d.withColumn("sample", F.row_number().over(w2)).where(F.col("sample") <= k)
            .select(train_step, "sample", member, *value_cols))
