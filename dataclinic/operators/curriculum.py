"""Curriculum replay (R10) by pointer doubling.

The scheduler starts at level 1, keeps the last ``window`` successes, and
advances (clearing the window) when the window is full and its mean is >=
``threshold``, up to ``max_level``.  The cleared deque is full again exactly
``window`` episodes after the reset, so the first advance is the first episode
whose trailing ``window`` successes meet the threshold (a *candidate*), and the
one after an advance at p is the first candidate at or after p + window.

Every candidate so has one successor.  The advances of a run are the chain of
successors from its first candidate; they are marked in rounds that double the
length of a jump, so their number grows with the logarithm of the advances and
neither plan nor rounds with the levels.  Trailing sums come from prefix sums and
an equi-join on position - window, successors from a chunked look-ahead and one
equi-join; no run is ever held in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import DEFAULT_CHUNK, next_marked, ordered_rank, running_sum
from ..session import cut_lineage

# Fixed values from the reference scheduler.
WINDOW = 50
THRESHOLD = 0.80
START_LEVEL = 1
MAX_LEVEL = 3
LEVEL_TASKS = ["task_0_tutorial", "task_1_easy", "task_2_medium", "task_3_hard"]


def _chain(cand: DataFrame, run: str, at: str, longest: int) -> DataFrame:
    """(run, at, rank) of the candidates on the chain of successors (``next``) from each run's first, ranks from 0;
    ``longest``: no chain that matters has more."""
    first = cand.groupBy(run).agg(F.min(at).alias(at)).withColumn("rank", F.lit(0).cast("long"))
    marked, jump, length = first, cand, 1
    while length < longest:
        hop = jump.where("next is not null").select(F.col(run).alias("r"), F.col(at).alias("a"), "next")
        more = marked.join(hop, (marked[run] == hop["r"]) & (marked[at] == hop["a"])).select(
            run, F.col("next").alias(at), (F.col("rank") + length).alias("rank"))
        marked = cut_lineage(marked.unionByName(more))
        length *= 2
        if length < longest:  # jumps of twice the length
            on = hop.select(F.col("r").alias("r2"), F.col("a").alias("a2"), F.col("next").alias("far"))
            jump = cut_lineage(hop.join(on, (hop["r"] == on["r2"]) & (hop["next"] == on["a2"])).select(
                F.col("r").alias(run), F.col("a").alias(at), F.col("far").alias("next")))
    return marked


def replay(df: DataFrame, run: str = "run_id", pos: str = "episode", success: str = "success",
           window: int = WINDOW, threshold: float = THRESHOLD, start: int = START_LEVEL, max_level: int = MAX_LEVEL,
           chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``level`` (after a possible advance at that episode, as logged) and
    ``advanced`` (true on the advancing episode)."""
    at = "__p"  # dense position: episodes may have gaps and start anywhere
    d = ordered_rank(df, [run], [pos], F.floor(F.col(pos) / F.lit(chunk)), at)
    d = running_sum(d, [run], at, {"__cs": F.col(success).cast("long")}, chunk)
    prev = d.select(run, (F.col(at) + window).alias(at), F.col("__cs").alias("__csp"))
    d = d.join(prev, [run, at], "left")
    trailing = F.col("__cs") - F.coalesce(F.col("__csp"), F.lit(0))
    d = d.withColumn("__ok", (F.col(at) >= window) & (trailing / F.lit(float(window)) >= threshold)).drop("__cs", "__csp")
    d = cut_lineage(d)
    levels = max(0, max_level - start)
    spare = d.agg(F.max(at)).first()[0] or 0
    longest = min(levels, math.ceil(spare / window))
    if longest == 0:
        return d.drop(at, "__ok").withColumns({"level": F.lit(start).cast("int"), "advanced": F.lit(False)})
    ahead = next_marked(d.select(run, at, "__ok"), [run], at, "__ok", "next", chunk)
    after = ahead.select(F.col(run).alias("__r"), (F.col(at) - window).alias("__a"), "next")
    cand = ahead.where("__ok").select(run, at)
    cand = cut_lineage(cand.join(after, (cand[run] == after["__r"]) & (cand[at] == after["__a"]), "left").select(run, at, "next"))
    steps = _chain(cand, run, at, longest).where(F.col("rank") < levels)
    steps = steps.select(F.col(run).alias("__r"), F.col(at).alias("__a"), F.lit(True).alias("advanced"))
    d = d.join(steps, (d[run] == steps["__r"]) & (d[at] == steps["__a"]), "left").drop("__r", "__a", "__ok")
    d = d.withColumn("advanced", F.coalesce("advanced", F.lit(False)))
    d = running_sum(d, [run], at, {"__up": F.col("advanced").cast("long")}, chunk)
    return d.withColumn("level", (F.lit(start) + F.col("__up")).cast("int")).select(*df.columns, "level", "advanced")


def history(replayed: DataFrame, run: str = "run_id", pos: str = "episode") -> DataFrame:
    """(run, episode, from_level) of every advance, as the scheduler records it."""
    return replayed.where("advanced").select(run, pos, (F.col("level") - 1).alias("from_level"))
