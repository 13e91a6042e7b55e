"""Policy audit over trajectories (family H and the validate bonus G9).

All checks are per-episode but none windows a whole episode: the cooldown is
a finite-state scan (``fsm_scan``), session counters are running sums over
chunks, apply limits are small per-session aggregates (at most one row per
distinct recommendation id), time-outs use the per-episode minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import MAX_ACTION_CHARS, TRUNCATION_PENALTY
from ..functions.sequence import SCAN, fsm_scan
from . import traj

# Fixed values from the reference anti-exploit rules.
FREE_VALIDATES = 3
VALIDATE_COOLDOWN = 2
MAX_APPLIES_PER_SESSION = 3
EPISODE_TIMEOUT_SECS = 300
VALIDATE_BONUS, VALIDATE_COST = 0.02, -0.01
TIMEOUT_PENALTY = -0.10
DATA_LOSS_PENALTY = -0.40
DATA_LOSS_RATIO = 0.50

# --- validate cooldown as a finite-state machine -------------------------------------------------
# state = cnt * 6 + since * 2 + cache;  cnt = counted validates (3 = 3 or more),
# since = non-validate steps since the last counted validate (2 = 2 or more),
# cache = 1 when an evaluation is cached (no apply/undo since the last one).
CODE_OTHER, CODE_MODIFY, CODE_INSPECT_MODEL, CODE_VALIDATE = 0, 1, 2, 3


def _enc(cnt, since, cache):
    return cnt * 6 + since * 2 + cache


def _dec(s):
    return s // 6, (s % 6) // 2, s % 2


def _table():
    rows = []
    for code in range(4):
        row = []
        for s in range(24):
            cnt, since, cache = _dec(s)
            nxt = min(since + 1, 2)
            if code == CODE_OTHER:
                row.append(_enc(cnt, nxt, cache))
            elif code == CODE_MODIFY:
                row.append(_enc(cnt, nxt, 0))
            elif code == CODE_INSPECT_MODEL:
                row.append(_enc(cnt, nxt, 1))
            else:
                allowed = cnt == 0 or since >= VALIDATE_COOLDOWN
                if allowed and cache == 0:
                    row.append(_enc(min(cnt + 1, 3), 0, 1))
                else:
                    row.append(s)
        rows.append(row)
    return rows


COOLDOWN_TABLE = _table()


def cooldown(parsed: DataFrame, episode: str = "episode_id", step: str = "step", chunk: int = SCAN) -> DataFrame:
    """H1 + G9: for every validate: allowed (cooldown), counted (allowed and not
    cached) and its bonus (+0.02 for the first three counted, then -0.01)."""
    c = F.col("cmd")
    code = (F.when(c == "validate", CODE_VALIDATE).when(c.isin("apply", "undo"), CODE_MODIFY)
            .when(c == "inspect_model", CODE_INSPECT_MODEL).otherwise(CODE_OTHER))
    d = fsm_scan(parsed, [episode], step, code, COOLDOWN_TABLE, 0, chunk, "__s")
    cnt, since, cache = F.floor(F.col("__s") / 6), F.floor(F.pmod(F.col("__s"), F.lit(6)) / 2), F.pmod(F.col("__s"), F.lit(2))
    is_v = c == "validate"
    allowed = is_v & ((cnt == 0) | (since >= VALIDATE_COOLDOWN))
    counted = allowed & (cache == 0)
    bonus = F.when(counted, F.when(cnt < FREE_VALIDATES, VALIDATE_BONUS).otherwise(VALIDATE_COST)).otherwise(0.0)
    return d.withColumns({"validate_allowed": F.when(is_v, allowed), "validate_counted": F.when(is_v, counted),
                          "validate_bonus": bonus.cast("double")}).drop("__s")


def recommendations(enriched: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Recommendation ids offered per (episode, session): ids 1..n_recs of each
    session-opening query (at most 4 per query)."""
    q = enriched.where(F.col("cmd").isin(traj.SESSION_QUERIES) & (F.col("n_recs") >= 1))  # sequence(1, 0) counts down
    return q.select(episode, "session_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_recs").cast("bigint"))).alias("rec_id"))


def apply_limits(enriched: DataFrame, recs: DataFrame, episode: str = "episode_id") -> DataFrame:
    """H2 (+H3 inside): per apply row, the outcome: ok / invalid_id / session_limit /
    duplicate / stale.  Recorded applies = first occurrence of each offered id in
    the session, at most three per session."""
    a = enriched.where(F.col("cmd") == "apply").select(episode, "step", "session_id", "arg")
    offered = recs.select(episode, "session_id", F.col("rec_id").alias("arg"), F.lit(True).alias("offered"))
    a = a.join(offered, [episode, "session_id", "arg"], "left").withColumn("offered", F.coalesce("offered", F.lit(False)))
    elig = a.where((F.col("arg") >= 1) & F.col("offered"))
    first = elig.groupBy(episode, "session_id", "arg").agg(F.min("step").alias("first_step"))
    # distinct ids per session are bounded by the number offered (<= 4): a tiny window.
    from pyspark.sql import Window
    w = Window.partitionBy(episode, "session_id").orderBy("first_step")
    rec = first.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= MAX_APPLIES_PER_SESSION)
    arr = rec.groupBy(episode, "session_id").agg(F.collect_list(F.struct("first_step", "arg")).alias("recorded"))
    j = a.join(arr, [episode, "session_id"], "left").withColumn(
        "recorded", F.coalesce(F.col("recorded"), F.array().cast("array<struct<first_step:bigint,arg:bigint>>")))
    before = F.size(F.filter("recorded", lambda x: x["first_step"] < F.col("step")))
    dup = F.exists("recorded", lambda x: (x["arg"] == F.col("arg")) & (x["first_step"] < F.col("step")))
    outcome = (F.when(F.col("arg") < 1, "invalid_id").when(before >= MAX_APPLIES_PER_SESSION, "session_limit")
               .when(dup, "duplicate").when(~F.col("offered"), "stale").otherwise("ok"))
    return j.select(episode, "step", "session_id", "arg", before.alias("applies_before"), outcome.alias("outcome"))


def stale_applies(enriched: DataFrame, recs: DataFrame, episode: str = "episode_id") -> DataFrame:
    """H3: applies whose id was not offered in the current session."""
    a = enriched.where((F.col("cmd") == "apply") & (F.col("arg") >= 1)).select(episode, "step", "session_id", "arg")
    return a.join(recs.withColumnRenamed("rec_id", "arg"), [episode, "session_id", "arg"], "left_anti")


def truncated(df: DataFrame, text: str, keys) -> DataFrame:
    """H4: actions longer than 200 characters."""
    return df.where(F.length(text) > MAX_ACTION_CHARS).select(
        *keys, F.length(text).cast("long").alias("n_chars"), F.lit(TRUNCATION_PENALTY).alias("penalty"))


def timeouts(df: DataFrame, episode: str = "episode_id", step: str = "step", ts: str = "ts") -> DataFrame:
    """H5: first step whose wall time since the episode start exceeds 300 s (a
    forced submit).  The episode start is a per-episode min (partial aggregate)."""
    start = df.groupBy(episode).agg(F.min(ts).alias("__t0"))
    d = df.join(start, episode)
    late = d.where(F.unix_micros(F.col(ts)) - F.unix_micros(F.col("__t0")) > EPISODE_TIMEOUT_SECS * 1_000_000)
    return late.groupBy(episode).agg(F.min(step).alias("timeout_step")).withColumn(
        "penalty", F.lit(TIMEOUT_PENALTY))


def forced_submits(df: DataFrame, episode: str = "episode_id", ts: str = "ts", cmd: str = "cmd") -> DataFrame:
    """H5: one row per episode that has not submitted by 300 s after its start, at that time: (episode, ts_us,
    penalty).  One partial aggregate per episode, so an idle episode gives its row too."""
    us = F.unix_micros(F.col(ts))
    per = df.groupBy(episode).agg(F.min(us).alias("__t0"), F.min(F.when(F.col(cmd) == "submit", us)).alias("__done"))
    due = F.col("__t0") + EPISODE_TIMEOUT_SECS * 1_000_000
    return per.where(F.col("__done").isNull() | (F.col("__done") > due)).select(
        episode, due.alias("ts_us"), F.lit(TIMEOUT_PENALTY).alias("penalty"))


def budget(enriched: DataFrame, episode: str = "episode_id") -> DataFrame:
    """H6: ledger (analyst and validator cost 2); ``exhausted`` marks the step
    whose own base cost takes the budget below zero (forced submit)."""
    extra = F.when(F.col("cmd").isin(traj.DOUBLE_COST), 1).otherwise(0)
    used_at_check = F.col("budget_used") - extra
    return enriched.select(episode, "step", "cmd", "budget_used", "budget_remaining",
                           (F.col("budget_total") - used_at_check < 0).alias("exhausted"))


def _workflow_hits() -> list:
    c = F.col("cmd")

    def anyp(pred, n):
        out = F.lit(False)
        for i in range(1, n + 1):
            out = out | F.coalesce(pred(F.col(f"prev{i}")), F.lit(False))
        return out

    return [("repeated_query", c.startswith("query_") & anyp(lambda p: p == c, 3) & ~anyp(lambda p: p == "apply", 3), -0.05),
            ("blind_apply", (c == "apply") & ~anyp(lambda p: p.startswith("query_"), 4), -0.08),
            ("redundant_validate", (c == "validate") & F.coalesce(F.col("prev1") == "validate", F.lit(False)), -0.08),
            ("blind_submit", (c == "submit") & (F.col("validates_before") == 0), -0.15)]


def _hits(df: DataFrame, hits, episode: str) -> DataFrame:
    """One row for each hit rule of a row: (rule, condition, penalty) in one pass."""
    arr = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(h, F.lit(False)).alias("hit"),
                             F.lit(float(p)).alias("penalty")) for r, h, p in hits])
    return (df.select(episode, "step", F.explode(F.filter(arr, lambda x: x["hit"])).alias("f"))
            .select(episode, "step", "f.rule", "f.penalty"))


def workflow_flags(enriched: DataFrame, episode: str = "episode_id") -> DataFrame:
    """H7: the boolean findings of the process rubric."""
    return _hits(enriched, _workflow_hits(), episode)


def report(enriched: DataFrame, recs: DataFrame, episode: str = "episode_id", chunk: int = SCAN) -> DataFrame:
    """H8: one row per breach (rule, episode, step, penalty).  All row-wise rules are one
    pass over the cooldown scan; apply limits and time-outs are joined aggregates."""
    extra = F.when(F.col("cmd").isin(traj.DOUBLE_COST), 1).otherwise(0)
    flags = _hits(cooldown(enriched, episode, "step", chunk), [
        ("validate_cooldown", ~F.col("validate_allowed"), 0.0),
        ("truncated", F.length("action") > MAX_ACTION_CHARS, TRUNCATION_PENALTY),
        ("budget_exhausted", F.col("budget_total") - (F.col("budget_used") - extra) < 0, 0.0),
        *_workflow_hits(),
        ("data_loss", F.col("rows") / F.greatest(F.col("original_rows"), F.lit(1)) < DATA_LOSS_RATIO, DATA_LOSS_PENALTY),
    ], episode)
    limits = apply_limits(enriched, recs, episode).where(F.col("outcome") != "ok").select(
        episode, "step", F.concat(F.lit("apply_"), F.col("outcome")).alias("rule"), F.lit(0.0).alias("penalty"))
    late = timeouts(enriched, episode).select(episode, F.col("timeout_step").alias("step"),
                                              F.lit("episode_timeout").alias("rule"), "penalty")
    return flags.unionByName(limits).unionByName(late)
