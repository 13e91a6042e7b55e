"""Episode metrics, summaries and agent comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_to
from ..functions.sequence import DEFAULT_CHUNK, halo_window

SUMMARY_METRICS = ["accuracy_improvement", "target_hit", "budget_used", "budget_efficiency", "format_rate",
                   "strategy_rate"]
HIT_RATE_PASS = 0.60


def episodes(enriched: DataFrame, episode: str = "episode_id", step: str = "step", keys=("agent", "task", "seed"),
             chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Per-episode metrics from trajectory rows (``score.enrich`` output)."""
    def build(d, w):
        return d.withColumn("__prev_action", F.lag("action").over(w))

    d = halo_window(enriched, [episode], step, 1, build, chunk)
    strat = (F.coalesce(F.col("__prev_action").startswith("query_"), F.lit(False))
             & F.col("action").startswith("apply")).cast("long")
    g = d.groupBy(episode, *keys).agg(
        F.max_by("accuracy", step).alias("final_accuracy"), F.first("baseline").alias("baseline_accuracy"),
        F.first("target").alias("target_accuracy"), F.max_by("budget_remaining", step).alias("__rem"),
        F.first("budget_total").alias("__total"), F.count(F.lit(1)).alias("n_actions"),
        F.sum(F.col("valid_format").cast("long")).alias("__valid"), F.sum(strat).alias("__strat"))
    used = F.col("__total") - F.greatest(F.col("__rem"), F.lit(0))
    imp = F.col("final_accuracy") - F.col("baseline_accuracy")
    return g.select(
        episode, *keys, round_to("final_accuracy", 4).alias("final_accuracy"),
        round_to("baseline_accuracy", 4).alias("baseline_accuracy"),
        round_to("target_accuracy", 4).alias("target_accuracy"), round_to(imp, 4).alias("accuracy_improvement"),
        (F.col("final_accuracy") >= F.col("target_accuracy")).alias("target_hit"), used.cast("long").alias("budget_used"),
        round_to(imp / F.greatest(used, F.lit(1)), 6).alias("budget_efficiency"),
        round_to(F.col("__valid") / F.greatest(F.col("n_actions"), F.lit(1)), 4).alias("format_rate"),
        round_to(F.col("__strat") / F.greatest(F.col("n_actions") - 1, F.lit(1)), 4).alias("strategy_rate"),
        F.col("n_actions").cast("long").alias("n_actions"))


def _exact_avg(c):
    """Mean computed in DECIMAL (exact sum), returned as DOUBLE: the result does
    not depend on the order in which partitions are summed."""
    return F.avg(F.col(c).cast("double").cast("decimal(38,10)")).cast("double")


def summary(eps: DataFrame, agent: str = "agent", task: str = "task") -> DataFrame:
    """Mean of the six metrics (rounded to 4) per (agent, task) and per agent
    overall (task NULL), as GROUPING SETS in one aggregation."""
    aggs = [round_to(_exact_avg(m), 4).alias(m) for m in SUMMARY_METRICS]
    r = eps.rollup(agent, task).agg(*aggs, F.count(F.lit(1)).alias("n_episodes"))
    return r.where(F.col(agent).isNotNull())


def compare(eps: DataFrame, base_agent: str, other_agent: str, agent: str = "agent",
            pair_keys=("task", "seed")) -> DataFrame:
    """Both agents on the same (task, seed); mean metrics per agent over the
    matched keys; % change (NULL when the base is 0) and percentage points for
    the hit rate.  One row per metric.  Each side is first reduced to one row
    per (task, seed), so the join is 1:1 and never emits pairs within a group."""
    pk = list(pair_keys)

    def side(name, prefix):
        e = eps.where(F.col(agent) == name)
        return e.groupBy(*pk).agg(*[_exact_avg(m).alias(f"{prefix}_{m}") for m in SUMMARY_METRICS])

    j = side(base_agent, "b").join(side(other_agent, "o"), pk)
    agg = j.agg(*[_exact_avg(f"b_{m}").alias(f"b_{m}") for m in SUMMARY_METRICS],
                *[_exact_avg(f"o_{m}").alias(f"o_{m}") for m in SUMMARY_METRICS], F.count(F.lit(1)).alias("n_pairs"))
    rows = []
    for m in SUMMARY_METRICS:
        bv, ov = round_to(F.col(f"b_{m}"), 4), round_to(F.col(f"o_{m}"), 4)
        pct = F.when(bv != 0, round_to((ov - bv) / F.abs(bv) * 100.0, 4))
        pp = round_to((ov - bv) * 100.0, 4) if m == "target_hit" else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(m).alias("metric"), bv.alias("base"), ov.alias("other"), pct.alias("pct_change"),
                             pp.alias("pp_change")))
    return agg.select("n_pairs", F.explode(F.array(*rows)).alias("r")).select("r.*", F.col("n_pairs").cast("long"))


def hit_rate(eps: DataFrame, scored: DataFrame, agent: str = "agent", keys=("task", "seed"),
             episode: str = "episode_id") -> DataFrame:
    """Per (agent, task, seed): hit, budget used, summed reward; plus the
    agent's overall hit rate and whether it reaches 60%."""
    rew = scored.groupBy(episode).agg(F.sum("total").alias("total_reward"))
    d = eps.join(rew, episode)
    per = d.groupBy(agent, *keys).agg(F.max(F.col("target_hit").cast("int")).cast("boolean").alias("hit"),
                                      F.max("budget_used").alias("budget_used"),
                                      round_to(F.sum("total_reward"), 4).alias("total_reward"))
    overall = per.groupBy(agent).agg(F.avg(F.col("hit").cast("double")).alias("agent_hit_rate"))
    return per.join(overall, agent).withColumns({
        "agent_hit_rate": round_to("agent_hit_rate", 4), "passes": F.col("agent_hit_rate") >= HIT_RATE_PASS})
