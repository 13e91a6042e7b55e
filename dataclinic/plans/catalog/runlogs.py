"""Family R (run-log analytics, curriculum, episode metrics) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import curriculum as CU
from ...operators import metrics as ME
from ...operators import runlogs as RL
from ...operators import score as SC
from ...sources import tables as TB
from ...sources import trajectories as TJ
from . import register
from .common import r6
from .sqlgen import r6 as s6
from .trajectories import BASE_SQL, G1_SQL, G2_SQL, G3_SQL, G4_SQL, G8_SQL

# Small-window variant so that level advances happen on the test tables.
W5, T5 = 5, 0.6


def curriculum_sql(w: int, t: float) -> str:
    return f"""lv_rec AS (SELECT * FROM (WITH RECURSIVE cur(run_id, episode, level, dq, advanced) AS (
    SELECT DISTINCT run_id, CAST(0 AS BIGINT), 1, CAST([] AS INTEGER[]), false FROM runs
    UNION ALL
    SELECT run_id, episode, CASE WHEN adv THEN level + 1 ELSE level END,
      CASE WHEN adv THEN CAST([] AS INTEGER[]) ELSE l3 END, adv FROM (
      SELECT run_id, episode, level, l3, len(l3) >= {w} AND list_avg(l3) >= {t} AND level < 3 AS adv FROM (
        SELECT c.run_id, c.episode + 1 AS episode, c.level,
          CASE WHEN len(list_append(c.dq, CAST(r.success AS INTEGER))) > {w}
               THEN list_slice(list_append(c.dq, CAST(r.success AS INTEGER)), 2, {w + 1})
               ELSE list_append(c.dq, CAST(r.success AS INTEGER)) END AS l3
        FROM cur c JOIN runs r ON r.run_id = c.run_id AND r.episode = c.episode + 1)))
  SELECT run_id, episode, level, advanced FROM cur WHERE episode > 0)),
rl AS (SELECT r.*, lv_rec.level, lv_rec.advanced FROM runs r JOIN lv_rec USING (run_id, episode))"""


def _runs_level(spark, sf, w=W5, t=T5):
    return CU.replay(TJ.runs(spark, sf), window=w, threshold=t)


def _with(w=W5, t=T5):
    return f"WITH {TB.sql_ctes('runs')}, {curriculum_sql(w, t)}"


# ---------------------------------------------------------------------------- R1 / R5 / R6
@register("r1_rolling_reward", f"""{_with()}
SELECT run_id, episode, CASE WHEN count(*) OVER (PARTITION BY run_id) >= 20 THEN {s6('avg(reward) OVER w')} END
  AS reward_rolling FROM rl WINDOW w AS (PARTITION BY run_id ORDER BY episode ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def r1_rolling_reward(spark, sf):
    return r6(RL.rolling(TJ.runs(spark, sf), "reward", 20).select("run_id", "episode", "reward_rolling"))


@register("r5_gain_curve", f"""{_with()}
SELECT run_id, episode, CASE WHEN count(*) OVER (PARTITION BY run_id) >= 20 THEN {s6('avg(accuracy_gain) OVER w')} END
  AS accuracy_gain_rolling FROM rl
  WINDOW w AS (PARTITION BY run_id ORDER BY episode ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def r5_gain_curve(spark, sf):
    return r6(RL.rolling(TJ.runs(spark, sf), "accuracy_gain", 20).select("run_id", "episode", "accuracy_gain_rolling"))


@register("r6_level_curve", f"""{_with()}
SELECT run_id, episode, {s6('avg(level) OVER w')} AS level_rolling FROM rl
  WINDOW w AS (PARTITION BY run_id ORDER BY episode ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def r6_level_curve(spark, sf):
    return r6(RL.rolling(_runs_level(spark, sf), "level", 10, require_full=False).select(
        "run_id", "episode", "level_rolling"))


# ---------------------------------------------------------------------------- R2
@register("r2_adaptive_rolling", f"""{_with()},
win AS (SELECT run_id, greatest(3, least(20, count(*) // 3)) AS w FROM rl GROUP BY run_id)
SELECT a.run_id, a.episode, win.w::BIGINT AS "window", round(CAST(sum(CAST(b.reward AS DECIMAL(38,10))) AS DOUBLE) / count(*), 4) AS reward_rolling
FROM rl a JOIN win ON a.run_id = win.run_id JOIN rl b ON b.run_id = a.run_id AND b.episode > a.episode - win.w
  AND b.episode <= a.episode GROUP BY a.run_id, a.episode, win.w""")
def r2_adaptive_rolling(spark, sf):
    d = RL.adaptive_rolling(TJ.runs(spark, sf), "reward", 20)
    from ...functions.expr import round_to
    return d.select("run_id", "episode", "window", round_to("reward_rolling", 4).alias("reward_rolling"))


# ---------------------------------------------------------------------------- R3 / R4 / R7
@register("r3_level_changes", f"""{_with()}
SELECT run_id, episode, level FROM (SELECT *, lag(level) OVER (PARTITION BY run_id ORDER BY episode) AS pl FROM rl)
WHERE (pl IS NULL OR pl <> level) AND level > 0""")
def r3_level_changes(spark, sf):
    return RL.level_changes(_runs_level(spark, sf)).select("run_id", "episode", "level")


@register("r4_success_rate", f"""{_with()}
SELECT run_id, episode, level, {s6('avg(CAST(success AS DOUBLE)) OVER w')} AS success_rate FROM rl
  WINDOW w AS (PARTITION BY run_id, level ORDER BY episode ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def r4_success_rate(spark, sf):
    return r6(RL.success_rate(_runs_level(spark, sf), 20).select("run_id", "episode", "level", "success_rate"))


@register("r7_run_summary", f"""{_with()}
SELECT run_id, count(*)::BIGINT AS n_episodes,
  {s6('CAST(sum(CAST(reward AS DECIMAL(38,10))) AS DOUBLE) / count(reward)')} AS avg_reward, {s6('min(reward)')} AS min_reward,
  {s6('max(reward)')} AS max_reward, {s6('avg(CAST(success AS DOUBLE))')} AS success_rate, max(level) AS max_level
FROM rl GROUP BY run_id""")
def r7_run_summary(spark, sf):
    return r6(RL.summary(_runs_level(spark, sf)))


# ---------------------------------------------------------------------------- R9
@register("r9_samples", f"""WITH {TB.sql_ctes('runs')}
SELECT episode, sample, run_id, reward FROM (SELECT episode, CAST(row_number() OVER (PARTITION BY episode ORDER BY run_id)
  AS INTEGER) AS sample, run_id, reward FROM runs WHERE episode % 10 = 0) WHERE sample <= 3""")
def r9_samples(spark, sf):
    return RL.samples(TJ.runs(spark, sf), "episode", "run_id", ["reward"]).select(
        "episode", F.col("sample").cast("int"), "run_id", "reward")


# ---------------------------------------------------------------------------- R10
@register("r10_curriculum_replay", f"""{_with(CU.WINDOW, CU.THRESHOLD)}
SELECT run_id, episode, level, advanced FROM rl""")
def r10_curriculum_replay(spark, sf):
    return CU.replay(TJ.runs(spark, sf)).select("run_id", "episode", "level", "advanced")


@register("r10_curriculum_replay_w5", f"""{_with()}
SELECT run_id, episode, level, advanced FROM rl""")
def r10_curriculum_replay_w5(spark, sf):
    return _runs_level(spark, sf).select("run_id", "episode", "level", "advanced")


# ---------------------------------------------------------------------------- R8 / R11-R14
_TOTAL = f"round(least(greatest(({G1_SQL}) + ({G2_SQL}) + ({G3_SQL}) + ({G4_SQL}), -1.0), 1.0), 4)"
_EPS_SQL = f"""{BASE_SQL},
s AS (SELECT *, {_TOTAL} AS total, {G8_SQL} AS fmt, lag(action) OVER (PARTITION BY episode_id ORDER BY step) AS pa FROM e),
g AS (SELECT episode_id, agent, task, seed, arg_max(accuracy, step) AS fa, first(baseline) AS ba, first(target) AS ta,
  arg_max(budget_remaining, step) AS rem, first(budget_total) AS tot, count(*) AS n,
  sum(CASE WHEN valid_format THEN 1 ELSE 0 END) AS valid,
  sum(CASE WHEN coalesce(starts_with(pa, 'query_'), false) AND starts_with(action, 'apply') THEN 1 ELSE 0 END) AS strat,
  sum(total) AS total_reward FROM s GROUP BY ALL),
eps AS (SELECT episode_id, agent, task, seed, round(fa, 4) AS final_accuracy, round(ba, 4) AS baseline_accuracy,
  round(ta, 4) AS target_accuracy, round(fa - ba, 4) AS accuracy_improvement, fa >= ta AS target_hit,
  (tot - greatest(rem, 0))::BIGINT AS budget_used, round((fa - ba) / greatest(tot - greatest(rem, 0), 1), 6)
  AS budget_efficiency, round(valid / greatest(n, 1), 4) AS format_rate, round(strat / greatest(n - 1, 1), 4)
  AS strategy_rate, n::BIGINT AS n_actions, total_reward FROM g)"""


def _scored(spark, sf):
    return SC.score(SC.enrich(TJ.actions(spark, sf)))


def _eps(spark, sf):
    return ME.episodes(SC.enrich(TJ.actions(spark, sf)))


@register("r8_step_metrics", f"""{_EPS_SQL}
SELECT agent, {s6('avg(ft)')} AS mean_total_reward, {s6('(SELECT avg(total) FROM s WHERE s.agent = f.agent)')} AS
  mean_env_reward, {s6('(SELECT avg(fmt) FROM s WHERE s.agent = f.agent)')} AS mean_format_reward,
  {s6('(SELECT count(*) FILTER (WHERE fmt > 0) / count(*) FROM s WHERE s.agent = f.agent)')} AS format_rate
FROM (SELECT agent, episode_id, arg_max(total + fmt, step) AS ft FROM s GROUP BY ALL) f GROUP BY agent""")
def r8_step_metrics(spark, sf):
    s = _scored(spark, sf)
    rw = s.select("agent", "episode_id", "step", F.col("total").alias("env"), SC.format_reward().alias("format"))
    rw = rw.withColumn("total", F.col("env") + F.col("format"))
    return r6(RL.step_metrics(rw, "agent"))


_EP_COLS = ("episode_id, agent, task, seed, final_accuracy, baseline_accuracy, target_accuracy, accuracy_improvement, "
            "target_hit, budget_used, budget_efficiency, format_rate, strategy_rate, n_actions")


@register("r11_episode_metrics", f"{_EPS_SQL}\nSELECT {_EP_COLS} FROM eps")
def r11_episode_metrics(spark, sf):
    return _eps(spark, sf)


_MEANS = ", ".join(f"round(avg(CAST(CAST({m} AS DOUBLE) AS DECIMAL(38,10))), 4) AS {m}" for m in ME.SUMMARY_METRICS)


@register("r12_summary", f"""{_EPS_SQL}
SELECT agent, task, {_MEANS}, count(*)::BIGINT AS n_episodes FROM eps GROUP BY GROUPING SETS ((agent, task), (agent))""")
def r12_summary(spark, sf):
    return ME.summary(_eps(spark, sf))


def _r13_sql():
    dec = lambda x: f"CAST(CAST({x} AS DOUBLE) AS DECIMAL(38,10))"
    side = lambda a: (f"SELECT task, seed, {', '.join(f'avg({dec(m)}) AS {m}' for m in ME.SUMMARY_METRICS)} "  # noqa
                      f"FROM eps WHERE agent = '{a}' GROUP BY task, seed")
    parts = []
    for m in ME.SUMMARY_METRICS:
        pp = "round((o - b) * 100.0, 4)" if m == "target_hit" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{m}' AS metric, b AS base, o AS other, CASE WHEN b <> 0 THEN round((o - b) / abs(b) * 100.0, 4)"
                     f" END AS pct_change, {pp} AS pp_change, n_pairs FROM (SELECT round(avg({dec('b.' + m)}), 4) AS b,"
                     f" round(avg({dec('o.' + m)}), 4) AS o, count(*)::BIGINT AS n_pairs FROM ({side('baseline')}) b"
                     f" JOIN ({side('trained')}) o ON b.task = o.task AND b.seed = o.seed)")
    return f"{_EPS_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("r13_compare_agents", _r13_sql())
def r13_compare_agents(spark, sf):
    return ME.compare(_eps(spark, sf), "baseline", "trained")


@register("r14_hit_rate", f"""{_EPS_SQL},
per AS (SELECT agent, task, seed, bool_or(target_hit) AS hit, max(budget_used)::BIGINT AS budget_used,
  round(sum(total_reward), 4) AS total_reward FROM eps GROUP BY ALL),
ov AS (SELECT agent, avg(CAST(hit AS DOUBLE)) AS r FROM per GROUP BY agent)
SELECT per.*, round(ov.r, 4) AS agent_hit_rate, ov.r >= 0.6 AS passes FROM per JOIN ov USING (agent)""")
def r14_hit_rate(spark, sf):
    a = SC.enrich(TJ.actions(spark, sf))
    return ME.hit_rate(ME.episodes(a), SC.score(a))
