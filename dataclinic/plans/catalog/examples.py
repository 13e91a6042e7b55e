"""Families S (training-example tables) and IO (JSON-lines sources and sinks)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import examples as EX
from ...operators import metrics as ME
from ...operators import score as SC
from ...session import ensure_checkpoint_dir
from ...sources import logs as LG
from ...sources import tables as TB
from ...sources import trajectories as TJ
from . import register
from .common import r6
from .runlogs import _EPS_SQL, _MEANS
from .trajectories import BASE_SQL


def _strategies_sql():
    rows = ", ".join("('%s', [%s])" % (n, ", ".join(f"'{a}'" for a in acts)) for n, acts in EX.STRATEGIES.items())
    tasks = ", ".join(f"('{t}')" for t in EX.TASKS)
    return (f"st AS (SELECT * FROM (VALUES {rows}) v(strategy, actions)), tk AS (SELECT * FROM (VALUES {tasks}) v(task)), "
            "sd AS (SELECT DISTINCT user_id AS seed FROM events), "
            "ex AS (SELECT strategy, task, seed, CAST(generate_subscripts(actions, 1) - 1 AS INTEGER) AS step, "
            "unnest(actions) AS action FROM sd, st, tk)")


def _seeds(spark, sf):
    return TB.table(spark, sf, "events").select(F.col("user_id").alias("seed"))


@register("s1_expand", f"WITH {_strategies_sql()}\nSELECT * FROM ex")
def s1_expand(spark, sf):
    return EX.expand(spark, _seeds(spark, sf))


_P1 = "printf('%.1f%%', round(({x}) * 100.0, 1))"


def _p(x):
    return _P1.format(x=x)


_PROMPT_SQL = ("'Current situation:' || chr(10) || 'Accuracy: ' || " + _p("accuracy") + " || ' → Target: ' || "
               + _p("target") + " || chr(10) || 'Still need: ' || " + _p("greatest(0.0, target - accuracy)")
               + " || ' improvement' || chr(10) || 'Quality score: ' || printf('%.2f', round(quality_after, 2)) || "
               "'/1.00' || chr(10) || 'Rows preserved: ' || " + _p("rows / original_rows")
               + " || chr(10) || 'Budget remaining: ' || CAST(budget_remaining AS VARCHAR) || ' steps' || chr(10) || "
               "'Free validates left: ' || CAST(greatest(0, 3 - validates_before) AS VARCHAR) || chr(10) || "
               "'Active query session: ' || CASE WHEN session_id > 0 THEN 'session ' || CAST(session_id AS VARCHAR) "
               "ELSE 'none' END || chr(10) || chr(10) || 'Last result:' || chr(10) || substr(coalesce(response, ''), 1, 400)"
               " || chr(10) || chr(10) || 'What is your next action? (one command only)'")


@register("s2_prompt", f"{BASE_SQL}\nSELECT episode_id, step, {_PROMPT_SQL} AS prompt FROM e")
def s2_prompt(spark, sf):
    e = SC.enrich(TJ.actions(spark, sf))
    obs = e.select("episode_id", "step", "accuracy", "target", F.col("quality_after").alias("quality"),
                   (F.col("rows") / F.col("original_rows")).alias("rows_pct"), "budget_remaining",
                   F.greatest(F.lit(0), 3 - F.col("validates_before")).alias("validates_left"),
                   F.when(F.col("session_id") > 0, F.concat(F.lit("session "), F.col("session_id").cast("string")))
                   .alias("session"), "response")
    return EX.prompt(obs).select("episode_id", "step", "prompt")


PAIRS_SQL = ("SELECT a.conv_id, a.turn, u.turn AS prompt_turn, u.text AS prompt, a.text AS response FROM conversations a "
             "JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn = (SELECT max(x.turn) FROM "
             "conversations x WHERE x.conv_id = a.conv_id AND x.role = 'user' AND x.turn < a.turn) "
             "WHERE a.role = 'assistant'")


@register("s3_pairs", PAIRS_SQL)
def s3_pairs(spark, sf):
    return EX.pairs(TB.table(spark, sf, "conversations"))


CHAT_SYSTEM = "Answer with one command."


@register("s4_chat", f"""SELECT conv_id, turn, 3 AS n_messages, 'system,user,assistant' AS roles, {len(CHAT_SYSTEM)}
  AS system_chars, prompt AS user_content, response AS assistant_content FROM ({PAIRS_SQL})""")
def s4_chat(spark, sf):
    c = EX.chat(EX.pairs(TB.table(spark, sf, "conversations")), CHAT_SYSTEM)
    m = F.col("messages")
    return c.select("conv_id", "turn", F.size(m).alias("n_messages"),
                    F.concat_ws(",", F.transform(m, lambda x: x["role"])).alias("roles"),
                    F.length(m[0]["content"]).alias("system_chars"), m[1]["content"].alias("user_content"),
                    m[2]["content"].alias("assistant_content"))


@register("s5_sample", f"""WITH {_strategies_sql()}
SELECT * FROM ex ORDER BY md5(concat_ws('|', '42', strategy, task, seed, step)), strategy, task, seed, step LIMIT 500""")
def s5_sample(spark, sf):
    return EX.sample(EX.expand(spark, _seeds(spark, sf)), ["strategy", "task", "seed", "step"], 500)


@register("s6_diversity", f"""SELECT count(*)::BIGINT AS total, count(DISTINCT response)::BIGINT AS unique_responses,
  count(DISTINCT prompt)::BIGINT AS unique_prompts FROM ({PAIRS_SQL})""")
def s6_diversity(spark, sf):
    return EX.diversity(EX.pairs(TB.table(spark, sf, "conversations")))


@register("s6_response_distribution", f"""WITH {_strategies_sql()}
SELECT action AS response, count(*)::BIGINT AS count, round(count(*) * 100.0 / (SELECT count(*) FROM ex), 6) AS pct,
  count(*) * 100.0 / (SELECT count(*) FROM ex) > 25.0 AS dominant FROM ex GROUP BY action""")
def s6_response_distribution(spark, sf):
    e = EX.expand(spark, _seeds(spark, sf)).withColumnRenamed("action", "response")
    return r6(EX.response_distribution(e))


@register("s6_dominant_responses", f"""WITH {_strategies_sql()}, c AS (SELECT action AS response, count(*) AS n FROM ex GROUP BY action)
SELECT response, n::BIGINT AS count, round(n * 100.0 / (SELECT count(*) FROM ex), 6) AS pct FROM c
WHERE n * 100.0 / (SELECT count(*) FROM ex) > 5.0""")
def s6_dominant_responses(spark, sf):
    """Responses above 5 % of all examples, found by a sketch and counted exactly."""
    e = EX.expand(spark, _seeds(spark, sf)).withColumnRenamed("action", "response")
    return r6(EX.dominant_responses(e, min_pct=5.0))


# ---------------------------------------------------------------------------- IO1-IO5
def _scratch(spark, tag):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{tag}-{uuid.uuid4().hex[:8]}"


def _write_lines(df, path, extra_lines=()):
    lines = df.select(F.col("value"))
    if extra_lines:
        lines = lines.unionByName(df.sparkSession.createDataFrame([(x,) for x in extra_lines], "value string"))
    lines.write.mode("overwrite").text(path)


@register("io1_read_runs", f"""WITH {TB.sql_ctes('runs')}
SELECT CAST(run_id AS VARCHAR) AS note, episode, 'task_1_easy' AS task, 1 AS level, reward, accuracy_gain, success,
  steps_used FROM runs""")
def io1_read_runs(spark, sf):
    r = TJ.runs(spark, sf)
    rec = r.select(F.to_json(F.struct((F.unix_micros("ts") / 1e6).alias("ts"), "episode",
                                      F.lit("task_1_easy").alias("task"), F.lit(1).alias("level"), "reward",
                                      "accuracy_gain", "steps_used", "success",
                                      F.col("run_id").cast("string").alias("note"))).alias("value"))
    path = _scratch(spark, "runs")
    _write_lines(rec, path, ["", "{not json"])
    raw = LG.read_runs(spark, path)
    return LG.normalize(raw).select("note", "episode", "task", "level", "reward", "accuracy_gain", "success",
                                    "steps_used")


@register("io2_normalize", f"""WITH {TB.sql_ctes('runs')}
SELECT CASE WHEN run_id % 2 = 1 THEN episode ELSE CAST(row_number() OVER (PARTITION BY run_id ORDER BY episode) - 1
  AS BIGINT) END AS episode, CASE WHEN run_id % 2 = 1 THEN 'new' ELSE 'easy' END AS task, CAST(run_id % 2 AS INTEGER) AS level,
  reward, accuracy_gain, CASE WHEN run_id % 2 = 1 THEN success ELSE accuracy_gain > 0.05 END AS success FROM runs""")
def io2_normalize(spark, sf):
    """A folder of both formats, one file a run: even runs by the old keys, odd by the new."""
    r = TJ.runs(spark, sf)
    old = F.to_json(F.struct(F.col("episode").alias("step"), F.lit("easy").alias("stage"),
                             F.col("reward").alias("mean_total_reward"), F.col("accuracy_gain").alias("mean_env_reward")))
    new = F.to_json(F.struct("episode", F.lit("new").alias("task"), F.lit(1).alias("level"), "reward", "accuracy_gain",
                             "success"))
    lines = r.select("run_id", "episode", F.when(F.col("run_id") % 2 == 1, new).otherwise(old).alias("value"))
    path = _scratch(spark, "steplog")
    LG.write_runs(lines, path)
    return LG.normalize(LG.read_runs(spark, path)).select("episode", "task", "level", "reward", "accuracy_gain",
                                                          "success")


@register("io3_append", f"""WITH {TB.sql_ctes('runs')}
SELECT run_id, (count(*) * 2)::BIGINT AS n_records, round(2 * sum(round(reward, 4)), 6) AS reward_sum,
  round(2 * sum(round(accuracy_gain, 4)), 6) AS gain_sum FROM runs GROUP BY run_id""")
def io3_append(spark, sf):
    r = TJ.runs(spark, sf).select("run_id", "episode", "reward", "accuracy_gain", "success")
    path = _scratch(spark, "append")
    LG.append(r, path)
    LG.append(r, path)
    back = spark.read.schema("run_id bigint, episode bigint, reward double, accuracy_gain double, success boolean") \
        .json(path)
    return r6(back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("reward").alias("reward_sum"),
                                         F.sum("accuracy_gain").alias("gain_sum")))


@register("io4_examples_roundtrip", f"SELECT prompt, response FROM ({PAIRS_SQL})")
def io4_examples_roundtrip(spark, sf):
    path = _scratch(spark, "examples")
    LG.write_examples(EX.pairs(TB.table(spark, sf, "conversations")), path)
    return LG.read_examples(spark, path)


@register("io5_metrics_roundtrip", f"""{_EPS_SQL}
SELECT agent, task, {_MEANS}, count(*)::BIGINT AS n_episodes, (SELECT count(*) FROM eps)::BIGINT AS episodes_read
FROM eps GROUP BY GROUPING SETS ((agent, task), (agent))""")
def io5_metrics_roundtrip(spark, sf):
    eps = ME.episodes(SC.enrich(TJ.actions(spark, sf)))
    path = _scratch(spark, "metrics")
    LG.write_metrics(eps, ME.summary(eps), path)
    back, summ = LG.read_metrics(spark, path)
    return summ.crossJoin(F.broadcast(back.agg(F.count(F.lit(1)).alias("episodes_read"))))  # one row
