"""Families L/G/H: trajectory parsing, rubric scoring and policy audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import audit as AU
from ...operators import score as SC
from ...operators import traj as TR
from ...sources import tables as TB
from ...sources import trajectories as TJ
from ...session import cut_lineage
from . import register
from .common import r6
from .sqlgen import r6 as s6

EP = ["episode_id", "step"]

# ---------------------------------------------------------------------------- DuckDB side
_VALID = " OR ".join(f"starts_with(trim(action), '{c}')" for c in TR.VALID_COMMANDS)
_SESS = ", ".join(f"'{c}'" for c in TR.SESSION_QUERIES)
_DBL = ", ".join(f"'{c}'" for c in TR.DOUBLE_COST)
BASE_SQL = f"""WITH {TB.sql_ctes('actions')},
t0 AS (SELECT *, string_split_regex(trim(action), '\\s+') AS toks FROM actions),
p AS (SELECT * EXCLUDE (toks), coalesce(lower(toks[1]), '') AS cmd,
  CASE WHEN len(toks) > 1 AND regexp_full_match(toks[2], '[+-]?[0-9]+') THEN coalesce(TRY_CAST(toks[2] AS BIGINT), -1) ELSE -1 END AS arg,
  ({_VALID}) AS valid_format FROM t0),
e0 AS (SELECT *, {', '.join(f'lag(cmd, {i}) OVER w AS prev{i}' for i in range(1, 6))},
  coalesce(lag(accuracy) OVER w, baseline) AS prev_accuracy,
  coalesce(sum(CASE WHEN cmd = 'validate' THEN 1 ELSE 0 END) OVER wx, 0) AS validates_before,
  coalesce(sum(CASE WHEN cmd = 'apply' THEN 1 ELSE 0 END) OVER wx, 0) AS applies_before,
  sum(CASE WHEN cmd IN ({_DBL}) THEN 2 ELSE 1 END) OVER wi AS budget_used,
  sum(CASE WHEN cmd IN ({_SESS}) THEN 1 ELSE 0 END) OVER wi AS session_id
  FROM p WINDOW w AS (PARTITION BY episode_id ORDER BY step),
  wx AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  wi AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, budget_total - budget_used AS budget_remaining FROM e0)"""


def _anyp(pred: str, n: int) -> str:
    return "(" + " OR ".join(f"coalesce({pred.format(p=f'prev{i}')}, false)" for i in range(1, n + 1)) + ")"


_SUBMIT = "lower(trim(action)) = 'submit'"
G1_SQL = (f"round(CASE WHEN accuracy - prev_accuracy > 0 THEN (accuracy - prev_accuracy) * 2.5 "
          f"WHEN accuracy - prev_accuracy < 0 THEN (accuracy - prev_accuracy) * 3.0 ELSE 0.0 END + "
          f"CASE WHEN {_SUBMIT} THEN CASE WHEN accuracy >= target THEN 0.35 + 0.30 * greatest(0.0, 1.0 - budget_used / "
          f"greatest(budget_total, 1)) + least((accuracy - target) * 3.0, 0.15) ELSE -0.40 * (1.0 - CASE WHEN "
          f"target - baseline > 0 THEN least(greatest((accuracy - baseline) / (target - baseline), 0.0), 1.0) ELSE 0.0 "
          f"END) END ELSE 0.0 END, 4)")
G2_SQL = ("round(0.0"
          f" + CASE WHEN starts_with(cmd, 'query_') AND {_anyp(chr(123) + 'p' + chr(125) + ' IN (' + chr(39) + 'inspect_dataset' + chr(39) + ', ' + chr(39) + 'inspect_model' + chr(39) + ')', 3)} THEN 0.02 ELSE 0.0 END"
          f" + CASE WHEN starts_with(cmd, 'query_') AND {_anyp('{p} = cmd', 3)} AND NOT {_anyp(chr(123) + 'p' + chr(125) + ' = ' + chr(39) + 'apply' + chr(39), 3)} THEN -0.05 ELSE 0.0 END"
          f" + CASE WHEN cmd = 'apply' THEN CASE WHEN {_anyp('starts_with({p}, ' + chr(39) + 'query_' + chr(39) + ')', 4)} THEN 0.05 ELSE -0.08 END ELSE 0.0 END"
          f" + CASE WHEN cmd = 'validate' AND {_anyp(chr(123) + 'p' + chr(125) + ' = ' + chr(39) + 'apply' + chr(39), 3)} THEN 0.04 ELSE 0.0 END"
          " + CASE WHEN cmd = 'validate' AND coalesce(prev1 = 'validate', false) THEN -0.08 ELSE 0.0 END"
          f" + CASE WHEN cmd = 'validate' AND prev2 IS NOT NULL AND {_anyp(chr(123) + 'p' + chr(125) + ' = ' + chr(39) + 'apply' + chr(39), 2)} AND "
          "(coalesce(prev3 = 'validate', false) OR coalesce(prev4 = 'validate', false)) THEN 0.06 ELSE 0.0 END"
          " + CASE WHEN cmd = 'reject' THEN 0.01 ELSE 0.0 END"
          " + CASE WHEN cmd = 'submit' THEN CASE WHEN validates_before = 0 THEN -0.15 WHEN applies_before = 0 THEN -0.05 "
          "ELSE 0.0 END ELSE 0.0 END, 4)")
G3_SQL = ("round(CASE WHEN rows / greatest(original_rows, 1) >= 0.92 THEN 0.05 WHEN rows / greatest(original_rows, 1) "
          ">= 0.85 THEN 0.02 WHEN rows / greatest(original_rows, 1) >= 0.75 THEN -0.05 WHEN rows / "
          "greatest(original_rows, 1) >= 0.50 THEN -0.20 ELSE -0.50 END, 4)")
_USED = "greatest(budget_total - greatest(budget_remaining, 0), 1)"
G4_SQL = (f"CASE WHEN {_SUBMIT} THEN round(CASE WHEN accuracy - baseline <= 0 THEN -0.10 * {_USED} / "
          f"greatest(budget_total, 1) WHEN accuracy < target THEN least((accuracy - baseline) / {_USED} * 1.5, 0.10) "
          f"ELSE least((accuracy - baseline) / {_USED} * 3.0, 0.25) END, 4) ELSE 0.0 END")
_DQ = "(quality_after - quality_before)"
G5_SQL = (f"CASE WHEN starts_with(action, 'apply') THEN least(greatest(CASE WHEN {_DQ} > 0 THEN "
          f"least(greatest({_DQ} * 0.5, 0.0), 0.12) WHEN {_DQ} < 0 THEN least(greatest({_DQ} * 0.6, -0.25), 0.0) "
          f"ELSE -0.02 END + CASE WHEN rows / greatest(original_rows, 1) >= 0.95 THEN 0.02 WHEN rows / "
          f"greatest(original_rows, 1) >= 0.90 THEN 0.01 WHEN rows / greatest(original_rows, 1) < 0.85 THEN -0.08 "
          f"ELSE 0.0 END, -0.30), 0.15) ELSE 0.0 END")
G8_SQL = "CASE WHEN valid_format THEN 0.10 ELSE -0.10 END"


def _enriched(spark, sf, chunk=None):
    a = TJ.actions(spark, sf)
    return SC.enrich(a) if chunk is None else SC.enrich(a, chunk=chunk)


# ---------------------------------------------------------------------------- L1 / X8
@register("l1_parse", f"{BASE_SQL}\nSELECT episode_id, step, cmd, arg, valid_format FROM p")
def l1_parse(spark, sf):
    return TR.parse(TJ.actions(spark, sf)).select(*EP, "cmd", "arg", "valid_format")


@register("x8_parse_command", f"{BASE_SQL}\nSELECT event_id, cmd, arg FROM p")
def x8_parse_command(spark, sf):
    return TR.parse(TJ.actions(spark, sf)).select("event_id", "cmd", "arg")


# ---------------------------------------------------------------------------- G1-G8
def _g(name, sql_expr, builder):
    @register(name, f"{BASE_SQL}\nSELECT episode_id, step, {s6(sql_expr)} AS value FROM e")
    def q(spark, sf):
        return r6(_enriched(spark, sf).select(*EP, builder().alias("value")))
    q.__name__ = name
    return q


_g("g1_accuracy_rubric", G1_SQL, SC.accuracy_rubric)
_g("g2_process_rubric", G2_SQL, SC.process_rubric)
_g("g3_preservation_rubric", G3_SQL, SC.preservation_rubric)
_g("g4_efficiency_rubric", G4_SQL, SC.efficiency_rubric)
_g("g5_step_rubric", G5_SQL, SC.step_rubric)
_g("g8_format_reward", G8_SQL, SC.format_reward)


@register("g6_total", f"""{BASE_SQL}
SELECT episode_id, step, {s6(f'round(least(greatest(({G1_SQL}) + ({G2_SQL}) + ({G3_SQL}) + ({G4_SQL}), -1.0), 1.0), 4)')}
  AS total FROM e""")
def g6_total(spark, sf):
    return r6(SC.score(_enriched(spark, sf)).select(*EP, "total"))


@register("g7_breakdown", f"""{BASE_SQL}
SELECT episode_id, step, 'accuracy' AS rubric, {s6(G1_SQL)} AS value FROM e
UNION ALL SELECT episode_id, step, 'process', {s6(G2_SQL)} FROM e
UNION ALL SELECT episode_id, step, 'preservation', {s6(G3_SQL)} FROM e
UNION ALL SELECT episode_id, step, 'efficiency', {s6(G4_SQL)} FROM e""")
def g7_breakdown(spark, sf):
    return r6(SC.breakdown(SC.score(_enriched(spark, sf))))


# ---------------------------------------------------------------------------- H1 / G9
def _fsm_sql():
    """The cooldown rule spelled out over (counted validates, steps since the last one, cached)."""
    counted = "(c.cmd = 'validate' AND (r.cnt = 0 OR r.since >= 2) AND r.cache = 0)"
    return f"""{BASE_SQL},
c AS (SELECT episode_id, step, cmd FROM e),
s AS (SELECT * FROM (WITH RECURSIVE r(episode_id, step, cnt, since, cache) AS (
    SELECT DISTINCT episode_id, CAST(1 AS BIGINT), 0, 0, 0 FROM c
    UNION ALL
    SELECT r.episode_id, r.step + 1, CASE WHEN {counted} THEN r.cnt + 1 ELSE r.cnt END,
      CASE WHEN {counted} THEN 0 WHEN c.cmd = 'validate' THEN r.since ELSE r.since + 1 END,
      CASE WHEN c.cmd IN ('apply', 'undo') THEN 0 WHEN c.cmd = 'inspect_model' OR {counted} THEN 1 ELSE r.cache END
    FROM r JOIN c ON c.episode_id = r.episode_id AND c.step = r.step)
  SELECT * FROM r)),
v AS (SELECT c.episode_id, c.step, c.cmd, s.cnt, s.since, s.cache
      FROM c JOIN s ON c.episode_id = s.episode_id AND c.step = s.step),
o AS (SELECT *, cmd = 'validate' AND (cnt = 0 OR since >= 2) AS allowed FROM v)"""


@register("h1_cooldown", f"""{_fsm_sql()}
SELECT episode_id, step, allowed AS validate_allowed, allowed AND cache = 0 AS validate_counted FROM o
WHERE cmd = 'validate'""")
def h1_cooldown(spark, sf):
    d = AU.cooldown(_enriched(spark, sf))
    return d.where(F.col("cmd") == "validate").select(*EP, "validate_allowed", "validate_counted")


@register("g9_validate_bonus", f"""{_fsm_sql()}
SELECT episode_id, step, CASE WHEN allowed AND cache = 0 THEN CASE WHEN cnt < 3 THEN 0.02 ELSE -0.01 END ELSE 0.0 END::DOUBLE
  AS validate_bonus FROM o WHERE cmd = 'validate'""")
def g9_validate_bonus(spark, sf):
    d = AU.cooldown(_enriched(spark, sf))
    return r6(d.where(F.col("cmd") == "validate").select(*EP, "validate_bonus"))


# ---------------------------------------------------------------------------- H2-H8
_RECS_SQL = (f"recs AS (SELECT episode_id, session_id, unnest(range(1, n_recs + 1)) AS rec_id FROM e "
             f"WHERE cmd IN ({_SESS}))")
_LIMITS_SQL = f"""{BASE_SQL}, {_RECS_SQL},
a AS (SELECT e.episode_id, e.step, e.session_id, e.arg, EXISTS (SELECT 1 FROM recs r WHERE r.episode_id = e.episode_id
  AND r.session_id = e.session_id AND r.rec_id = e.arg) AS offered FROM e WHERE cmd = 'apply'),
f AS (SELECT episode_id, session_id, arg, min(step) AS first_step FROM a WHERE arg >= 1 AND offered GROUP BY ALL),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, session_id ORDER BY first_step) AS o FROM f)
  WHERE o <= 3),
j AS (SELECT a.*, (SELECT count(*) FROM rec WHERE rec.episode_id = a.episode_id AND rec.session_id = a.session_id
    AND rec.first_step < a.step) AS applies_before,
  EXISTS (SELECT 1 FROM rec WHERE rec.episode_id = a.episode_id AND rec.session_id = a.session_id
    AND rec.arg = a.arg AND rec.first_step < a.step) AS dup FROM a)"""


@register("h2_apply_limits", f"""{_LIMITS_SQL}
SELECT episode_id, step, session_id::BIGINT AS session_id, arg, applies_before::INTEGER AS applies_before,
  CASE WHEN arg < 1 THEN 'invalid_id' WHEN applies_before >= 3 THEN 'session_limit' WHEN dup THEN 'duplicate'
  WHEN NOT offered THEN 'stale' ELSE 'ok' END AS outcome FROM j""")
def h2_apply_limits(spark, sf):
    e = _enriched(spark, sf)
    return AU.apply_limits(e, AU.recommendations(e))


@register("h3_stale_applies", f"""{BASE_SQL}, {_RECS_SQL}
SELECT episode_id, step, session_id::BIGINT AS session_id, arg FROM e WHERE cmd = 'apply' AND arg >= 1
  AND NOT EXISTS (SELECT 1 FROM recs r WHERE r.episode_id = e.episode_id AND r.session_id = e.session_id
  AND r.rec_id = e.arg)""")
def h3_stale_applies(spark, sf):
    e = _enriched(spark, sf)
    return AU.stale_applies(e, AU.recommendations(e))


@register("h4_truncated", """SELECT conv_id, turn, length(text)::BIGINT AS n_chars, -0.02::DOUBLE AS penalty
FROM conversations WHERE length(text) > 200""")
def h4_truncated(spark, sf):
    return AU.truncated(TB.table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


@register("h5_timeouts", f"""{BASE_SQL},
t AS (SELECT episode_id, step, ts, min(ts) OVER (PARTITION BY episode_id) AS t0 FROM e)
SELECT episode_id, min(step) AS timeout_step, -0.10::DOUBLE AS penalty FROM t
WHERE epoch_us(ts) - epoch_us(t0) > 300000000 GROUP BY episode_id""")
def h5_timeouts(spark, sf):
    return AU.timeouts(_enriched(spark, sf))


@register("h6_budget", f"""{BASE_SQL}
SELECT episode_id, step, cmd, budget_used::BIGINT AS budget_used, budget_remaining::BIGINT AS budget_remaining,
  budget_total - (budget_used - CASE WHEN cmd IN ({_DBL}) THEN 1 ELSE 0 END) < 0 AS exhausted FROM e""")
def h6_budget(spark, sf):
    return AU.budget(_enriched(spark, sf))


_FLAGS_SQL = f"""SELECT episode_id, step, 'repeated_query' AS rule, -0.05::DOUBLE AS penalty FROM e WHERE starts_with(cmd, 'query_')
  AND {_anyp('{p} = cmd', 3)} AND NOT {_anyp(chr(123) + 'p' + chr(125) + " = 'apply'", 3)}
UNION ALL SELECT episode_id, step, 'blind_apply', -0.08 FROM e WHERE cmd = 'apply'
  AND NOT {_anyp("starts_with({p}, 'query_')", 4)}
UNION ALL SELECT episode_id, step, 'redundant_validate', -0.08 FROM e WHERE cmd = 'validate'
  AND coalesce(prev1 = 'validate', false)
UNION ALL SELECT episode_id, step, 'blind_submit', -0.15 FROM e WHERE cmd = 'submit' AND validates_before = 0"""


@register("h7_workflow_flags", f"{BASE_SQL}\n{_FLAGS_SQL}")
def h7_workflow_flags(spark, sf):
    return AU.workflow_flags(_enriched(spark, sf))


@register("h8_audit_report", f"""{_fsm_sql()}, {_RECS_SQL},
{_LIMITS_SQL.split(_RECS_SQL + ',', 1)[1]}
SELECT episode_id, step, 'validate_cooldown' AS rule, 0.0::DOUBLE AS penalty FROM o WHERE cmd = 'validate' AND NOT allowed
UNION ALL SELECT episode_id, step, 'apply_' || CASE WHEN arg < 1 THEN 'invalid_id' WHEN applies_before >= 3
  THEN 'session_limit' WHEN dup THEN 'duplicate' ELSE 'stale' END, 0.0 FROM j
  WHERE arg < 1 OR applies_before >= 3 OR dup OR NOT offered
UNION ALL SELECT episode_id, step, 'truncated', -0.02 FROM e WHERE length(action) > 200
UNION ALL SELECT episode_id, min(step), 'episode_timeout', -0.10 FROM (SELECT *, min(ts) OVER (PARTITION BY episode_id)
  AS t0 FROM e) WHERE epoch_us(ts) - epoch_us(t0) > 300000000 GROUP BY episode_id
UNION ALL SELECT episode_id, step, 'budget_exhausted', 0.0 FROM e
  WHERE budget_total - (budget_used - CASE WHEN cmd IN ({_DBL}) THEN 1 ELSE 0 END) < 0
UNION ALL {_FLAGS_SQL}
UNION ALL SELECT episode_id, step, 'data_loss', -0.40 FROM e WHERE rows / greatest(original_rows, 1) < 0.5""")
def h8_audit_report(spark, sf):
    e = cut_lineage(_enriched(spark, sf))
    return AU.report(e, AU.recommendations(e))
