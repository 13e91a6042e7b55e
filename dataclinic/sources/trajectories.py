"""Trajectory / run-log / chat fixtures derived from the driver tables.

``actions`` (FIXTURES.md §4): one agent step per event.  episode_id =
user_id * 2 + event_id % 2 (two agents over the same user = same seed);
steps ordered by (ts, event_id); the command is element
(event_id * 5 + length(event_type)) % 12 + 1 of the 12 commands; apply/reject
carry id event_id % 4 + 1.  Numbers (accuracy, quality, rows) are simple
functions of the event so the same rows come out of DuckDB.

``runs``: one training episode per event, run = user_id, episode = position,
reward = value / 250 - 1, success = value > 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_to
from ..functions.sequence import ordered_rank
from ..operators.traj import VALID_COMMANDS
from . import tables as TB

# Task constants for the fixture (reference easy task): baseline, target, budget.
BASELINE, TARGET, BUDGET = 0.63, 0.79, 25
ORIGINAL_ROWS = 200

_CMD = "element_at(array(%s), CAST((event_id * 5 + length(event_type)) %% 12 + 1 AS INT))" % ", ".join(
    f"'{c}'" for c in VALID_COMMANDS)
_ACTION = (f"CASE WHEN {_CMD} IN ('apply', 'reject') THEN {_CMD} || ' ' || CAST(event_id % 4 + 1 AS STRING) "
           f"ELSE {_CMD} END")
_EXPRS = {
    "episode_id": "user_id * 2 + event_id % 2",
    "agent": "CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'trained' END",
    "task": "'task_' || CAST(user_id % 4 AS STRING)",
    "seed": "user_id",
    "action": _ACTION,
    "accuracy": "round((0.55 + (value % 30) / 100.0) * 10000) / 10000",
    "quality_before": "round((0.5 + (event_id % 50) / 100.0) * 10000) / 10000",
    "quality_after": "round((0.5 + (event_id % 50) / 100.0 + ((event_id % 7) - 3) / 100.0) * 10000) / 10000",
    "rows": f"{ORIGINAL_ROWS} - event_id % 40",
    "n_recs": "event_id % 4 + 1",
    "response": "props",
}


def actions(spark, sf_dir) -> DataFrame:
    """Materialised once per session (parquet table in the shared checkpoint folder)."""
    from ..session import cut_lineage
    return TB._memo(spark, sf_dir, "actions", lambda: cut_lineage(_actions(spark, sf_dir)))


def runs(spark, sf_dir) -> DataFrame:
    """Materialised once per session (parquet table in the shared checkpoint folder)."""
    from ..session import cut_lineage
    return TB._memo(spark, sf_dir, "runs", lambda: cut_lineage(_runs(spark, sf_dir)))


def _actions(spark, sf_dir) -> DataFrame:
    e = TB.table(spark, sf_dir, "events")
    d = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    d = d.select("event_id", "ts", *[F.expr(v).alias(k) for k, v in _EXPRS.items()])
    d = ordered_rank(d, ["episode_id"], ["ts", "event_id"], rank_col="step")
    return d.select("episode_id", "step", "event_id", "ts", "agent", "task", "seed", "action", "accuracy",
                    F.lit(BASELINE).alias("baseline"), F.lit(TARGET).alias("target"), "quality_before",
                    "quality_after", F.col("rows").cast("long").alias("rows"),
                    F.lit(ORIGINAL_ROWS).cast("long").alias("original_rows"), F.lit(BUDGET).alias("budget_total"),
                    "n_recs", "response")


def _runs(spark, sf_dir) -> DataFrame:
    e = TB.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                                                 "value")
    d = ordered_rank(e, ["user_id"], ["ts", "event_id"], rank_col="episode")
    return d.select(F.col("user_id").alias("run_id"), "episode", "ts",
                    round_to(F.col("value") / 250.0 - 1.0, 4).alias("reward"),
                    (F.col("value") > 50).alias("success"),
                    round_to(F.col("value") / 100.0, 4).alias("accuracy_gain"),
                    (F.col("event_id") % 30 + 1).cast("int").alias("steps_used"))


def conversations(spark, sf_dir) -> DataFrame:
    return TB.table(spark, sf_dir, "conversations")


# ------------------------------------------------------------------ DuckDB mirror
def _sql_expr(v: str) -> str:
    return v.replace("AS STRING", "AS VARCHAR").replace("element_at(array(", "list_element(list_value(")


ACTIONS_SQL = (
    "SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY ts, event_id) AS step, event_id, ts, "
    "agent, task, seed, action, accuracy, " + f"CAST({BASELINE} AS DOUBLE) AS baseline, CAST({TARGET} AS DOUBLE) "
    "AS target, quality_before, "
    "quality_after, CAST(rows AS BIGINT) AS rows, " + f"CAST({ORIGINAL_ROWS} AS BIGINT) AS original_rows, "
    f"{BUDGET} AS budget_total, n_recs, response FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, "
    + ", ".join(f"{_sql_expr(v)} AS {k}" for k, v in _EXPRS.items()) + " FROM events)")
RUNS_SQL = ("SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode, "
            "CAST(ts AS TIMESTAMP) AS ts, round(value / 250.0 - 1.0, 4) AS reward, value > 50 AS success, "
            "round(value / 100.0, 4) AS accuracy_gain, CAST(event_id % 30 + 1 AS INTEGER) AS steps_used FROM events")


def sql_cte(name: str) -> str:
    if name == "actions":
        return f"actions AS ({ACTIONS_SQL})"
    if name == "runs":
        return f"runs AS ({RUNS_SQL})"
    raise KeyError(name)
