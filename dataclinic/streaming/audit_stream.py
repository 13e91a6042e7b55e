"""Streaming action audit keyed by episode (H1 cooldown + G9 bonus, H2 apply limits, H6 budget,
H5 time-out).

An ordered fold (``ordered.py``): actions wait until the watermark has passed and are audited in (ts, event_id) order,
whatever files and batches they came in.  State per episode: step count, cooldown state, budget used, session, start
time.  An episode that has not submitted by 300 s after its start is force-submitted: one row of its own at that time,
by an event-time timer, also when no further action ever comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import parse_command
from ..operators import audit as AU
from ..operators import traj as TR
from .ordered import BUCKET_US, SHARDS, Fold, ordered_fold, watermarked

OUT_SCHEMA = T.StructType([
    T.StructField("episode_id", T.LongType()), T.StructField("step", T.LongType()),
    T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("cmd", T.StringType()),
    T.StructField("forced", T.BooleanType()),
    T.StructField("validate_allowed", T.BooleanType()), T.StructField("validate_counted", T.BooleanType()),
    T.StructField("validate_bonus", T.DoubleType()), T.StructField("budget_used", T.LongType()),
    T.StructField("exhausted", T.BooleanType()), T.StructField("timed_out", T.BooleanType()),
    T.StructField("apply_outcome", T.StringType()), T.StructField("penalty", T.DoubleType()),
])
TIMEOUT_US = AU.EPISODE_TIMEOUT_SECS * 1_000_000


def _code(cmd: str) -> int:
    if cmd == "validate":
        return AU.CODE_VALIDATE
    if cmd in ("apply", "undo"):
        return AU.CODE_MODIFY
    if cmd == "inspect_model":
        return AU.CODE_INSPECT_MODEL
    return AU.CODE_OTHER


class AuditFold(Fold):
    columns = [f.name for f in OUT_SCHEMA.fields]
    fields = ["ts_us", "event_id", "cmd", "arg", "n_recs"]

    def __init__(self, budget_total: int):
        self.budget_total = budget_total

    def start(self, key, row):
        return {"steps": 0, "fsm": 0, "used": 0, "start": row[0], "session": 0, "offered": 0, "recorded": [], "ended": False}

    def deadline(self, s):
        return None if s["ended"] else s["start"] + TIMEOUT_US

    def on_deadline(self, key, s):
        s["ended"] = True
        yield (key[0], None, None, s["start"] + TIMEOUT_US, "submit", True, None, None, 0.0, s["used"], False, True, None,
               AU.TIMEOUT_PENALTY)

    def _apply(self, s, a: int) -> str:
        if a < 1:
            return "invalid_id"
        if len(s["recorded"]) >= AU.MAX_APPLIES_PER_SESSION:
            return "session_limit"
        if a in s["recorded"]:
            return "duplicate"
        if s["session"] == 0 or a > s["offered"]:
            return "stale"
        s["recorded"].append(a)
        return "ok"

    def step(self, key, s, row):
        ts_us, event_id, cmd, arg, n_recs = row
        outcome = None
        if cmd in TR.SESSION_QUERIES:
            s["session"], s["offered"], s["recorded"] = s["session"] + 1, int(n_recs or 0), []
        elif cmd == "apply":
            outcome = self._apply(s, int(arg))
        s["steps"] += 1
        cnt, since, cache = s["fsm"] // 6, (s["fsm"] % 6) // 2, s["fsm"] % 2
        is_v = cmd == "validate"
        allowed = is_v and (cnt == 0 or since >= AU.VALIDATE_COOLDOWN)
        counted = allowed and cache == 0
        bonus = (AU.VALIDATE_BONUS if cnt < AU.FREE_VALIDATES else AU.VALIDATE_COST) if counted else 0.0
        exhausted = self.budget_total - (s["used"] + 1) < 0
        s["used"] += 2 if cmd in TR.DOUBLE_COST else 1
        s["ended"] = s["ended"] or cmd == "submit"
        s["fsm"] = AU.COOLDOWN_TABLE[_code(cmd)][s["fsm"]]
        yield (key[0], s["steps"], event_id, ts_us, cmd, False, allowed if is_v else None, counted if is_v else None, float(bonus),
               s["used"], exhausted, ts_us - s["start"] > TIMEOUT_US, outcome, 0.0)


def audit_stream(actions: DataFrame, budget_total: int = 25, watermark: str = "10 minutes",
                 idle_us: int = 24 * 3600 * 1_000_000, end=None, bucket_us: int = BUCKET_US,
                 shards: int = SHARDS) -> DataFrame:
    """Streaming DataFrame of audit rows (one per action, one per forced submit) from a streaming ``actions``
    frame with columns episode_id, event_id, ts (TIMESTAMP), action and n_recs
    (ids offered by a session-opening query).  Rows from the time ``end`` on only move the watermark.  Start it
    inside ``ordered.rocksdb_state``."""
    cmd, arg = parse_command("action")
    d = watermarked(actions, "ts", watermark, end).select(
        "episode_id", "event_id", "ts", F.unix_micros("ts").alias("ts_us"), cmd.alias("cmd"), arg.alias("arg"),
        F.col("n_recs").cast("int").alias("n_recs"))
    return ordered_fold(d, "episode_id", AuditFold(budget_total), OUT_SCHEMA, idle_us, bucket_us, shards)
