"""Streaming curriculum scheduler keyed by run.

An ordered fold (``ordered.py``): episodes wait until the watermark has passed and are counted in (ts, event_id) order,
whatever files and batches they came in.  State per run: the current level, the episode count and the last ``window``
successes (bounded list).  A run that has been idle for ``idle_us`` of event time leaves the state, which so holds live
runs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import curriculum as CU
from .ordered import BUCKET_US, SHARDS, Fold, ordered_fold, watermarked

OUT_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("episode", T.LongType()),
    T.StructField("level", T.IntegerType()), T.StructField("advanced", T.BooleanType()),
])


class CurriculumFold(Fold):
    columns = [f.name for f in OUT_SCHEMA.fields]
    fields = ["ts_us", "event_id", "success"]

    def __init__(self, window: int, threshold: float, start: int, max_level: int):
        self.window, self.threshold, self.first, self.max_level = window, threshold, start, max_level

    def start(self, key, row):
        return {"level": self.first, "n": 0, "last": []}

    def step(self, key, s, row):
        s["n"] += 1
        s["last"] = (s["last"] + [int(bool(row[2]))])[-self.window:]
        adv = (len(s["last"]) >= self.window and sum(s["last"]) / len(s["last"]) >= self.threshold
               and s["level"] < self.max_level)
        if adv:
            s["level"], s["last"] = s["level"] + 1, []
        yield key[0], s["n"], s["level"], adv


def curriculum_stream(episodes: DataFrame, window: int = CU.WINDOW, threshold: float = CU.THRESHOLD,
                      start: int = CU.START_LEVEL, max_level: int = CU.MAX_LEVEL,
                      watermark: str = "10 minutes", idle_us: int = 30 * 24 * 3600 * 1_000_000, end=None, bucket_us: int = BUCKET_US,
                      shards: int = SHARDS) -> DataFrame:
    """Streaming levels from a streaming frame (run_id, event_id, ts, success).  Rows from the time ``end`` on only
    move the watermark.  Start it inside ``ordered.rocksdb_state``."""
    d = watermarked(episodes, "ts", watermark, end).select("run_id", "event_id", F.unix_micros("ts").alias("ts_us"),
                                                           "ts", "success")
    return ordered_fold(d, "run_id", CurriculumFold(window, threshold, start, max_level), OUT_SCHEMA, idle_us, bucket_us, shards)
