"""A keyed fold over a stream in event-time order, with event-time timers (``transformWithState``).

Rows of a key may arrive out of order and over any number of batches.  Keys are dealt by hash into shards, and a shard
is what the state store knows, so a call to the store serves many keys.  Rows wait in map state, in buckets of event
time; a timer at the end of the first one releases the buckets that the watermark has passed, to which no row can still
come, one after the other, and their rows are folded, each with the state of its key, in the order of (time, id).  A
task holds one bucket of one shard, the state store what lies within the watermark's span.  A deadline, set by the fold
for a key, fires by a timer without any input.  A key that has been idle for ``idle`` of event time leaves the state;
its next row begins a new fold.

The state store must be RocksDB (``rocksdb_state``).
"""

from __future__ import annotations

import json
from contextlib import contextmanager
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_US = 60_000_000  # a minute of event time
SHARDS = 4096
HELD = 50_000  # rows of a shard that are held before they are added to their buckets


class Fold:
    """What a stream computes.  States are JSON values; times are microseconds."""

    columns: list[str] = []  # of an output row
    fields: list[str] = []  # of an input row, the event time (``ts_us``) and the row's id first

    def start(self, key, row) -> dict:
        raise NotImplementedError

    def step(self, key, state: dict, row) -> Iterator[tuple]:
        """Output rows of one input row; ``state`` is changed in place."""
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        """Event time at which ``on_deadline`` is due, if it is."""

    def on_deadline(self, key, state: dict) -> Iterator[tuple]:
        return iter(())


class OrderedProcessor(StatefulProcessor):
    def __init__(self, fold: Fold, idle_us: int, bucket_us: int = BUCKET_US):
        self.fold, self.idle, self.bucket = fold, idle_us, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows string")
        self.state = handle.getValueState("fold", "state string")

    def _load(self) -> dict:
        """{"pending": buckets that wait, in order, "timer": end of the bucket for which a timer is set, "keys": for each
        key {"upto": last bucket with a row of it, "last": time of its last folded row, "fold": its state}}."""
        s = self.state.get()
        s = json.loads(s[0]) if s else {"pending": [], "timer": None, "keys": []}
        s["keys"] = dict(s["keys"])
        return s

    def _save(self, s: dict) -> None:
        if s["keys"] or s["pending"]:
            self.state.update((json.dumps(dict(s, keys=list(s["keys"].items()))),))
        else:
            self.state.clear()

    def _end(self, us: int) -> int:
        """End of the bucket of a time: when it has passed, every row up to the time has been released."""
        return (us // self.bucket + 1) * self.bucket

    def _set_timer(self, s: dict, us: int | None) -> None:
        """One timer of the shard, at the earliest bucket end at which there is something to do."""
        if us is not None and (s["timer"] is None or us < s["timer"]):
            self.handle.registerTimer(-(-us // 1000))
            s["timer"] = us

    def _wait(self, pending: set, parts: dict) -> None:
        for b, part in parts.items():
            if b in pending:
                part = [self.waiting.getValue((b,))[0], *part]
            pending.add(b)
            self.waiting.updateValue((b,), ("\n".join(part),))

    def handleInputRows(self, key, rows, timerValues):
        s = self._load()
        pending, parts, held = set(s["pending"]), {}, 0
        for pdf in rows:  # a chunk of the shard's rows at a time
            for b, row in zip(pdf["bucket"].tolist(), pdf["row"].tolist()):
                parts.setdefault(b, []).append(row)
                k = next(iter(json.loads(row).values()))
                e = s["keys"].setdefault(k, {"upto": b, "last": None, "fold": None})
                e["upto"] = max(e["upto"], b)
            held += len(pdf)
            if held >= HELD:
                self._wait(pending, parts)
                parts, held = {}, 0
        self._wait(pending, parts)
        s["pending"] = sorted(pending)
        if s["pending"]:
            self._set_timer(s, (s["pending"][0] + 1) * self.bucket)
        self._save(s)
        return iter(())

    def _release(self, s: dict, b: int) -> list[tuple]:
        """Folds the rows of a bucket, in order."""
        fold, out = self.fold, []
        rows = [tuple(json.loads(r).values()) for r in self.waiting.getValue((b,))[0].split("\n")]
        self.waiting.removeKey((b,))
        for k, *row in sorted(rows, key=lambda r: (r[1], r[2])):
            e = s["keys"][k]
            if e["fold"] is None:
                e["fold"] = fold.start((k,), row)
            due = fold.deadline(e["fold"])
            if due is not None and row[0] > due:
                out += fold.on_deadline((k,), e["fold"])
            out += fold.step((k,), e["fold"], row)
            e["last"] = row[0]
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        s = self._load()
        while s["pending"] and (s["pending"][0] + 1) * self.bucket <= now:
            out = self._release(s, s["pending"].pop(0))
            if out:
                yield self._frame(out)
        out, times = [], [(b + 1) * self.bucket for b in s["pending"][:1]]
        for k, e in list(s["keys"].items()):
            if e["fold"] is None:
                continue  # its rows wait
            due = self.fold.deadline(e["fold"])
            if due is not None and self._end(due) <= now:
                out += self.fold.on_deadline((k,), e["fold"])
            elif due is not None:
                times.append(self._end(due))
            if (e["upto"] + 1) * self.bucket <= now:
                if self._end(e["last"] + self.idle) <= now:
                    del s["keys"][k]
                else:
                    times.append(self._end(e["last"] + self.idle))
        s["timer"] = None if s["timer"] is None or s["timer"] <= now else s["timer"]
        self._set_timer(s, min(times, default=None))
        self._save(s)
        if out:
            yield self._frame(out)

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.fold.columns, dtype=object)

    def close(self) -> None:
        pass


def watermarked(stream: DataFrame, ts: str, delay: str, end=None) -> DataFrame:
    """``stream`` with its watermark.  Rows from the time ``end`` on count for it and then leave: a filter on the event
    time is not moved before the watermark."""
    d = stream.withWatermark(ts, delay)
    return d if end is None else d.where(F.col(ts) < F.lit(end))


def ordered_fold(stream: DataFrame, key: str, fold: Fold, schema, idle_us: int, bucket_us: int = BUCKET_US,
                 shards: int = SHARDS) -> DataFrame:
    """``stream``: watermarked on a timestamp column, with ``key`` and the fold's fields (``ts_us`` its event time).
    The number of ``shards`` belongs to the checkpoint: it stays as it is for the life of the query."""
    row = F.to_json(F.struct(F.col(key).alias("__key"), *fold.fields), {"ignoreNullFields": "false"})  # one line
    d = stream.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"),
                      F.floor(F.col(fold.fields[0]) / F.lit(bucket_us)).alias("bucket"), row.alias("row"))
    return d.groupBy("shard").transformWithStateInPandas(OrderedProcessor(fold, idle_us, bucket_us), schema, "Append",
                                                         "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep their state in RocksDB, in ``partitions`` parts (as many as there are shuffle
    partitions without it); both settings are put back."""
    names = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    if partitions:
        names["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
