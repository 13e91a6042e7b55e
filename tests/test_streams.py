"""Streaming forms equal their batch forms on the same table."""

import glob
import os

from pyspark.sql import functions as F

from dataclinic.operators import audit as AU
from dataclinic.operators import curriculum as CU
from dataclinic.operators import score as SC
from dataclinic.plans.catalog import load_all
from dataclinic.sources import trajectories as TJ
from dataclinic.streaming.audit_stream import audit_stream
from dataclinic.streaming.curriculum_stream import curriculum_stream
from dataclinic.streaming.ordered import rocksdb_state


def test_audit_stream_equals_batch(spark, sf):
    q, _ = load_all()
    every = q["t1_audit_stream"](spark, sf)
    s = every.where("not forced").select("episode_id", "step", "validate_allowed", "validate_counted",
                                                "budget_used", "exhausted")
    e = SC.enrich(TJ.actions(spark, sf))
    b = AU.cooldown(e).select("episode_id", "step", "validate_allowed", "validate_counted", "budget_used")
    b = b.join(AU.budget(e).select("episode_id", "step", "exhausted"), ["episode_id", "step"])
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0
    sa = every.where("cmd = 'apply'").select("episode_id", "step", "apply_outcome")
    ba = AU.apply_limits(e, AU.recommendations(e)).select("episode_id", "step", F.col("outcome").alias("apply_outcome"))
    assert sa.exceptAll(ba).count() == 0 and ba.exceptAll(sa).count() == 0
    sf_, bf = every.where("forced").select("episode_id", "ts_us", "penalty"), AU.forced_submits(e)
    assert bf.count() > 0 and sf_.exceptAll(bf).count() == 0 and bf.exceptAll(sf_).count() == 0


def _start(spark, d, src, build):
    """One run over what the source folder holds, from the same checkpoint each time."""
    with rocksdb_state(spark, 2):
        q = build(src).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck") \
            .outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(build(src).schema).parquet(f"{d}/out")


def _put(spark, d, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{d}/in")


def test_idle_episode_is_submitted_by_a_timer(spark, tmp_path):
    schema = "episode_id bigint, event_id bigint, ts bigint, action string, n_recs int"
    t0 = 1_700_000_000

    def build(_):
        s = spark.readStream.schema(schema.replace("ts bigint", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return audit_stream(s, 25, "60 seconds")

    _put(spark, tmp_path, [(1, 1, t0, "validate", 0), (2, 2, t0 + 5, "validate", 0), (3, 3, t0 + 9, "submit", 0)], schema)
    _start(spark, tmp_path, None, build)
    # the second batch knows only episode 2; it takes the watermark past the deadlines
    _put(spark, tmp_path, [(2, 4, t0 + 100, "inspect_dataset", 0), (2, 5, t0 + 5000, "validate", 0)], schema)
    _put(spark, tmp_path, [(2, 6, t0 + 5001, "apply 1", 0)], schema)
    got = _start(spark, tmp_path, None, build)
    forced = sorted((r["episode_id"], r["ts_us"] - t0 * 1_000_000, r["penalty"]) for r in got.where("forced").collect())
    assert forced == [(1, 300_000_000, -0.1), (2, 305_000_000, -0.1)]
    order = [(r["event_id"], r["step"]) for r in got.where("not forced").orderBy("episode_id", "step").collect()]
    assert order == [(1, 1), (2, 1), (4, 2), (3, 1)]  # events 5 and 6 wait for the watermark


def test_rows_out_of_order_over_many_batches(spark, tmp_path):
    """Four files, each with rows of all times within the watermark, folded in the order of time."""
    import random
    schema, r = "run_id bigint, event_id bigint, ts bigint, success boolean", random.Random(4)
    rows = [(i % 3, i, 1_700_000_000 + 7 * i, r.random() < 0.7) for i in range(240)]
    late = rows[:]
    r.shuffle(late)

    def build(_):
        s = spark.readStream.schema(schema.replace("ts bigint", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return curriculum_stream(s, 5, 0.6, watermark="1800 seconds")

    for k in range(4):
        _put(spark, tmp_path, late[k * 60:k * 60 + 60], schema)
        _start(spark, tmp_path, None, build)
    for k in range(2):  # rows of a far day end the stream
        _put(spark, tmp_path, [(9, 1000 + k, 1_800_000_000 + 9000 * k, True)], schema)
        got = _start(spark, tmp_path, None, build)
    out = {(x["run_id"], x["episode"]): (x["level"], x["advanced"]) for x in got.where("run_id < 9").collect()}
    for run in range(3):
        level, last = 1, []
        for n, (_, _, _, s) in enumerate([x for x in rows if x[0] == run], 1):
            last = (last + [int(s)])[-5:]
            adv = len(last) >= 5 and sum(last) / 5 >= 0.6 and level < 3
            level, last = (level + 1, []) if adv else (level, last)
            assert out[run, n] == (level, adv)
    assert len(out) == 240


def test_curriculum_stream_equals_batch(spark, sf):
    q, _ = load_all()
    s = q["t2_curriculum_stream"](spark, sf).select("run_id", "episode", "level", "advanced")
    b = CU.replay(TJ.runs(spark, sf), window=5, threshold=0.6).select("run_id", "episode", "level", "advanced")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_quality_monitor_writes_one_row_per_column(spark, sf):
    q, _ = load_all()
    m = q["t3_quality_monitor"](spark, sf)
    assert m.select("col_name").distinct().count() == 4
    assert m.where(F.col("drift").isNull()).count() == 0


def folder_of_files(spark, sf, name, to, order):
    """A table as a folder of four files; the stream meets them from the last key to the first."""
    d = spark.read.parquet(f"{sf}/{name}.parquet")
    d.repartitionByRange(4, F.col(order).desc()).write.parquet(f"{to}/{name}.parquet")
    files = sorted(glob.glob(f"{to}/{name}.parquet/part-*.parquet"))
    assert len(files) == 4
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


def test_streams_read_every_file_of_a_folder(spark, sf, tmp_path):
    q, _ = load_all()
    folder_of_files(spark, sf, "events", tmp_path, "ts")
    test_audit_stream_equals_batch(spark, str(tmp_path))
    test_curriculum_stream_equals_batch(spark, str(tmp_path))


def test_monitor_reads_every_file_of_a_folder(spark, sf, tmp_path):
    q, _ = load_all()
    folder_of_files(spark, sf, "lineitem", tmp_path, "l_orderkey")
    m = q["t3_quality_monitor"](spark, str(tmp_path)).groupBy("col_name").agg(F.sum("n_rows").alias("n"),
                                                                             F.countDistinct("batch_id").alias("b"))
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {(x["n"], x["b"]) for x in m.collect()} == {(n, 4)}


def test_sketches_merge_over_spans(spark):
    import random
    import statistics
    from dataclinic.streaming import monitor as M
    r = random.Random(1)
    data = [[r.gauss(10 + b, 3) if i % 9 else None for i in range(900)] for b in range(5)]
    sk = None
    for b, xs in enumerate(data):
        d = spark.createDataFrame([(x, x if x is None else -x * x) for x in xs], "x double, y double")
        one = M.batch_sketch(d, {"x": 10.0, "y": 0.0}).withColumn("batch_id", F.lit(b).cast("long"))
        sk = one if sk is None else sk.unionByName(one)
    sk = sk.unionByName(M.batch_sketch(spark.createDataFrame([], "x double, y double"), {"x": 10.0, "y": 0.0}).withColumn("batch_id", F.lit(9).cast("long")))
    for first, last in ((0, 4), (1, 3), (2, 2)):
        xs = [x for b in data[first:last + 1] for x in b if x is not None]
        p = {x["col_name"]: x for x in M.span_profile(sk, first, last).collect()}
        g = spark.createDataFrame([(x,) for x in xs], "x double").agg(F.skewness("x")).first()[0]
        n = len(xs)
        assert p["x"]["n"] == n and abs(p["x"]["mean"] - statistics.mean(xs)) < 1e-9 and abs(p["x"]["std"] - statistics.stdev(xs)) < 1e-9
        assert abs(p["x"]["skew"] - g * (n * (n - 1)) ** 0.5 / (n - 2)) < 1e-9
        for c, vs in (("x", xs), ("y", [-x * x for x in xs])):
            rank = sum(v <= p[c]["median"] for v in vs) / n
            assert abs(rank - 0.5) <= M.RANK_ERROR
    t = {(x["batch_id"], x["col_name"]): x for x in M.trailing_drift(sk, 2).collect()}
    assert (0, "x") not in t and t[1, "x"]["n_span"] == 800 and t[4, "x"]["n_span"] == 1600 and (9, "x") not in t
    assert all(0.2 < t[b, "x"]["median_shift"] < 0.7 for b in range(1, 5))


def test_state_calls_grow_with_shards_not_keys():
    """Keys of a shard share its calls to the state store; each key keeps a fold of its own."""
    import json

    import pandas as pd

    from dataclinic.streaming.curriculum_stream import CurriculumFold
    from dataclinic.streaming.ordered import OrderedProcessor

    calls = []

    class Store:
        def __init__(self, *_):
            self.held = {}

        def getValue(self, k=()):
            calls.append("get")
            return self.held.get(k)

        def updateValue(self, k, v):
            calls.append("update")
            self.held[k] = v

        def removeKey(self, k=()):
            calls.append("remove")
            self.held.pop(k, None)

        def update(self, v):
            self.updateValue((), v)

        def registerTimer(self, ms):
            calls.append("timer")

        get, clear, getMapState, getValueState = getValue, removeKey, lambda self, *a: Store(), lambda self, *a: Store()

    class Now:
        def getExpiryTimeInMs(self):
            return 10 ** 10

        getCurrentWatermarkInMs = getExpiryTimeInMs

    bucket = 86_400_000_000
    p = OrderedProcessor(CurriculumFold(5, 0.6, 1, 3), 10 ** 18, bucket)
    p.init(Store())
    rows = [(k, n * bucket, 3 * k + n, True) for k in range(300) for n in (2, 0, 1)]
    pdf = pd.DataFrame({"bucket": [r[1] // bucket for r in rows], "row": [
        json.dumps(dict(zip(("__key", "ts_us", "event_id", "success"), r))) for r in rows]})
    assert list(p.handleInputRows((0,), iter([pdf[:450], pdf[450:]]), Now())) == []
    got = pd.concat(list(p.handleExpiredTimer((0,), Now(), Now())))
    assert sorted(zip(got["run_id"], got["episode"])) == [(k, n) for k in range(300) for n in (1, 2, 3)]
    assert len(calls) < 30  # not several for each of 300 keys
