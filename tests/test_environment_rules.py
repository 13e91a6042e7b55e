"""Ports of the reference's environment invariants onto our batch operators."""

from pyspark.sql import functions as F

from dataclinic.operators import audit as AU
from dataclinic.operators import repair as RP
from dataclinic.operators import score as SC
from dataclinic.operators.versions import VersionedTable
from dataclinic.session import ensure_checkpoint_dir
from dataclinic.sources import logs as LG


def _episode(spark, actions):
    rows = [(1, i + 1, a, 0.7, 0.62, 0.79, 0.5, 0.5, 200, 200, 25, 4) for i, a in enumerate(actions)]
    df = spark.createDataFrame(rows, "episode_id long, step long, action string, accuracy double, baseline double, "
                                     "target double, quality_before double, quality_after double, rows long, "
                                     "original_rows long, budget_total int, n_recs long")
    return SC.enrich(df).orderBy("step")


def test_analyst_and_validator_cost_two(spark):
    e = _episode(spark, ["query_analyst", "inspect_dataset", "query_validator", "submit"]).collect()
    assert [r["budget_used"] for r in e] == [2, 3, 5, 6]


def test_validate_cooldown_and_cache(spark):
    acts = ["validate", "validate", "inspect_dataset", "inspect_dataset", "validate", "apply 1", "inspect_dataset",
            "validate"]
    c = AU.cooldown(_episode(spark, acts)).orderBy("step").collect()
    v = [(r["validate_allowed"], r["validate_counted"], r["validate_bonus"]) for r in c if r["cmd"] == "validate"]
    # 1st counted; 2nd blocked (cooldown); 3rd allowed but cached (no change since); 4th counted after an apply
    assert v == [(True, True, 0.02), (False, False, 0.0), (True, False, 0.0), (True, True, 0.02)]


def test_undo_keeps_three_snapshots(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, x double")
    vt = VersionedTable(d, checkpoint_every=0)
    for _ in range(4):
        vt.apply(RP.trim_low, "x", 10)
    assert vt.snapshots == 3
    assert [vt.undo() for _ in range(4)] == [True, True, True, False]
    assert vt.current.count() == 9  # back to the state after the first apply


def test_streaming_append_sink(spark):
    import uuid
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex[:8]}"
    src = f"{base}/src"
    spark.createDataFrame([(1, 1, 0.123456, 0.05), (1, 2, -0.5, 0.0)],
                          "run_id long, episode long, reward double, accuracy_gain double").write.mode("overwrite").parquet(src)
    sdf = spark.readStream.schema("run_id long, episode long, reward double, accuracy_gain double").parquet(src)
    q = LG.append_stream(sdf, f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    back = spark.read.schema("run_id long, episode long, reward double").json(f"{base}/out")
    assert sorted(r["reward"] for r in back.collect()) == [-0.5, 0.1235]
