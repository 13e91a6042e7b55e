"""Guards and modes: stale advice, data loss, stored evaluations, replicate and gaussian modes, adjustments."""

import uuid

import pytest
from pyspark.sql import functions as F

from dataclinic.operators import evaluate as EV
from dataclinic.operators import recommend as RC
from dataclinic.operators import repair as RP
from dataclinic.operators import score as SC
from dataclinic.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 7) if i % 9 else None, i * 1.5, i % 2 if i < 80 else 0) for i in range(120)]
    return spark.createDataFrame(rows, "k long, a double, b double, target int")


def test_apply_refuses_stale_sets_and_data_loss(table):
    recs = RC.stamp(RC.clean(table, keys=["k"]), table)
    fill = {"action": "fill_missing", "column": "a"}
    done = RP.apply_checked(table, recs, fill, 120, keys=["k"])
    assert done.where("a is null").count() == 0
    with pytest.raises(ValueError, match="stale"):
        RP.apply_checked(done, recs, fill, 120, keys=["k"])
    with pytest.raises(ValueError, match="under half"):
        RP.apply_checked(table, recs, {"action": "remove_outlier_rows", "column": "b", "pct": 60}, 120, keys=["k"])


def test_replicate_and_gaussian(table):
    n = table.where("target = 1").count()
    more = RP.oversample(table, "target", 1, 2 * n + 7, keys=["k"], mode="replicate").where("target = 1")
    assert more.count() == 2 * n + 7
    assert {r["count"] for r in more.groupBy("k").count().collect()} == {2, 3}
    out = RP.augment_class(table, "target", 1, 200, keys=["k"], features=["b"], mode="gaussian")
    new = out.where("b <> round(b * 2) / 2")
    assert new.count() > 150
    base = table.where("target = 1").agg(F.avg("b"), F.stddev("b")).first()
    got = new.agg(F.avg("b"), F.stddev("b")).first()
    assert abs(got[0] - base[0]) < 0.5 * base[1] and abs(got[1] / base[1] - 1) < 0.3


def test_stored_evaluation_is_fitted_once(spark, table):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evals-{uuid.uuid4().hex[:8]}"
    filled = RP.fill_missing(table, "a", "mean")
    a = EV.cached_accuracy(filled, filled, "rf", path, keys=["k"]).collect()
    b = EV.cached_accuracy(filled, filled, "rf", path, keys=["k"]).collect()
    c = EV.cached_accuracy(filled.where("k > 3"), filled, "rf", path, keys=["k"]).collect()
    assert a == b and a[0]["eval_key"] != c[0]["eval_key"] and 0 <= a[0]["rf_accuracy"] <= 1
    assert spark.read.parquet(path).count() == 2


def test_too_few_training_rows_give_an_empty_result(spark, table):
    pred, model, feats = EV.run(table.withColumn("a", F.lit(None).cast("double")), table.dropna(), keys=["k"])
    assert pred.count() == 0 and model is None and EV.importance(model, feats, spark).count() == 0


def test_adjustments(spark):
    e = spark.createDataFrame([(1, 1, "undo"), (1, 1, "truncated"), (1, 2, "other")], "episode_id long, step long, event string")
    got = {r["step"]: round(r["adjustment"], 6) for r in SC.adjustments(e).collect()}
    assert got == {1: -0.05, 2: 0.0}
