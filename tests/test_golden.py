"""Golden micro-inputs (FIXTURES.md §3): values worked by hand from the reference formulas,
including exact ports of the reference's rubric unit checks."""

import pytest
from pyspark.sql import functions as F

from dataclinic.operators import examples as EX
from dataclinic.operators import profile as P
from dataclinic.operators import quality as Q
from dataclinic.operators import recommend as RC
from dataclinic.operators import runlogs as RL
from dataclinic.operators import score as SC
from dataclinic.functions.expr import clip, round_to


def test_stats_skew_median_p5(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3, 10])], "k int, x double")
    r = P.column_stats(df, label="none", keys=["k"]).first()
    assert r["median"] == 2.0
    assert abs(r["skew"] - 2.028699) < 1e-6
    p5 = df.agg(F.percentile("x", 0.05)).first()[0]
    assert abs(p5 - 1.2) < 1e-12


def _micro(spark, n_missing=0, n_dups=0):
    rows = [(float(i) if i >= n_missing else None, i % 2) for i in range(10)]
    rows += rows[:n_dups]
    return spark.createDataFrame(rows, "feature_0 double, target int")


def test_quality_clean_is_one(spark):
    d = _micro(spark)
    assert Q.score(d, d, 10).first()["quality"] == 1.0


def test_quality_missing_case(spark):
    rows = [(None, 0)] * 8 + [(1.0, 1), (2.0, 0)]
    d = spark.createDataFrame(rows, "feature_0 double, target int")
    q = Q.score(d, d, 10, initial_missing=8).first()["quality"]
    assert q == pytest.approx(0.40)


def test_fill_missing_advice(spark):
    rows = [(None if i < 20 else float(i), i % 2) for i in range(100)]
    d = spark.createDataFrame(rows, "x double, target int")
    r = RC.fill_missing(P.column_stats(d)).first()
    assert (r["confidence"], r["estimated_impact"], r["risk"]) == (0.82, 0.09, "HIGH")


def test_dedupe_advice(spark):
    rows = [(float(i), i % 2) for i in range(100)] + [(0.0, 0)] * 5
    r = RC.dedupe(spark.createDataFrame(rows, "x double, target int")).first()
    assert (r["estimated_impact"], r["confidence"]) == (0.027, 0.92)


def _classes(spark):
    rows = [(float(i), 0) for i in range(100)] + [(float(i), 1) for i in range(20)]
    return spark.createDataFrame(rows, "x double, target int")


def test_augment_advice(spark):
    r = RC.augment(_classes(spark)).collect()
    assert len(r) == 1
    assert (r[0]["cls"], r[0]["n_synth"], r[0]["estimated_impact"], r[0]["risk"]) == ("1", 40, 0.10, "MEDIUM")


def test_balance_advice(spark):
    r = {x["action_type"]: x for x in RC.balance(_classes(spark)).collect()}
    assert (r["oversample"]["target_count"], r["oversample"]["estimated_impact"]) == (100, 0.12)
    assert (r["undersample"]["target_count"], r["undersample"]["estimated_impact"]) == (40, 0.08)


def _traj(spark, rows):
    cols = ("episode_id long, step long, action string, accuracy double, prev_accuracy double, baseline double, "
            "target double, budget_used long, budget_total long, budget_remaining long, rows long, original_rows long, "
            "quality_before double, quality_after double, prev1 string, prev2 string, prev3 string, prev4 string, "
            "prev5 string, validates_before long, applies_before long")
    from dataclinic.operators import traj
    return traj.parse(spark.createDataFrame(rows, cols))


def _row(action, acc=0.7, prev=0.7, base=0.62, target=0.80, used=1, total=30, rows=100, q0=0.5, q1=0.5,
         hist=(), vb=0, ab=0):
    h = list(reversed(hist))[:5] + [None] * (5 - min(len(hist), 5))
    return (1, 1, action, acc, prev, base, target, used, total, total - used, rows, 100, q0, q1, *h, vb, ab)


def test_accuracy_rubric(spark):
    d = _traj(spark, [_row("submit", acc=0.80, prev=0.75, used=1, total=30),
                      _row("submit", acc=0.71, prev=0.70)])
    got = [r[0] for r in d.select(SC.accuracy_rubric()).collect()]
    assert got == [pytest.approx(0.765), pytest.approx(-0.175)]


@pytest.mark.parametrize("hist,action,expected", [
    (["inspect_dataset"], "query_cleaner", 0.02),
    (["inspect_dataset", "inspect_model"], "apply 1", -0.08),
    (["inspect_dataset", "query_cleaner", "apply 1"], "submit", -0.15),
    (["validate", "query_cleaner", "apply 1"], "validate", 0.10),
])
def test_process_rubric(spark, hist, action, expected):
    cmds = [h.split()[0] for h in hist]
    d = _traj(spark, [_row(action, hist=cmds, vb=cmds.count("validate"), ab=cmds.count("apply"))])
    assert d.select(SC.process_rubric()).first()[0] == pytest.approx(expected)


def test_preservation_rubric(spark):
    d = _traj(spark, [_row("inspect_dataset", rows=r) for r in (97, 85, 80, 60, 40)])
    got = [r[0] for r in d.select(SC.preservation_rubric()).collect()]
    assert got == [0.05, 0.02, -0.05, -0.20, -0.50]


def test_step_rubric(spark):
    d = _traj(spark, [_row("apply 1", q0=0.5, q1=0.7, rows=97), _row("apply 1", q0=0.7, q1=0.4, rows=97),
                      _row("apply 1", q0=0.5, q1=0.6, rows=75)])
    got = [r[0] for r in d.select(SC.step_rubric()).collect()]
    assert got == [pytest.approx(0.12), pytest.approx(-0.16), pytest.approx(-0.03)]


def test_total_clamp(spark):
    d = spark.createDataFrame([(10.0, 5.0, 5.0), (-10.0, -5.0, -5.0)], "a double, b double, c double")
    got = [r[0] for r in d.select(SC.total(["a", "b", "c"])).collect()]
    assert got == [1.0, -1.0]


def test_adaptive_window(spark):
    rows = [(run, i) for run, n in ((1, 12), (2, 30), (3, 100)) for i in range(1, n + 1)]
    d = spark.createDataFrame(rows, "run_id long, episode long")
    got = {r["run_id"]: r["window"] for r in RL.adaptive_window(d, 20).collect()}
    assert got == {1: 4, 2: 10, 3: 20}


def test_example_expansion_count(spark):
    seeds = spark.range(15).select(F.col("id").alias("seed"))
    assert EX.expand(spark, seeds).count() == 9480


def test_round_to_matches_python_on_ties(spark):
    vals = [0.60025, 0.06074999999999997, 2.675, 0.0025, -0.79325]
    d = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in d.select(round_to("x", 4)).collect()]
    assert got == [round(v, 4) for v in vals]


def test_clip(spark):
    d = spark.createDataFrame([(-2.0,), (0.5,), (3.0,)], "x double")
    assert [r[0] for r in d.select(clip("x", -1.0, 1.0)).collect()] == [-1.0, 0.5, 1.0]


def test_evaluate_early_exit_on_tiny_truth(spark):
    from dataclinic.operators import evaluate as EV
    d = spark.createDataFrame([(i, float(i), i % 2) for i in range(6)], "k long, x double, target int")
    pred, model, feats = EV.run(d, d, "target", ["k"])
    assert pred.count() == 0 and model is None and feats == ["x"]


def test_evaluate_with_string_labels(spark, sf):
    from dataclinic.operators import evaluate as EV
    from dataclinic.operators import repair as RP
    from dataclinic.sources import tables as TB
    d = TB.orders_dirty(spark, sf)
    pred, model, feats = EV.run(RP.fix_types(RP.fill_missing(d, "o_custkey"), "o_totalprice"),
                                TB.orders_clean(spark, sf), "o_orderstatus", ["o_orderkey"])
    acc = EV.accuracy(pred, "rf_pred").first()["accuracy"]
    assert model is not None and 0.0 <= acc <= 1.0 and pred.count() > 0
    assert {r[0] for r in pred.select("label").distinct().collect()} <= {0.0, 1.0, 2.0}
