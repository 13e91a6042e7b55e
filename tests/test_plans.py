"""Plan checks: built-in expressions only on the hot paths, column pruning and
pushed filters at the scan, no unbounded single-partition windows."""

from pyspark.sql import functions as F

from dataclinic.operators import profile as P
from dataclinic.operators import repair as RP
from dataclinic.sources import tables as TB


PYTHON = ("EvalPython", "InPandas", "InArrow", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_is_one_jvm_pass(spark, sf):
    p = _plan(P.column_stats(TB.lineitem_clean(spark, sf), "l_returnflag", TB.LINEITEM["keys"]))
    assert not any(n in p for n in PYTHON)


def test_audits_and_curriculum_stay_in_the_jvm(spark, sf):
    from dataclinic.operators import audit as AU
    from dataclinic.operators import curriculum as CU
    from dataclinic.operators import score as SC
    from dataclinic.sources import trajectories as TJ
    e = SC.enrich(TJ.actions(spark, sf))
    for d in (AU.cooldown(e), AU.report(e, AU.recommendations(e)), CU.replay(TJ.runs(spark, sf), window=5, threshold=0.6)):
        assert not any(n in _plan(d) for n in PYTHON)


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    li = TB.table(spark, sf, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    p = _plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_fill_missing_uses_broadcast_of_one_row(spark, sf):
    d = RP.fill_missing(TB.lineitem_clean(spark, sf), "l_tax", "mean")
    assert "BroadcastNestedLoopJoin" in _plan(d) or "BroadcastExchange" in _plan(d)
