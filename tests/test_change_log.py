"""Versions as a change log, and counts kept from the changed rows."""

import os

from pyspark.sql import functions as F

from dataclinic.operators import quality as Q
from dataclinic.operators import repair as RP
from dataclinic.operators.profile import duplicates
from dataclinic.operators.versions import ChangeLog

SCHEMA = "k bigint, x double, y string, target int"


def table(spark):
    rows = [(i % 40, None if i % 7 == 0 else float(i % 11), "ERR" if i % 9 == 0 else str(i % 5), i % 2) for i in range(200)]
    rows += [(1, float("nan"), None, 0)] * 3 + [(1, None, None, 0)] * 2 + [(None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def clean(df):
    return df.withColumn("x", F.nanvl("x", F.lit(None)))


def test_apply_undo_and_a_new_session(spark, tmp_path):
    d, path = table(spark), f"{tmp_path}/t"
    log = ChangeLog.create(d, path)
    states = [rows(clean(d))]
    assert rows(log.read()) == states[0]
    steps = [(RP.dedupe,), (RP.fill_missing, "x", "mean"), (lambda t: t.where("k <> 3"),), (lambda t: t.unionByName(t.where("k = 5")),),
             (lambda t: t,)]
    for fn, *args in steps:
        want = fn(log.read(), *args)
        states.append(rows(want))
        log.apply(fn, *args)
        assert rows(log.read()) == states[-1] == rows(ChangeLog.open(spark.newSession(), path).read())
    assert log.changes().count() == 0 and log.snapshots == 3  # the last apply changed nothing
    again = ChangeLog.open(spark.newSession(), path)
    for back in (4, 3, 2):
        assert again.undo() and rows(again.read()) == states[back]
    assert not again.undo()
    again.apply(RP.fix_types, "y")  # text becomes numbers: a base of its own
    assert dict(again.read().dtypes)["y"] == "double" and again.changes() is None
    assert again.undo() and rows(again.read()) == states[2]
    again.compact()
    assert rows(ChangeLog.open(spark, path).read()) == states[2]


def test_storage_follows_the_change(spark, tmp_path):
    d = spark.range(20_000).select("id", (F.col("id") * 7 % 1000).cast("double").alias("x"), F.md5(F.col("id").cast("string")).alias("s"))
    log = ChangeLog.create(d, f"{tmp_path}/t")
    base = size(f"{tmp_path}/t")
    log.apply(lambda t: t.withColumn("x", F.when(F.col("id") < 20, F.lit(-1.0)).otherwise(F.col("x"))))
    assert log.changes().count() == 40 and size(f"{tmp_path}/t") - base < base / 10
    assert log.read().where("x = -1").count() == 20 and log.read().count() == 20_000


def test_two_writers_do_not_both_win(spark, tmp_path):
    import pytest
    log = ChangeLog.create(table(spark), f"{tmp_path}/t")
    a, b = ChangeLog.open(spark, log.path), ChangeLog.open(spark, log.path)
    a.apply(RP.dedupe)
    with pytest.raises(Exception, match="(?i)exist"):
        b.apply(lambda t: t.limit(1))


def test_many_copies_of_a_row(spark, tmp_path, monkeypatch):
    from dataclinic.operators import versions
    monkeypatch.setattr(versions, "COPIES", 7)
    log = ChangeLog.create(spark.createDataFrame([(1, "a")] * 60 + [(2, "b")], "k int, v string"), f"{tmp_path}/t")
    log.apply(lambda t: t.unionByName(t.where("k = 1").limit(4)))
    assert {r["k"]: r["count"] for r in log.read().groupBy("k").count().collect()} == {1: 64, 2: 1}


def test_counts_kept_under_repairs_equal_a_recount(spark, tmp_path):
    log = ChangeLog.create(table(spark), f"{tmp_path}/t")
    cols = ["x", "y"]
    counts = Q.kept_counts(log.read(), cols)
    first = counts.first()
    steps = [(RP.fill_missing, "x", "median"), (RP.dedupe,), (lambda t: t.withColumn("y", F.when(F.col("y") != "ERR", F.col("y"))),),
             (lambda t: t.where("k is not null"),), (lambda t: t.limit(0),)]
    for fn, *args in steps:
        log.apply(fn, *args)
        counts = Q.updated_counts(counts, log.changes(), cols)
        assert counts.first() == Q.kept_counts(log.read(), cols).first()
        now = log.read()
        assert counts.first()["n_duplicates"] == duplicates(now).first()["n_duplicates"]
        a = Q.score_counts(counts, cols, 2, first["n_rows"], first["n_missing"]).first()["quality"]
        b = Q.components(now, spark.createDataFrame([(1,)] * 3, "z int"), first["n_rows"], "target", ["k"], None,
                         first["n_missing"]).first()["quality"]
        assert a == b
