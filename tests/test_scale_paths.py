"""The hot-key-safe primitives must equal the plain (one-task-per-group) forms exactly.
Tiny chunk / bucket sizes force every multi-chunk code path on small data."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dataclinic.functions.ranking import bucketed_rank, draw_with_replacement, hash_hex, lazy_range
from dataclinic.functions.sequence import fsm_scan, halo_window, ordered_rank, running_sum
from dataclinic.operators import audit as AU
from dataclinic.operators import curriculum as CU
from dataclinic.operators import score as SC
from dataclinic.sources import trajectories as TJ


def _seq(spark, n_keys=3, n=40, seed=1):
    rnd = random.Random(seed)
    rows = [(k if k != 0 else 0, i, rnd.randint(0, 3), rnd.random()) for k in range(n_keys) for i in range(n + 10 * k)]
    rows[5] = (0, 5, 1, 0.5)
    return spark.createDataFrame(rows, "k long, t long, code int, v double")


def test_bucketed_rank_equals_row_number(spark):
    d = _seq(spark).withColumn("h", hash_hex(7, "k", "t"))
    a = bucketed_rank(d, "h", ["k"], ["t"], "r", digits=1)
    b = d.withColumn("r2", F.row_number().over(Window.partitionBy("k").orderBy("h", "t")))
    j = a.join(b.select("k", "t", "r2"), ["k", "t"])
    assert j.where("r != r2").count() == 0 and j.count() == d.count()


def test_ordered_rank_equals_row_number(spark):
    d = _seq(spark)
    a = ordered_rank(d, ["k"], ["t"], F.floor(F.col("t") / 7), "pos")
    assert a.where(F.col("pos") != F.col("t") + 1).count() == 0


def test_ordered_rank_of_wide_order_values(spark):
    # nearly every row its own bucket, over the whole range of 64-bit values, with null, negative and equal ones
    rnd = random.Random(8)
    rows = [(rnd.choice([0, 0, None]), rnd.randrange(-2 ** 63, 2 ** 63) >> rnd.choice([0, 12, 30, 46, 60]), i) for i in range(600)]
    rows += [(0, None, 600 + i) for i in range(5)] + [(1, -5, 700), (1, -5, 701)]
    d = spark.createDataFrame(rows, "k long, t long, i long")
    a = ordered_rank(d, ["k"], ["t", "i"], F.floor(F.col("t") / F.lit(65536)), "pos")
    got = {r["i"]: r["pos"] for r in a.collect()}
    plain = d.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")))
    assert got == {r["i"]: r["pos"] for r in plain.collect()} and len(got) == len(rows)


def test_bucket_offsets_in_levels(spark):
    from dataclinic.functions.sequence import _offsets
    rows = [("a", b, b % 3 + 1) for b in (-2 ** 47, -70000, -1, 0, 1, 65535, 65536, 2 ** 32, 2 ** 32 + 1, 2 ** 47 - 1)]
    rows += [("b", 7, 4), (None, 9, 2), (None, None, 1)]
    got = {(r[0], r[1]): r[2] for r in _offsets(spark.createDataFrame(rows, "k string, b long, __on long"), ["k"], "b").collect()}
    want = {}
    for k, b, _ in rows:
        want[k, b] = sum(n for q, c, n in rows if q == k and (-2 ** 60 if c is None else c) < (-2 ** 60 if b is None else b))
    assert got == want


def test_halo_lags_equal_plain(spark):
    d = _seq(spark).withColumn("pos", F.col("t") + 1)

    def build(x, w):
        return x.withColumns({"l1": F.lag("code", 1).over(w), "l3": F.lag("code", 3).over(w),
                              "m": F.avg("v").over(w.rowsBetween(-3, 0))})

    a = halo_window(d, ["k"], "pos", 3, build, chunk=5)
    w = Window.partitionBy("k").orderBy("pos")
    b = d.withColumns({"p1": F.lag("code", 1).over(w), "p3": F.lag("code", 3).over(w),
                       "pm": F.avg("v").over(w.rowsBetween(-3, 0))})
    j = a.join(b.select("k", "pos", "p1", "p3", "pm"), ["k", "pos"])
    assert j.count() == d.count()
    bad = j.where(~F.col("l1").eqNullSafe(F.col("p1")) | ~F.col("l3").eqNullSafe(F.col("p3"))
                  | (F.abs(F.col("m") - F.col("pm")) > 1e-12))
    assert bad.count() == 0


def test_running_sum_equals_plain(spark):
    d = _seq(spark).withColumn("pos", F.col("t") + 1)
    a = running_sum(d, ["k"], "pos", {"s": F.col("code").cast("long")}, chunk=6, inclusive=False)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    b = d.withColumn("plain", F.coalesce(F.sum("code").over(w), F.lit(0)))
    assert a.join(b.select("k", "pos", "plain"), ["k", "pos"]).where("s != plain").count() == 0


def test_fsm_scan_equals_python_fold(spark):
    d = _seq(spark).withColumn("pos", F.col("t") + 1)
    a = fsm_scan(d, ["k"], "pos", F.col("code"), AU.COOLDOWN_TABLE, 0, chunk=4, state_col="st")
    got = {(r["k"], r["pos"]): r["st"] for r in a.collect()}
    for k in {kk for kk, _ in got}:
        s = 0
        for r in sorted((x for x in d.collect() if x["k"] == k), key=lambda x: x["pos"]):
            assert got[(k, r["pos"])] == s
            s = AU.COOLDOWN_TABLE[r["code"]][s]


def test_draws_exact_count_and_pool_membership(spark):
    pool = spark.range(3).select(F.col("id").alias("x")).withColumn("h", hash_hex(1, "x"))
    pool = bucketed_rank(pool, "h", rank_col="_rank").drop("h")
    counts = spark.createDataFrame([(3, 1000)], "__n long, k long")
    draws = lazy_range(counts, "k", block=64)
    out = draw_with_replacement(pool, draws, 42, "t")
    assert out.count() == 1000
    assert {r[0] for r in out.select("x").distinct().collect()} <= {0, 1, 2}


def test_enrich_chunked_equals_single_chunk(spark, sf):
    a = TJ.actions(spark, sf)
    cols = ["episode_id", "step", "prev1", "prev5", "prev_accuracy", "validates_before", "budget_used", "session_id"]
    x = SC.enrich(a, chunk=7).select(*cols)
    y = SC.enrich(a).select(*cols)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def _deque_replay(successes, window, thr, start=1, max_level=3):
    level, dq, out = start, [], []
    for s in successes:
        dq = (dq + [s])[-window:]
        adv = len(dq) >= window and sum(dq) / len(dq) >= thr and level < max_level
        if adv:
            level, dq = level + 1, []
        out.append((level, adv))
    return out


def test_curriculum_passes_equal_deque_fold(spark):
    rnd = random.Random(3)
    rows = []
    for run in range(6):
        p = 0.5 + 0.08 * run
        rows += [(run, e + 1, rnd.random() < p) for e in range(120)]
    d = spark.createDataFrame(rows, "run_id long, episode long, success boolean")
    got = {(r["run_id"], r["episode"]): (r["level"], r["advanced"])
           for r in CU.replay(d, window=10, threshold=0.7, chunk=16).collect()}
    for run in range(6):
        seq = [s for (r, _, s) in rows if r == run]
        exp = _deque_replay([int(s) for s in seq], 10, 0.7)
        assert [got[(run, e + 1)] for e in range(120)] == exp


def test_curriculum_of_many_levels(spark):
    rnd = random.Random(5)
    rows = [(run, e + 1, rnd.random() < 0.75) for run in range(3) for e in range(900 if run else 2600)]
    rows += [(7, 1, True), (8, 1, False)]
    d = spark.createDataFrame(rows, "run_id long, episode long, success boolean")
    for levels in (1, 2, 4, 201):
        out = CU.replay(d, window=4, threshold=0.7, max_level=levels, chunk=64)
        got = {(r["run_id"], r["episode"]): (r["level"], r["advanced"]) for r in out.collect()}
        for run in {r for r, _, _ in rows}:
            exp = _deque_replay([int(s) for r, _, s in rows if r == run], 4, 0.7, 1, levels)
            assert [got[(run, e + 1)] for e in range(len(exp))] == exp
        assert max(x for x, _ in got.values()) > min(levels - 1, 100)
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 40_000  # whatever the number of levels


def test_state_scan_stays_in_the_jvm_and_keeps_columns(spark):
    rnd = random.Random(9)
    rows = [(k, p, rnd.randint(0, 3), {"a": str(p)}) for k, n in ((None, 300), (1, 64), (2, 1), (3, 17)) for p in range(1, n + 1)]
    d = spark.createDataFrame(rows, "k long, pos long, code int, m map<string,string>")
    for chunk in (2, 4, 16, 1024):  # runs of chunks, full and not
        a = fsm_scan(d, ["k"], "pos", F.col("code"), AU.COOLDOWN_TABLE, 0, chunk=chunk, state_col="st")
        plan = a._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        got = {(r["k"], r["pos"]): (r["st"], r["m"]["a"]) for r in a.collect()}
        assert len(got) == len(rows)
        for k in (None, 1, 2, 3):
            s = 0
            for _, p, c, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                assert got[k, p] == (s, str(p)), (chunk, k, p)
                s = AU.COOLDOWN_TABLE[c][s]


def test_banded_exact_quantile_equals_percentile(spark):
    from dataclinic.functions.quantiles import exact_quantiles
    rnd = random.Random(11)
    for n in (1, 2, 5, 37, 1000, 20000):
        vals = [float(rnd.randint(0, 50)) if i % 3 else rnd.gauss(0, 10) for i in range(n)]
        d = spark.createDataFrame([(v,) for v in vals], "x double")
        for q in (0.05, 0.5, 0.95):
            got = exact_quantiles(d, {"v": F.col("x")}, q).first()["v"]
            exp = d.agg(F.percentile("x", q)).first()[0]
            assert abs(got - exp) < 1e-9, (n, q, got, exp)


def test_range_rank_equals_row_number_with_hot_key(spark):
    from dataclinic.functions.sequence import range_rank
    rnd = random.Random(5)
    rows = [(0, rnd.randint(0, 50), i) for i in range(3000)]            # one hot key, many ties on the order column
    rows += [(k, rnd.randint(0, 50), 10000 + k * 10 + j) for k in range(1, 40) for j in range(rnd.randint(1, 9))]
    d = spark.createDataFrame(rows, "k long, ts long, id long")
    a = range_rank(d, ["k"], ["ts", "id"], "pos", num_partitions=7)
    b = d.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    j = a.join(b, ["k", "ts", "id"])
    assert j.count() == d.count() and j.where("pos != rn").count() == 0


def test_select_smallest_equals_row_number(spark):
    from dataclinic.functions.ranking import select_smallest
    rnd = random.Random(9)
    rows = [(i % 3, i // 7, rnd.randint(0, 9)) for i in range(900)]      # duplicate keys -> hash ties
    d = spark.createDataFrame(rows, "g long, key long, v long").withColumn("h", hash_hex(1, "key"))
    for k in (0, 1, 37, 150, 400):
        a = select_smallest(d, "h", F.lit(k), ["g"], ["key", "v"], "sel", digits=1)
        b = d.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "key", "v")))
        assert sorted(a.where("sel").groupBy("g").count().collect()) == sorted(b.where(F.col("rn") <= k).groupBy("g").count().collect())
        x = a.where("sel").select("g", "key", "v")
        y = b.where(F.col("rn") <= k).select("g", "key", "v")
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_quantile_and_profile_on_all_null_column(spark):
    from dataclinic.functions.quantiles import exact_quantiles
    from dataclinic.operators import profile as P
    d = spark.createDataFrame([(i, None) for i in range(5)], "k long, x double")
    assert exact_quantiles(d, {"v": F.col("x")}, 0.5).first()["v"] is None
    r = P.column_stats(d, label="none", keys=["k"]).first()
    assert (r["n"], r["median"], r["mean"], r["std"], r["n_missing"]) == (0, 0.0, 0.0, 0.0, 5)


def test_positions_with_null_keys_large_integers_and_no_exchange_reuse(spark):
    from dataclinic.functions.sequence import fsm_scan, range_rank
    rnd = random.Random(6)
    big = 2 ** 53 + 1
    rows = [(None if i % 5 == 0 else big + i % 3, rnd.randint(0, 20), i, None if i % 7 == 0 else big) for i in range(2000)]
    d = spark.createDataFrame(rows, "k long, ts long, id long, v long")
    want = d.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    for reuse, aqe in (("true", "true"), ("false", "true"), ("false", "false")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        try:
            got = range_rank(d, ["k"], ["ts", "id"], "rn", num_partitions=5)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
            table = [[0, 1], [1, 0]]
            f = fsm_scan(got, ["k"], "rn", F.col("id") % 2, table, 0, 64, "s")
            assert f.count() == 2000 and f.where("v is not null").select("v").distinct().collect()[0][0] == big
        finally:
            spark.conf.set("spark.sql.exchange.reuse", "true")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_draws_reach_beyond_32_bits(spark):
    from dataclinic.functions.ranking import hash_int
    top = spark.range(200).select(F.max(hash_int(hash_hex(1, "id")))).first()[0]
    assert 2 ** 56 < top < 2 ** 60


def test_quantile_of_few_distinct_values_collects_no_array(spark):
    from dataclinic.functions.quantiles import exact_quantiles
    d = spark.range(60_000).select((F.col("id") % 11).cast("double").alias("x"))
    q = exact_quantiles(d, {"v": F.col("x")}, 0.5, accuracy=100)
    assert q.first()["v"] == 5.0
    assert "collect_list" not in q._jdf.queryExecution().toString()


def test_smallest_keys_equal_row_number(spark):
    from dataclinic.functions.ranking import smallest_keys
    rnd = random.Random(8)
    d = spark.createDataFrame([(i // 2, rnd.choice([None, 1, 2])) for i in range(500)], "key long, v long")
    key = F.struct(hash_hex(3, "key").alias("h"), F.col("v").isNull().alias("n"), F.col("v").alias("v"))
    for k in (0, 1, 37, 499, 500, 9000):
        t = smallest_keys(d, [key], lambda n: F.lit(k), digits=1)
        got = d.crossJoin(t).where(F.coalesce(key <= F.col("__t0"), F.lit(False)))
        # rows equal in hash and value are one key: all of them are at or below it
        want = d.withColumn("rk", F.rank().over(Window.orderBy(key))).where(F.col("rk") <= k)
        assert got.count() == want.count(), k


def test_run_curves_with_gaps_and_zero_based_episodes(spark):
    from dataclinic.operators import runlogs as RL
    eps = [0, 1, 2, 4, 5, 9, 10, 11, 12, 13]
    d = spark.createDataFrame([(1, e, 1.0 + i, 0) for i, e in enumerate(eps)], "run_id long, episode long, reward double, level int")
    vals = [1.0 + i for i in range(len(eps))]
    got = {r["episode"]: r["reward_rolling"] for r in RL.adaptive_rolling(d, "reward", 50).collect()}
    fixed = {r["episode"]: r["reward_rolling"] for r in RL.rolling(d, "reward", 3, chunk=4).collect()}
    for i, e in enumerate(eps):
        last = vals[max(0, i - 2):i + 1]
        assert abs(got[e] - sum(last) / len(last)) < 1e-9 and abs(fixed[e] - sum(last) / len(last)) < 1e-9


def test_missing_nan_wide_ids_and_empty_offers(spark):
    from dataclinic.functions.expr import parse_command
    from dataclinic.operators import audit as AU
    from dataclinic.operators import profile as P
    from dataclinic.operators import repair as RP
    from dataclinic.operators import validate as V
    d = spark.createDataFrame([(1, float("nan"), 0), (2, None, 0), (3, 1.0, 1)], "k long, x double, target int")
    assert P.total_missing(d).first()[0] == 2
    assert P.missing(d, keys=["k"]).first()["n_missing"] == 2
    assert V.dtype_rule(d, keys=["k"]).count() == 0
    cmd, arg = parse_command("a")
    got = spark.createDataFrame([("apply 1234567890",), ("apply 99999999999999999999",), ("apply x",)], "a string").select(arg)
    assert [r[0] for r in got.collect()] == [1234567890, -1, -1]
    e = spark.createDataFrame([(1, 1, "query_cleaner", 0), (1, 1, "query_balancer", 2)], "episode_id long, session_id long, cmd string, n_recs long")
    assert sorted(r["rec_id"] for r in AU.recommendations(e).collect()) == [1, 2]
    ints = spark.createDataFrame([(i, 20 + i, 0) for i in range(10)], "k long, x int, target int")
    out = RP.augment_class(ints, "target", 0, 5, keys=["k"]).where("x <> floor(x)")
    assert dict(out.dtypes)["x"] == "double" and out.count() > 0


def test_draws_as_counts(spark):
    from dataclinic.functions.ranking import draw_counts, unfold
    from dataclinic.operators import repair as RP
    three = spark.createDataFrame([(i, "x") for i in range(3)], "id int, v string")
    got = {r["id"]: r["__draws"] for r in draw_counts(three, 300_000, 42, ["id"]).collect()}
    assert sum(got.values()) == 300_000 and all(abs(n - 100_000) < 1500 for n in got.values())
    assert unfold(draw_counts(three, 1000, 1, ["id"]), "__draws", block=7).count() == 1000
    many = spark.range(5000).select("id", (F.col("id") % 10).alias("g"))
    for k in (0, 1, 4999, 20_000):
        out = draw_counts(many, k, 7, ["id"], digits=2)
        assert (out.agg(F.sum("__draws")).first()[0] or 0) == k
    per = [r["n"] for r in draw_counts(many, 20_000, 7, ["id"], digits=2).groupBy("g").agg(F.sum("__draws").alias("n")).collect()]
    assert len(per) == 10 and sum((n - 2000) ** 2 / 2000 for n in per) < 28  # chi-square, 9 degrees, p = 0.001
    var = many.join(draw_counts(many, 20_000, 7, ["id"]), "id", "left").agg(F.var_samp(F.coalesce("__draws", F.lit(0)))).first()[0]
    assert 3.6 < var < 4.4  # Poisson-like with mean 4
    again = draw_counts(many.repartition(7), 20_000, 7, ["id"], digits=2)
    a, b = draw_counts(many, 20_000, 7, ["id"], digits=2).select("id", "__draws"), again.select("id", "__draws")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    copies = spark.createDataFrame([(1, 2.0, 0)] * 5 + [(2, 3.0, 1)] * 9 + [(None, None, 0)], "k int, x double, target int")
    out = RP.oversample(copies, "target", 0, 40, keys=["k"], mode="split")
    assert out.where("target = 0").count() == 40 and out.where("target = 1").count() == 9


def test_recipe_orders_only_rows_near_its_thresholds(spark, monkeypatch):
    """The stored recipe picks the rows of the plain one and hands few of them on to be ordered; keys that repeat so
    often that no bracket fits are counted whole."""
    from dataclinic.operators import inject
    steps = [("missing", dict(cols=["a", "b"], frac=0.1)), ("outliers", dict(col="a", frac=0.03)),
             ("cross_column", dict(a="a", b="b", frac=0.02))]
    ordered = []

    def seen(df, keys, *rest):
        ordered.append(df.count())
        return smallest(df, keys, *rest)
    smallest = inject.smallest_keys
    key = F.when(F.col("id") % 1000 != 7, F.col("id"))  # some without a key
    many = spark.range(100_000).select(key.alias("k"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    for d, few in ((many, True), (many.withColumn("k", F.lit(1)), False)):
        plain = inject.recipe(d, steps, keys=["k"], checkpoint=False)
        with monkeypatch.context() as m:
            m.setattr(inject, "smallest_keys", seen)
            got = inject.recipe(d, steps, keys=["k"])
        assert (ordered.pop() < 20_000) == few and not ordered
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
