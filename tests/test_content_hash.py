"""The content hash: NULLs, merging, updates, and where a table was edited."""

import random

from pyspark.sql import functions as F

from dataclinic.operators import evaluate as EV
from dataclinic.operators import integrity as IG
from dataclinic.operators import recommend as RC

SCHEMA = "k bigint, a double, b double, s string"


def fp(df):
    return tuple(IG.fingerprint(df).first())


def test_nulls_have_a_place(spark):
    make = lambda rows: spark.createDataFrame(rows, "a int, b int")
    x, y = make([(1, None), (2, 3)]), make([(None, 1), (2, 3)])
    assert fp(x) != fp(y) and fp(x) == fp(make([(2, 3), (1, None)]))
    assert fp(make([(None, None)])) != fp(make([])) and fp(make([(1, 1), (1, 1)])) != fp(make([]))
    assert not IG.assert_unchanged(y, IG.fingerprint(x)).first()["content_ok"]
    recs = RC.stamp(spark.createDataFrame([(1,)], "rec_id int"), x)
    assert RC.check_fresh(recs, x).first()["fresh"] and not RC.check_fresh(recs, y).first()["fresh"]
    keys = {EV.request_key(t, t, "b", ["a"], **o) for t in (x, y) for o in ({}, {"seed": 1}, {"fast": False}, {"max_depth": 3})}
    assert len(keys | {EV.request_key(x, x, "a", ["a"]), EV.request_key(x, x, "b", []), EV.request_key(x, y, "b", ["a"])}) == 11


def test_tree_is_updated_and_finds_edits(spark):
    r = random.Random(2)
    val = lambda: r.choice([None, r.random()])
    rows = [(i // 2, val(), val(), r.choice("xyz")) for i in range(3000)] + [(None, None, None, None)] * 3
    d = spark.createDataFrame(rows, SCHEMA)
    tree = IG.content_tree(d, ["k"])
    assert tuple(IG.tree_root(tree).first()) == fp(d)
    assert IG.changed_buckets(IG.content_tree(d.repartition(5), ["k"]), tree).count() == 0
    at = sorted(r.sample(range(3000), 25))
    gone, swapped = {*at[:5]}, {i for i in at[5:] if (rows[i][1] is None) != (rows[i][2] is None)}
    edited = [(k, b, a, s) if i in swapped else (k, a, b, s) for i, (k, a, b, s) in enumerate(rows) if i not in gone]
    now = spark.createDataFrame(edited, SCHEMA)
    found = IG.changed_buckets(IG.content_tree(now, ["k"]), tree)
    touched = {rows[i][0] for i in gone | swapped}
    leaf = F.substring(F.md5(F.concat_ws("|", F.lit("bucket"), F.col("k").cast("string"))), 1, IG.LEAF_DIGITS)
    want = {x[0] for x in d.where(F.col("k").isin(list(touched))).select(leaf).collect()}
    assert {x["bucket"] for x in found.collect()} == want
    assert {x["k"] for x in IG.rows_in(d, found, ["k"]).collect()} >= touched
    removed = spark.createDataFrame([rows[i] for i in gone | swapped], SCHEMA)
    added = spark.createDataFrame([(rows[i][0], rows[i][2], rows[i][1], rows[i][3]) for i in swapped], SCHEMA)
    after = IG.update_tree(tree, removed, added, ["k"])
    assert IG.changed_buckets(after, IG.content_tree(now, ["k"])).count() == 0
    assert tuple(IG.tree_root(after).first()) == fp(now)
    nothing = IG.update_tree(tree, d, d.limit(0), ["k"])
    assert nothing.count() == 0 and tuple(IG.tree_root(nothing).first()) == fp(d.limit(0))


def test_injections_in_one_pass_equal_them_in_turn(spark):
    from dataclinic.operators import inject as IN
    d = spark.range(500).select("id", (F.col("id") * 1.5).alias("a"), (F.col("id") % 50).cast("double").alias("b"))
    steps = [("missing", dict(cols=["a", "b"], frac=0.1)), ("outliers", dict(col="b", frac=0.05)),
             ("cross_column", dict(a="a", b="b", frac=0.2)), ("type_errors", dict(col="a", frac=0.03))]
    one, turn = IN.recipe(d, steps, keys=["id"]), d
    for name, kw in steps:
        turn = IN.INJECTORS[name](turn, keys=["id"], **kw)
    assert sorted(map(str, one.collect())) == sorted(map(str, turn.collect()))


def test_dominant_responses(spark):
    from dataclinic.operators import examples as EX
    r = random.Random(3)
    rows = [("big",)] * 400 + [("half",)] * 300 + [(f"r{r.randrange(2000)}",) for _ in range(500)] + [(None,)] * 50
    d = spark.createDataFrame(rows, "response string")
    for pct in (25.0, 20.0, 0.2):
        want = {x: n for x in {y for y, in rows if y} for n in [rows.count((x,))] if n * 100.0 / len(rows) > pct}
        assert {x["response"]: x["count"] for x in EX.dominant_responses(d, min_pct=pct).collect()} == want
    assert EX.dominant_responses(d.limit(0)).count() == 0
