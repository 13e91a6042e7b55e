"""Family E (fixed-model evaluation) queries.  The fits' accuracies have no SQL twin (rows-only); their rows, the
forest's and the importances' invariants, the slope of the loss, preparation, the stratified split, the report and the
agreement labels do."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import deep_forest as DEEP
from ...operators import evaluate as EV
from ...operators import repair as RP
from ...session import cut_lineage, ensure_checkpoint_dir
from ...sources import tables as TB
from . import register
from .common import r6
from .sqlgen import r6 as s6, to_number

FEATS = ["n_chars", "n_words", "n_lines"]
_NC = to_number("n_chars", True)


def _fit(spark, sf):
    return EV.run(RP.dedupe(TB.dq_dirty(spark, sf)), TB.dq_train(spark, sf), "target", ["doc_id"])


@register("e1_evaluate")
def e1_evaluate(spark, sf):
    pred, _, _ = _fit(spark, sf)
    return r6(pred.agg(F.count(F.lit(1)).alias("n_test"),
                       F.avg((F.col("label") == F.col("rf_pred")).cast("double")).alias("rf_accuracy"),
                       F.avg((F.col("label") == F.col("lr_pred")).cast("double")).alias("lr_accuracy")))


@register("e2_prepare", f"""WITH {TB.sql_ctes('dq_dirty')}
SELECT CAST(target AS DOUBLE) AS label, {s6(_NC)} AS n_chars, {s6('n_words')} AS n_words, {s6('n_lines')} AS n_lines,
  doc_id FROM dq_dirty WHERE target IS NOT NULL AND ({_NC}) IS NOT NULL AND n_words IS NOT NULL AND n_lines IS NOT NULL""")
def e2_prepare(spark, sf):
    return r6(EV.prepare(TB.dq_dirty(spark, sf), "target", FEATS))


@register("e3_stratified_split", f"""WITH {TB.sql_ctes('dq_train')},
r AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws('|', '42', 'holdout', doc_id)),
  doc_id) AS rk, count(*) OVER (PARTITION BY target) AS cn FROM dq_train)
SELECT doc_id, target, rk <= round(cn * 0.25) AS is_test FROM r""")
def e3_stratified_split(spark, sf):
    return EV.stratified_split(TB.dq_train(spark, sf), "target", ["doc_id"]).select("doc_id", "target", "is_test")


@register("e4_random_forest")
def e4_random_forest(spark, sf):
    pred, _, _ = _fit(spark, sf)
    return r6(EV.accuracy(pred, "rf_pred"))


@register("e5_logistic_regression")
def e5_logistic_regression(spark, sf):
    pred, _, _ = _fit(spark, sf)
    return r6(EV.accuracy(pred, "lr_pred"))


_RULE = "CASE WHEN n_words > 400 THEN 1.0 ELSE 0.0 END"


@register("e6_report", f"""WITH {TB.sql_ctes('dq_train')},
p AS (SELECT CAST(target AS DOUBLE) AS y, {_RULE} AS p FROM dq_train),
cls AS (SELECT y AS c FROM p UNION SELECT p FROM p),
per AS (SELECT c, (SELECT count(*) FROM p WHERE y = c AND p = c) AS tp, (SELECT count(*) FROM p WHERE y = c) AS support,
  (SELECT count(*) FROM p WHERE p = c) AS npred FROM cls),
m AS (SELECT CAST(c AS VARCHAR) AS cls, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc, support, tp FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m),
t AS (SELECT sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(pr) AS sp, sum(rc) AS sr, sum(f1) AS sf,
  sum(pr * support) AS wp, sum(rc * support) AS wr, sum(f1 * support) AS wf FROM f)
SELECT cls, {s6('pr')} AS precision, {s6('rc')} AS recall, {s6('f1')} AS f1, support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', {s6('tp / n')}, {s6('tp / n')}, {s6('tp / n')}, n::BIGINT FROM t
UNION ALL SELECT 'macro avg', {s6('sp / k')}, {s6('sr / k')}, {s6('sf / k')}, n::BIGINT FROM t
UNION ALL SELECT 'weighted avg', {s6('wp / n')}, {s6('wr / n')}, {s6('wf / n')}, n::BIGINT FROM t""")
def e6_report(spark, sf):
    d = TB.dq_train(spark, sf).select(F.col("target").cast("double").alias("label"),
                                      F.when(F.col("n_words") > 400, 1.0).otherwise(0.0).alias("prediction"))
    return r6(EV.report(d))


@register("e7_importance")
def e7_importance(spark, sf):
    _, rfm, feats = _fit(spark, sf)
    return EV.importance(rfm, feats, spark)


_E8 = ("round(0.4 + value / 500.0, 4)", "round(0.4 + ((event_id * 7) % 100) / 500.0, 4)")


@register("e8_agreement", f"""WITH ev AS (SELECT user_id, event_id, {_E8[0]} AS rf_acc, {_E8[1]} AS lr_acc FROM events),
l AS (SELECT *, coalesce(lag(rf_acc) OVER w, 0.0) AS prf, coalesce(lag(lr_acc) OVER w, 0.0) AS plr FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN rf_acc > prf + 0.005 AND lr_acc > plr + 0.005 THEN 'BOTH_AGREE_IMPROVE'
  WHEN rf_acc > prf + 0.005 AND lr_acc < plr - 0.005 THEN 'DISAGREE'
  WHEN rf_acc < prf - 0.005 AND lr_acc < plr - 0.005 THEN 'BOTH_DECLINED'
  WHEN NOT (rf_acc > prf + 0.005) AND NOT (rf_acc < prf - 0.005) THEN 'NO_CHANGE' ELSE 'MIXED' END AS agreement
FROM l""")
def e8_agreement(spark, sf):
    ev = TB.table(spark, sf, "events").select("user_id", "event_id", F.expr(_E8[0]).alias("rf_acc"),
                                              F.expr(_E8[1]).alias("lr_acc"))
    return EV.agreement(ev, ["user_id"], "event_id").select("user_id", "event_id", "agreement")


@register("e9_eval_cache", "SELECT 'deduped' AS name")
def e9_eval_cache(spark, sf):
    """Requests for the dirty and the deduped table; only the dirty one is cached."""
    d = TB.dq_dirty(spark, sf)
    req = EV.cache_key(d, "rf20").withColumn("name", F.lit("dirty")).unionByName(
        EV.cache_key(RP.dedupe(d), "rf20").withColumn("name", F.lit("deduped")))
    done = EV.cache_key(d, "rf20")
    return EV.pending(req, done).select("name")


@register("e9_result_store", """SELECT * FROM (VALUES ('before', 0, NULL), ('fitted', 1, true), ('again', 1, true),
  ('another seed', 0, NULL), ('other keys', 0, NULL), ('a value moved across a NULL', 0, NULL)) t(request, n_found, same_result)""")
def e9_result_store(spark, sf):
    """One fit, stored and found again; requests that differ in an option or by one moved NULL are not found."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    work, truth = cut_lineage(RP.dedupe(TB.dq_dirty(spark, sf))), TB.dq_train(spark, sf)
    one = F.col("n_words").isNull() != F.col("n_lines").isNull()
    moved = work.select(*[F.when(one, F.col({"n_words": "n_lines", "n_lines": "n_words"}.get(c, c))).otherwise(F.col(c)).alias(c)
                          for c in work.columns])

    def found(w, keys=("doc_id",), **options):
        return EV.stored_accuracy(spark, path, EV.request_key(w, truth, "target", keys, "rf20", **options)).collect()

    before = found(work)
    first = EV.cached_accuracy(work, truth, "rf20", path, "target", ["doc_id"]).first()
    rows = [("before", len(before), None), ("fitted", 1, 0.0 <= first["rf_accuracy"] <= 1.0)]
    again = found(work)
    rows += [("again", len(again), bool(again) and again[0] == first), ("another seed", len(found(work, seed=43)), None),
             ("other keys", len(found(work, keys=())), None), ("a value moved across a NULL", len(found(moved)), None)]
    return spark.createDataFrame(rows, "request string, n_found int, same_result boolean")


# ---------------------------------------------------------------------------- invariants of the fits
_SETS_SQL = f"""WITH {TB.sql_ctes('dq_train', 'dq_dirty')},
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws('|', '42', 'holdout', doc_id)), doc_id) AS rk,
  count(*) OVER (PARTITION BY target) AS cn FROM dq_train WHERE target IS NOT NULL),
held AS (SELECT * FROM r WHERE rk <= round(cn * 0.25)),
test AS (SELECT * FROM held WHERE n_chars IS NOT NULL AND n_words IS NOT NULL AND n_lines IS NOT NULL),
train AS (SELECT * FROM (SELECT DISTINCT * FROM dq_dirty) WHERE target IS NOT NULL AND ({_NC}) IS NOT NULL
  AND n_words IS NOT NULL AND n_lines IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM held)),
big AS (SELECT max(c) / sum(c) AS share FROM (SELECT count(*) AS c FROM train GROUP BY target))"""


def _fitted(spark, sf) -> EV.Fit:
    return EV.fit(cut_lineage(RP.dedupe(TB.dq_dirty(spark, sf))), TB.dq_train(spark, sf), "target", ["doc_id"])


def _right(pred):
    return F.avg((F.col("label") == F.col(pred)).cast("double"))


@register("e1_fit_sets", f"""{_SETS_SQL}
SELECT (SELECT count(*) FROM test)::BIGINT AS n_test, (SELECT count(*) FROM train)::BIGINT AS n_train, 0::BIGINT AS key_overlap,
  (SELECT count(*) FROM test)::BIGINT AS n_predicted""")
def e1_fit_sets(spark, sf):
    """Rows that the evaluation trains and tests on: exact counts, no key in both."""
    f = _fitted(spark, sf)
    both = f.train.select("doc_id").distinct().join(f.test.select("doc_id"), "doc_id")
    n = [x.agg(F.count(F.lit(1)).alias(c)) for x, c in ((f.test, "n_test"), (f.train, "n_train"), (both, "key_overlap"),
                                                       (f.pred, "n_predicted"))]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).crossJoin(n[3])


@register("e4_forest_invariants", f"""{_SETS_SQL}
SELECT 20 AS n_trees, true AS depth_in_bound, (SELECT count(*) FROM train)::BIGINT AS n_train, true AS classes_known,
  {s6('share')} AS largest_class, true AS beats_largest_class FROM big""")
def e4_forest_invariants(spark, sf):
    """On its own training rows the forest is at least as good as naming the largest class; it names only known ones."""
    f = _fitted(spark, sf)
    d = f.rf.transform(f.train)
    share = f.train.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(
        (F.max("c") / F.sum("c")).alias("largest_class"), F.collect_set("label").alias("__known"))
    one = d.agg(F.count(F.lit(1)).alias("n_train"), _right("rf_pred").alias("__acc"), F.collect_set("rf_pred").alias("__named"))
    return r6(one.crossJoin(share).select(
        F.lit(f.rf.getNumTrees).alias("n_trees"), F.lit(max(t.depth for t in f.rf.trees) <= EV.MAX_DEPTH).alias("depth_in_bound"),
        "n_train", (F.size(F.array_except("__named", "__known")) == 0).alias("classes_known"), "largest_class",
        (F.col("__acc") >= F.col("largest_class") - 1e-9).alias("beats_largest_class")))


#: Bound of a derivative of the mean log-loss per standard deviation of a feature.
GRADIENT = 1e-5


@register("e5_gradient", f"""{_SETS_SQL}
SELECT f.feature, (SELECT count(*) FROM train)::BIGINT AS n_train, true AS at_optimum
FROM (VALUES ('n_chars'), ('n_words'), ('n_lines'), ('(intercept)')) f(feature)""")
def e5_gradient(spark, sf):
    """The penalised loss has no slope at the fitted weights, feature by feature."""
    f = _fitted(spark, sf)
    n = f.train.agg(F.count(F.lit(1)).alias("n_train"))
    return EV.loss_gradient(f).crossJoin(n).select("feature", "n_train", (F.abs("gradient") < GRADIENT).alias("at_optimum"))


@register("e7_importance_invariants", """SELECT 3::BIGINT AS n_features, 1.0::DOUBLE AS total, true AS none_negative,
  true AS in_order""")
def e7_importance_invariants(spark, sf):
    f = _fitted(spark, sf)
    raw = [float(v) for v in f.rf.featureImportances.toArray()]
    top = EV.importance(f.rf, f.features, spark)
    w = top.agg(F.count(F.lit(1)).alias("n_features"), F.collect_list("importance").alias("__v"))
    return w.select("n_features", F.lit(round(sum(raw), 6)).alias("total"), F.lit(min(raw) >= 0).alias("none_negative"),
                    (F.col("__v") == F.reverse(F.array_sort("__v"))).alias("in_order"))


_BEST_SQL = f"""{_SETS_SQL},
x AS (SELECT ({_NC}) AS a, n_words, n_lines, target, count(*) AS c FROM train GROUP BY ALL),
g AS (SELECT a, n_words, n_lines, max(c) AS m FROM x GROUP BY ALL)"""


@register("e4_unlimited_tree", f"""{_BEST_SQL}
SELECT (SELECT count(*) FROM train)::BIGINT AS n_train, (SELECT sum(m) FROM g)::BIGINT AS n_right""")
def e4_unlimited_tree(spark, sf):
    """One tree without a depth limit on all training rows: right wherever equal rows do not contradict each other."""
    train = _fitted_rows(spark, sf)
    tree = DEEP.fit(train, FEATS, n_trees=1, bootstrap=False, max_features=len(FEATS))
    return tree.predict(train).agg(F.count(F.lit(1)).alias("n_train"),
                                   F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("n_right"))


@register("e4_unlimited_forest", f"""{_SETS_SQL}
SELECT 20 AS n_trees, (SELECT count(*) FROM test)::BIGINT AS n_test, (SELECT count(*) FROM train)::BIGINT AS n_train,
  true AS beats_largest_class FROM big""")
def e4_unlimited_forest(spark, sf):
    """Twenty trees on drawn samples, grown to purity as the reference's are."""
    train = _fitted_rows(spark, sf)
    held = EV.stratified_split(TB.dq_train(spark, sf), "target", ["doc_id"]).where("is_test").drop("is_test")
    test = EV.prepare(held, "target", FEATS)
    forest = DEEP.fit(train, FEATS, n_trees=EV.FAST_TREES)
    share = train.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") / F.sum("c")).alias("share"))
    fit = forest.predict(train).agg(F.count(F.lit(1)).alias("n_train"), _right("prediction").alias("acc"))
    n = forest.predict(test).agg(F.count("prediction").alias("n_test"))
    return fit.crossJoin(share).crossJoin(n).select(F.lit(forest.trees).alias("n_trees"), "n_test", "n_train",
                                                    (F.col("acc") >= F.col("share")).alias("beats_largest_class"))


def _fitted_rows(spark, sf):
    """The rows that the evaluation trains on."""
    held = EV.stratified_split(TB.dq_train(spark, sf), "target", ["doc_id"]).where("is_test").select("doc_id")
    return cut_lineage(EV.prepare(RP.dedupe(TB.dq_dirty(spark, sf)), "target", FEATS).join(held, "doc_id", "left_anti"))
