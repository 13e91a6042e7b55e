"""Fixed-model evaluation (family E) with pyspark.ml.

Train on the repaired table, test on an exact stratified 25% holdout of the
clean table.  The holdout is chosen by md5 rank per class (two-level rank, so
a hot class is split over hash buckets), the metrics are plain aggregations
over the predictions table, and model fitting is MLlib's distributed tree /
L-BFGS training.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import round_to

from ..functions.expr import to_number
from ..functions.sequence import DEFAULT_CHUNK, halo_window, ordered_rank
from ..functions.ranking import hash_hex, select_smallest
from .integrity import fingerprint
from .profile import feature_columns

# Fixed values from the reference evaluator.
TEST_SIZE = 0.25
FAST_TREES = 20
FULL_TREES = 100
MIN_ROWS = 10
LR_MAX_ITER = 500
AGREE_BAND = 0.005
TOP_FEATURES = 5
AGREEMENT = {
    "both_improve": "BOTH_AGREE_IMPROVE",
    "disagree": "DISAGREE",
    "both_declined": "BOTH_DECLINED",
    "no_change": "NO_CHANGE",
    "mixed": "MIXED",
}


MAX_DEPTH = 10  # the reference has no limit; MLlib allows up to 30


def label_index(working: DataFrame, truth: DataFrame, label: str) -> DataFrame | None:
    """Non-numeric labels -> 0..k-1 by sorted value (one row per class: a tiny table).
    None when the label is already numeric."""
    if isinstance(working.schema[label].dataType, T.NumericType):
        return None
    labs = working.select(label).unionByName(truth.select(label)).where(F.col(label).isNotNull()).distinct()
    return labs.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("double").alias("__li"))


def prepare(df: DataFrame, label: str, features: list[str], index: DataFrame | None = None) -> DataFrame:
    """Drop null labels, coerce features to numbers, drop rows with any missing feature.
    ``index`` (from ``label_index``) maps non-numeric labels to class numbers."""
    cols = [to_number(c, df.schema[c].dataType).alias(c) for c in features]
    d = df.where(F.col(label).isNotNull())
    lab = F.col(label).cast("double")
    if index is not None:
        d = d.join(index, label)
        lab = F.col("__li")
    out = d.select(lab.alias("label"), *cols, *[c for c in df.columns if c not in features and c != label])
    return out.dropna(subset=features)


def stratified_split(truth: DataFrame, label: str, keys, test_size: float = TEST_SIZE, seed=42) -> DataFrame:
    """Exact per-class holdout: rows whose md5 rank within their class is
    <= round(test_size x class count).  Adds ``is_test``."""
    d = truth.withColumn("__h", hash_hex(seed, F.lit("holdout"), *keys))
    d = d.where(F.col(label).isNotNull())
    r = select_smallest(d, "__h", lambda n: round_to(n * test_size, 0), [label], list(keys), "is_test")
    return r.drop("__h")


def _models(features, n_trees, seed, reg, max_depth):
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=n_trees, seed=seed, maxDepth=max_depth,
                                predictionCol="rf_pred", probabilityCol="rf_prob", rawPredictionCol="rf_raw")
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=LR_MAX_ITER, regParam=reg,
                            standardization=False, predictionCol="lr_pred", probabilityCol="lr_prob",
                            rawPredictionCol="lr_raw")
    return va, rf, lr


@dataclass
class Fit:
    """What an evaluation fitted: predictions on the holdout, the prepared training and test rows, both models."""
    pred: DataFrame
    features: list
    train: DataFrame | None = None
    test: DataFrame | None = None
    rf: object = None
    lr: object = None
    reg: float = 0.0


def fit(working: DataFrame, truth: DataFrame, label: str = "target", keys=(), fast: bool = True, seed=42,
        exclude_holdout_keys: bool = True, max_depth: int = MAX_DEPTH) -> Fit:
    """Trains on the repaired table, predicts the holdout of the truth table.

    ``exclude_holdout_keys`` removes holdout rows (by key) from training, which
    the reference does not do (its test rows leak into training); ``False``
    reproduces the reference.  ``max_depth``: of the forest's trees, at most 30."""
    feats = [c for c in feature_columns(working, label, keys) if c in truth.columns]
    spark = working.sparkSession
    empty = spark.createDataFrame([], "label double, rf_pred double, lr_pred double").select(
        "label", "rf_pred", "lr_pred", *[F.lit(None).alias(k) for k in keys])
    # reference early exits: no shared feature columns, or fewer than 10 usable truth rows
    if not feats or truth.where(F.col(label).isNotNull()).limit(MIN_ROWS).count() < MIN_ROWS:
        return Fit(empty, feats)
    idx = label_index(working, truth, label)
    tr = prepare(working, label, feats, idx)
    split = stratified_split(truth, label, keys, seed=seed)
    test = prepare(split.where("is_test").drop("is_test"), label, feats, idx)
    if exclude_holdout_keys and keys:
        hk = split.where("is_test").select(*keys)
        tr = tr.join(hk, list(keys), "left_anti")
    n_train = tr.count()
    if n_train < MIN_ROWS:  # nor fewer than 10 usable training rows
        return Fit(empty, feats)
    va, rf, lr = _models(feats, FAST_TREES if fast else FULL_TREES, seed, 1.0 / n_train, max_depth)
    trv = va.transform(tr).cache()
    rfm = rf.fit(trv)
    lrm = lr.fit(trv)
    pred = lrm.transform(rfm.transform(va.transform(test)))
    trv.unpersist()
    return Fit(pred.select("label", "rf_pred", "lr_pred", *[k for k in keys]), feats, va.transform(tr), test, rfm, lrm, 1.0 / n_train)


def run(working: DataFrame, truth: DataFrame, label: str = "target", keys=(), **options):
    """(predictions DataFrame on the holdout, rf model, feature list) of ``fit``."""
    f = fit(working, truth, label, keys, **options)
    return f.pred, f.rf, f.features


def loss_gradient(f: Fit) -> DataFrame:
    """E5: how far the fitted weights are from the optimum: per class and feature the derivative of the penalised mean
    log-loss, divided by the feature's standard deviation (a step in units of the feature), one aggregate over the
    training rows.  Rows (cls, feature, gradient); feature ``(intercept)`` has no penalty."""
    from pyspark.ml.functions import vector_to_array
    w, n_cls = f.lr.coefficientMatrix.toArray(), f.lr.coefficientMatrix.numRows
    d = f.lr.transform(f.train).withColumn("__p", vector_to_array("lr_prob"))
    cells = []
    for k in range(n_cls):
        cls = 1 if n_cls == 1 else k
        err = F.element_at("__p", cls + 1) - (F.col("label") == float(cls)).cast("double")
        for j, c in enumerate(f.features):
            sd = F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)).otherwise(F.lit(1.0))
            cells.append((cls, c, (F.avg(err * F.col(c)) + F.lit(f.reg * float(w[k][j]))) / sd))
        cells.append((cls, "(intercept)", F.avg(err)))
    one = d.agg(*[v.alias(f"__g{i}") for i, (_, _, v) in enumerate(cells)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(c).alias("feature"), F.col(f"__g{i}").alias("gradient"))
                                          for i, (k, c, _) in enumerate(cells)])).alias("g")).select("g.*")


def report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support (0 on zero division) plus
    accuracy, macro and weighted averages, from a (label, prediction) table."""
    cm = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    npred = cm.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("npred"))
    per = (sup.join(npred, "cls", "full").join(tp, "cls", "left")
           .select("cls", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("npred", F.lit(0)).alias("npred")))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select(F.col("cls").cast("string").alias("cls"), prec.alias("precision"), rec.alias("recall"),
                     F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
                     F.col("support").cast("long").alias("support"), "tp")
    tot = per.agg(F.sum("support").alias("N"), F.sum("tp").alias("TP"), F.count(F.lit(1)).alias("K"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("cls"), (F.col("TP") / F.col("N")).alias("precision"),
                     (F.col("TP") / F.col("N")).alias("recall"), (F.col("TP") / F.col("N")).alias("f1"),
                     F.col("N").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("cls"), (F.col("sp") / F.col("K")).alias("precision"),
                       (F.col("sr") / F.col("K")).alias("recall"), (F.col("sf") / F.col("K")).alias("f1"),
                       F.col("N").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("cls"), (F.col("wp") / F.col("N")).alias("precision"),
                          (F.col("wr") / F.col("N")).alias("recall"), (F.col("wf") / F.col("N")).alias("f1"),
                          F.col("N").cast("long").alias("support"))
    return per.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


def accuracy(pred: DataFrame, prediction: str) -> DataFrame:
    return pred.agg(F.avg((F.col("label") == F.col(prediction)).cast("double")).alias("accuracy"))


def importance(rf_model, features: list[str], spark, top_n: int = TOP_FEATURES) -> DataFrame:
    """RF importances rounded to 4, top n.  The vector has one entry per
    feature (bounded by the column count); without a model no rows."""
    if rf_model is None:
        return spark.createDataFrame([], "col_name string, importance double")
    imp = rf_model.featureImportances.toArray().tolist()
    rows = [(f, i, float(v)) for i, (f, v) in enumerate(zip(features, imp))]
    df = spark.createDataFrame(rows, "col_name string, pos int, importance double")
    return df.select("col_name", round_to("importance", 4).alias("importance"), "pos").orderBy(
        F.col("importance").desc(), "pos").limit(top_n).drop("pos")


def agreement(evals: DataFrame, partition_cols, order_col: str, rf: str = "rf_acc", lr: str = "lr_acc") -> DataFrame:
    """Compare each evaluation with the previous one (0 before the first) in a
    +-0.005 dead band; first matching label wins.  Bounded (key, chunk) windows with
    a halo of one row; ``order_col`` is numeric."""
    d = ordered_rank(evals, partition_cols, [order_col], F.floor(F.col(order_col) / F.lit(DEFAULT_CHUNK)), "__p")
    d = halo_window(d, partition_cols, "__p", 1, lambda x, w: x.withColumns(
        {"__prf": F.lag(rf).over(w), "__plr": F.lag(lr).over(w)}))
    prf, plr = F.coalesce("__prf", F.lit(0.0)), F.coalesce("__plr", F.lit(0.0))
    rf_up, lr_up = F.col(rf) > prf + AGREE_BAND, F.col(lr) > plr + AGREE_BAND
    rf_dn, lr_dn = F.col(rf) < prf - AGREE_BAND, F.col(lr) < plr - AGREE_BAND
    lab = (F.when(rf_up & lr_up, AGREEMENT["both_improve"]).when(rf_up & lr_dn, AGREEMENT["disagree"])
           .when(rf_dn & lr_dn, AGREEMENT["both_declined"]).when(~rf_up & ~rf_dn, AGREEMENT["no_change"])
           .otherwise(AGREEMENT["mixed"]))
    return d.withColumn("agreement", lab).drop("__p", "__prf", "__plr")


def cache_key(df: DataFrame, params: str) -> DataFrame:
    """(fingerprint, params) key of an evaluation."""
    return fingerprint(df).select(F.sha2(F.concat_ws("|", "n_rows", "hash_sum", "hash_xor", F.lit(params)), 256)
                                  .alias("eval_key"))


def pending(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Evaluation requests with no cached result (left anti join on the key)."""
    return requests.join(results.select("eval_key"), "eval_key", "left_anti")


RESULT_SCHEMA = "eval_key string, params string, rf_accuracy double, lr_accuracy double"


def request_key(working: DataFrame, truth: DataFrame, label: str = "target", keys=(), params: str = "", **options) -> str:
    """Key of an evaluation: both tables' fingerprints and columns, the label, the keys and every option of ``fit``."""
    known = {n: p.default for n, p in inspect.signature(fit).parameters.items() if p.default is not inspect.Parameter.empty}
    unknown = set(options) - set(known)
    if unknown:
        raise TypeError(f"unknown options {sorted(unknown)}")
    how = {**known, **options, "label": label, "keys": list(keys), "params": params,
           "columns": [working.dtypes, truth.dtypes]}
    prints = [[str(v) for v in fingerprint(d).first()] for d in (working, truth)]
    return hashlib.sha256(json.dumps([prints, how], sort_keys=True, default=str).encode()).hexdigest()


def stored_accuracy(spark, path: str, key: str) -> DataFrame:
    """The result row (``RESULT_SCHEMA``) of a request in the table at ``path``, or none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):  # nothing stored yet
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(path).where(F.col("eval_key") == key).limit(1)


def cached_accuracy(working: DataFrame, truth: DataFrame, params: str, path: str, label: str = "target", keys=(),
                    **options) -> DataFrame:
    """One result row (``RESULT_SCHEMA``) from the table at ``path``, found by ``request_key``; fitted and
    appended when it is not there."""
    spark = working.sparkSession
    key = request_key(working, truth, label, keys, params, **options)
    if stored_accuracy(spark, path, key).isEmpty():
        pred = fit(working, truth, label, keys, **options).pred
        one = pred.agg(F.avg((F.col("label") == F.col("rf_pred")).cast("double")).alias("rf_accuracy"),
                       F.avg((F.col("label") == F.col("lr_pred")).cast("double")).alias("lr_accuracy"))
        one.select(F.lit(key).alias("eval_key"), F.lit(params).alias("params"), "rf_accuracy", "lr_accuracy") \
            .write.mode("append").parquet(path)
    return stored_accuracy(spark, path, key)
