"""URL filter: list rules first, gradient-boosted trees on lexical features for the rest.

The trees (MLlib, JVM side) learn from labelled URLs: those that a rule decides.
Features are native column expressions of the URL string: lengths, depth, digit
ratio, character entropy, parameter counts, and statistics of the host's suffix
(the smoothed block rate and count of the suffix among the labelled URLs).

The fit reads at most about ``SAMPLE`` labelled URLs: rows are kept by a hash
threshold computed from their exact count, so the bound is a parameter and the
choice repeats.  Everything else covers all rows.

Edge cases: a URL that is null or has no ``://`` has empty host and path and
goes to the model like any other; rule ties cannot occur between distinct rules
of equal length on one URL unless host and path are equal (the first wins);
with no labelled URL the verdict is ``allow``, with one class it is that class;
an empty table gives an empty result; repeated rows are judged alike; a URL of
any length is read whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (host, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SAMPLE = 20_000
#: Characters whose shares enter the entropy; all others count as one class.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%:#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty when the host ends there already."""
    no_query = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(no_query, "/")
    return F.when(at > 0, F.substring(no_query, at, F.length(no_query))).otherwise(F.lit(""))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` (host + path of the longest fitting rule) and ``rule_verdict``."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")


FEATURES = ["url_len", "host_len", "path_len", "query_len", "depth", "host_labels", "digit_ratio", "dash_ratio",
            "entropy", "n_params", "has_fragment", "suffix_rate", "suffix_log_n"]


def lexical(df: DataFrame) -> DataFrame:
    """Native lexical features of ``url`` / ``host`` / ``path`` (null url: empty)."""
    u = F.lower(F.coalesce(F.col("url"), F.lit("")))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")

    def term(k):
        return F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(F.lit(0.0))

    entropy = term(F.length(F.translate(u, ALPHABET, "")).cast("double"))
    for ch in ALPHABET:
        entropy = entropy + term(_count(u, ch))
    has_query = F.instr(u, "?") > 0
    query = F.when(has_query, F.substring_index(F.substring(u, F.instr(u, "?") + 1, F.length(u)), "#", 1)).otherwise(F.lit(""))
    return df.withColumns({
        "url_len": F.length(u).cast("double"), "host_len": F.length("host").cast("double"),
        "path_len": F.length("path").cast("double"), "query_len": F.length(query).cast("double"),
        "depth": _count(F.col("path"), "/"), "host_labels": _count(F.col("host"), ".") + 1,
        "digit_ratio": _count(u, "0123456789") / n, "dash_ratio": _count(u, "-_") / n, "entropy": entropy,
        "n_params": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1),
        "has_fragment": (F.instr(u, "#") > 0).cast("double"), "suffix": F.substring_index("host", ".", -2)})


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE,
               trees: int = 10, depth: int = 4, seed: int = 11) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score (null where a rule decides)."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = lexical(with_rule(base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules))
    base = stored(base)
    labelled = base.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    out = ["page_id", "host", "path", "rule"]
    if n == 0 or blocked in (0, n):
        other = "block" if n and blocked == n else "allow"
        return base.select(*out, F.coalesce("rule_verdict", F.lit(other)).alias("verdict"),
                           F.lit(None).cast("double").alias("block_score"))
    rate = blocked / n
    suffix = labelled.groupBy("suffix").agg(
        ((F.sum("label") + 10 * rate) / (F.count(F.lit(1)) + 10)).alias("suffix_rate"),
        F.log1p(F.count(F.lit(1))).alias("suffix_log_n"))
    suffix = stored(suffix)

    def features(df):
        j = df.join(suffix, "suffix", "left").fillna({"suffix_rate": rate, "suffix_log_n": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(j)

    if n > sample:  # a hash threshold: about ``sample`` rows, the same ones on every run
        bar = int(2 ** 32 * sample / n)
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 32)) < bar)
    train = stored(labelled.select("url", "label", "suffix", *FEATURES[:-2]))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, subsamplingRate=1.0, seed=seed,
                          cacheNodeIds=False).fit(features(train).select("features", "label").coalesce(4))
    model.setPredictionCol("guess").setRawPredictionCol("raw").setProbabilityCol("prob")
    open_rows = model.transform(features(base.where("rule is null")))
    from pyspark.ml.functions import vector_to_array
    judged = open_rows.select(*out, F.when(F.col("guess") == 1.0, "block").otherwise("allow").alias("verdict"),
                              vector_to_array("prob")[1].alias("block_score"))
    ruled = base.where("rule is not null").select(*out, F.col("rule_verdict").alias("verdict"),
                                                  F.lit(None).cast("double").alias("block_score"))
    return ruled.unionByName(judged)
