"""Family A (profiling) and X (scalar expressions) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import expr as X
from ...operators import profile as P
from ...sources import tables as TB
from . import register
from .common import r6
from .sqlgen import r6 as s6, to_number, union_all

ORD_FEATS = [("o_custkey", False), ("o_totalprice", True)]
LI_FEATS = [("l_quantity", False), ("l_extendedprice", False), ("l_discount", False), ("l_tax", False)]
DQ_FEATS = [("n_chars", True), ("n_words", False), ("n_lines", False)]


def stats_sql(table: str, feats) -> str:
    parts = []
    for i, (c, txt) in enumerate(feats):
        x = to_number(c, txt)
        parts.append(
            f"SELECT '{c}' AS col_name, {i} AS pos, count(x)::BIGINT AS n, "
            f"CASE WHEN count(x) > 0 THEN avg(x) ELSE 0.0 END AS mean, "
            f"CASE WHEN count(x) > 0 THEN quantile_cont(x, 0.5) ELSE 0.0 END AS median, "
            f"CASE WHEN count(x) > 1 THEN coalesce(stddev_samp(x), 0.0) ELSE 0.0 END AS std, "
            f"CASE WHEN count(x) > 2 THEN coalesce(CASE WHEN isnan(skewness(x)) THEN NULL ELSE skewness(x) END, 0.0)"
            f" ELSE 0.0 END AS skew, min(x) AS min, max(x) AS max, "
            f"count(*)::BIGINT AS n_rows, (count(*) - count(raw))::BIGINT AS n_missing, "
            f"count(CASE WHEN raw IS NOT NULL AND x IS NULL THEN 1 END)::BIGINT AS type_errors "
            f"FROM (SELECT {x} AS x, {c} AS raw FROM {table})")
    return union_all(parts)


def _stats_cte(table, feats):
    return (f"st AS ({stats_sql(table, feats)}), "
            f"st2 AS (SELECT *, abs(max - mean) / CASE WHEN std = 0 THEN 1.0 ELSE std END AS max_z FROM st)")


# --- A1 ----------------------------------------------------------------------------------------
def _a1_sql():
    parts = [f"SELECT '{c}' AS col_name, {i} AS pos, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_missing, "
             f"{s6(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS pct_missing FROM orders_dirty "
             f"HAVING count(*) FILTER (WHERE {c} IS NULL) > 0" for i, (c, _) in enumerate(ORD_FEATS)]
    return f"WITH {TB.sql_ctes('orders_dirty')}\n" + union_all(parts)


@register("a1_missing", _a1_sql())
def a1_missing(spark, sf):
    return r6(P.missing(TB.orders_dirty(spark, sf), label="o_orderstatus", keys=["o_orderkey"]))


# --- A2 ----------------------------------------------------------------------------------------
@register("a2_total_missing", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT ({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in TB.LINEITEM_COLS)})::BIGINT AS total_missing
FROM lineitem_dirty""")
def a2_total_missing(spark, sf):
    return P.total_missing(TB.lineitem_dirty(spark, sf))


# --- A3 ----------------------------------------------------------------------------------------
@register("a3_duplicates", f"""WITH {TB.sql_ctes('orders_dirty')}
SELECT sum(c)::BIGINT AS n_rows, count(*)::BIGINT AS n_distinct, sum(c - 1)::BIGINT AS n_duplicates
FROM (SELECT count(*) AS c FROM orders_dirty GROUP BY ALL_COLS)""".replace(
    "ALL_COLS", ", ".join(TB.ORDERS_COLS)))
def a3_duplicates(spark, sf):
    return P.duplicates(TB.orders_dirty(spark, sf))


# --- A4 ----------------------------------------------------------------------------------------
@register("a4_class_counts", f"""WITH {TB.sql_ctes('dq_dirty')}
SELECT target AS label, count(*)::BIGINT AS count,
       {s6('count(*) * 100.0 / (SELECT count(*) FROM dq_dirty)')} AS pct
FROM dq_dirty WHERE target IS NOT NULL GROUP BY target""")
def a4_class_counts(spark, sf):
    return r6(P.class_counts(TB.dq_dirty(spark, sf), "target"))


# --- A5 ----------------------------------------------------------------------------------------
def _shape_sql():
    types = {"o_orderkey": "bigint", "o_custkey": "double", "o_totalprice": "string", "o_orderstatus": "string"}
    rows = union_all([f"SELECT '{c}' AS col_name, '{t}' AS dtype" for c, t in types.items()])
    return f"""WITH {TB.sql_ctes('orders_dirty')}, d AS ({rows})
SELECT (SELECT count(*) FROM orders_dirty)::BIGINT AS n_rows, 2 AS n_features,
       {s6('(SELECT count(*) FROM orders_dirty) / (SELECT count(*) FROM orders)')} AS preserved, col_name, dtype
FROM d"""


@register("a5_shape", _shape_sql())
def a5_shape(spark, sf):
    d = TB.orders_dirty(spark, sf)
    orig = TB.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("__o"))
    s = P.shape(d, label="o_orderstatus", keys=["o_orderkey"]).crossJoin(F.broadcast(orig))
    return r6(s.select("n_rows", "n_features", (F.col("n_rows") / F.col("__o")).alias("preserved"),
                       "col_name", "dtype"))


# --- A6 / A8 -----------------------------------------------------------------------------------
@register("a6_numeric_stats", f"""WITH {TB.sql_ctes('lineitem_dirty')}, {_stats_cte('lineitem_dirty', LI_FEATS)}
SELECT col_name, pos, n, {s6('mean')} AS mean, {s6('median')} AS median, {s6('std')} AS std,
       {s6('skew')} AS skew FROM st2""")
def a6_numeric_stats(spark, sf):
    s = P.numeric_stats(TB.lineitem_dirty(spark, sf), label="l_returnflag", keys=TB.LINEITEM["keys"])
    return r6(s.select("col_name", "pos", "n", "mean", "median", "std", "skew"))


@register("a8_observed_range", f"""WITH {TB.sql_ctes('lineitem_dirty')}, {_stats_cte('lineitem_dirty', LI_FEATS)}
SELECT col_name, {s6('min')} AS min, {s6('max')} AS max, {s6('max_z')} AS max_z FROM st2""")
def a8_observed_range(spark, sf):
    s = P.numeric_stats(TB.lineitem_dirty(spark, sf), label="l_returnflag", keys=TB.LINEITEM["keys"],
                        with_median=False)
    return r6(s.select("col_name", "min", "max", "max_z"))


# --- A7 ----------------------------------------------------------------------------------------
@register("a7_type_errors", f"""WITH {TB.sql_ctes('orders_dirty')}, {_stats_cte('orders_dirty', ORD_FEATS)}
SELECT col_name, pos, n_rows, type_errors FROM st2""")
def a7_type_errors(spark, sf):
    return P.type_errors(TB.orders_dirty(spark, sf), label="o_orderstatus", keys=["o_orderkey"])


# --- A9 ----------------------------------------------------------------------------------------
@register("a9_class_entropy", f"""WITH {TB.sql_ctes('dq_dirty')},
c AS (SELECT count(*) AS n FROM dq_dirty WHERE target IS NOT NULL GROUP BY target),
p AS (SELECT n / sum(n) OVER () AS p FROM c),
e AS (SELECT count(*)::BIGINT AS n_classes, coalesce(sum(-p * log2(p + 1e-9)), 0.0) AS entropy FROM p)
SELECT n_classes, {s6('entropy')} AS entropy,
       {s6('CASE WHEN n_classes > 1 THEN entropy / log2(n_classes) * 100.0 ELSE 0.0 END')} AS entropy_pct FROM e""")
def a9_class_entropy(spark, sf):
    return r6(P.class_entropy(TB.dq_dirty(spark, sf), "target"))


# --- A10 ---------------------------------------------------------------------------------------
@register("a10_imbalance", f"""WITH {TB.sql_ctes('orders_dirty')},
c AS (SELECT o_orderstatus AS lab, count(*) AS cnt FROM orders_dirty WHERE o_orderstatus IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) AS n_classes, min(cnt) AS min_count, max(cnt) AS max_count FROM c)
SELECT n_classes::BIGINT AS n_classes, (SELECT min(lab) FROM c WHERE cnt = min_count) AS min_label,
       (SELECT min(lab) FROM c WHERE cnt = max_count) AS max_label, min_count::BIGINT AS min_count,
       max_count::BIGINT AS max_count, {s6('min_count / max_count')} AS imbalance_ratio FROM s""")
def a10_imbalance(spark, sf):
    return r6(P.imbalance(TB.orders_dirty(spark, sf), "o_orderstatus"))


# --- X1 ----------------------------------------------------------------------------------------
@register("x1_to_number", f"""WITH {TB.sql_ctes('orders_dirty')}
SELECT o_orderkey, {s6(to_number('o_totalprice', True))} AS value,
       (o_totalprice IS NOT NULL AND ({to_number('o_totalprice', True)}) IS NULL) AS is_error FROM orders_dirty""")
def x1_to_number(spark, sf):
    d = TB.orders_dirty(spark, sf)
    v = X.to_number("o_totalprice", d.schema["o_totalprice"].dataType)
    return r6(d.select("o_orderkey", v.alias("value"),
                       (F.col("o_totalprice").isNotNull() & v.isNull()).alias("is_error")))


# --- X2 / X3 -----------------------------------------------------------------------------------
@register("x2_impute_strategy", f"""WITH {TB.sql_ctes('lineitem_dirty')}, {_stats_cte('lineitem_dirty', LI_FEATS)}
SELECT col_name, {s6('skew')} AS skew,
       CASE WHEN abs(skew) > 1.0 THEN 'median' WHEN abs(skew) > 0.5 THEN 'median' ELSE 'mean' END AS strategy,
       {s6("CASE WHEN abs(skew) > 0.5 THEN median ELSE mean END")} AS fill_value FROM st2""")
def x2_impute_strategy(spark, sf):
    s = P.column_stats(TB.lineitem_dirty(spark, sf), label="l_returnflag", keys=TB.LINEITEM["keys"])
    strat, val, _ = X.impute_strategy("skew", "mean", "median")
    return r6(s.select("col_name", "skew", strat.alias("strategy"), val.alias("fill_value")))


@register("x3_missing_risk", f"""WITH {TB.sql_ctes('lineitem_dirty')}, {_stats_cte('lineitem_dirty', LI_FEATS)}
SELECT col_name, {s6('n_missing / n_rows')} AS missing_frac,
       CASE WHEN n_missing / n_rows < 0.05 THEN 'LOW' WHEN n_missing / n_rows < 0.20 THEN 'MEDIUM' ELSE 'HIGH' END
       AS risk FROM st2""")
def x3_missing_risk(spark, sf):
    s = P.column_stats(TB.lineitem_dirty(spark, sf), label="l_returnflag", keys=TB.LINEITEM["keys"], with_median=False)
    return r6(s.select("col_name", "missing_frac", X.missing_risk("missing_frac").alias("risk")))


# --- X6 ----------------------------------------------------------------------------------------
@register("x6_rescale", f"""WITH {TB.sql_ctes('dq_train')}
SELECT doc_id, {s6('(n_chars - (SELECT min(n_chars) FROM dq_train)) / ((SELECT max(n_chars) FROM dq_train) - '
                   '(SELECT min(n_chars) FROM dq_train) + 1e-9) * 62.0 + 18.0')} AS n_chars_scaled FROM dq_train""")
def x6_rescale(spark, sf):
    d = TB.dq_train(spark, sf)
    mm = d.agg(F.min("n_chars").alias("__lo"), F.max("n_chars").alias("__hi"))
    return r6(d.crossJoin(F.broadcast(mm)).select(
        "doc_id", X.rescale("n_chars", "__lo", "__hi").alias("n_chars_scaled")))


# --- X7 ----------------------------------------------------------------------------------------
@register("x7_truncate_action", """SELECT conv_id, turn, length(CASE WHEN length(text) > 200 THEN substr(text, 1, 200)
       ELSE text END)::BIGINT AS kept_chars, length(text) > 200 AS truncated,
       CASE WHEN length(text) > 200 THEN -0.02 ELSE 0.0 END::DOUBLE AS penalty FROM conversations""")
def x7_truncate_action(spark, sf):
    c = TB.table(spark, sf, "conversations")
    cut, flag, pen = X.truncate_action("text")
    return c.select("conv_id", "turn", F.length(cut).cast("bigint").alias("kept_chars"),
                    flag.alias("truncated"), pen.alias("penalty"))


# --- X9 ----------------------------------------------------------------------------------------
@register("x9_clip", """SELECT event_id, round(least(greatest(value / 250.0 - 1.0, -1.0), 1.0), 6) AS reward
FROM events""")
def x9_clip(spark, sf):
    e = TB.table(spark, sf, "events")
    return r6(e.select("event_id", X.clip(F.col("value") / 250.0 - 1.0, -1.0, 1.0).alias("reward")))
