"""Family B (recommendations and diagnosis) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import diagnose as DG
from ...operators import profile as P
from ...operators import recommend as RC
from ...operators import repair as RP
from ...sources import tables as TB
from . import register
from .common import r6
from .profiling import LI_FEATS, ORD_FEATS, _stats_cte
from .sqlgen import r6 as s6, to_number, union_all

LK = TB.LINEITEM["keys"]
OK = ["o_orderkey"]

_FILL = ("SELECT col_name, pos, CASE WHEN abs(skew) > 0.5 THEN 'median' ELSE 'mean' END AS strategy, "
         "round(least(0.03 + n_missing / n_rows * 0.3, 0.12), 3) AS estimated_impact, "
         "round(greatest(0.60, 0.92 - n_missing / n_rows * 0.5), 2) AS confidence, "
         "CASE WHEN n_missing / n_rows < 0.05 THEN 'LOW' WHEN n_missing / n_rows < 0.20 THEN 'MEDIUM' ELSE 'HIGH' END "
         "AS risk FROM st2 WHERE n_missing > 0")


@register("b1_fill_missing_advice", f"""WITH {TB.sql_ctes('lineitem_dirty')}, {_stats_cte('lineitem_dirty', LI_FEATS)}
SELECT col_name, strategy, estimated_impact, confidence, risk FROM ({_FILL})""")
def b1_fill_missing_advice(spark, sf):
    st = P.column_stats(TB.lineitem_dirty(spark, sf), "l_returnflag", LK)
    return RC.fill_missing(st).select("col_name", "strategy", "estimated_impact", "confidence", "risk")


def _dups_cte(t, cols):
    return f"dd AS (SELECT count(*) AS n, count(*) - count(DISTINCT ({', '.join(cols)})) AS d FROM {t})"


_DEDUPE = ("SELECT 'remove_duplicates' AS action_type, CAST(NULL AS VARCHAR) AS col_name, CAST(NULL AS VARCHAR) AS "
           "strategy, round(least(0.02 + d / n * 0.15, 0.08), 3) AS estimated_impact, 0.92 AS confidence, "
           "10000 AS emit_pos FROM dd WHERE d > 0")
_TYPE = ("SELECT 'fix_type_errors' AS action_type, col_name, CAST(NULL AS VARCHAR) AS strategy, "
         "round(least(0.04 + type_errors / n_rows * 0.2, 0.10), 3) AS estimated_impact, 0.88 AS confidence, "
         "20000 + pos AS emit_pos FROM st2 WHERE type_errors > 0")


@register("b2_dedupe_advice", f"""WITH {TB.sql_ctes('orders_dirty')}, {_dups_cte('orders_dirty', TB.ORDERS_COLS)}
SELECT estimated_impact, CAST(confidence AS DOUBLE) AS confidence FROM ({_DEDUPE})""")
def b2_dedupe_advice(spark, sf):
    return RC.dedupe(TB.orders_dirty(spark, sf)).select("estimated_impact", "confidence")


@register("b3_type_fix_advice", f"""WITH {TB.sql_ctes('orders_dirty')}, {_stats_cte('orders_dirty', ORD_FEATS)}
SELECT col_name, estimated_impact, CAST(confidence AS DOUBLE) AS confidence FROM ({_TYPE})""")
def b3_type_fix_advice(spark, sf):
    st = P.column_stats(TB.orders_dirty(spark, sf), "o_orderstatus", OK, with_median=False)
    return RC.type_fix(st).select("col_name", "estimated_impact", "confidence")


def _clean_sql():
    fill = ("SELECT 'fill_missing' AS action_type, col_name, strategy, estimated_impact, confidence, pos AS emit_pos "
            f"FROM ({_FILL})")
    return (f"WITH {TB.sql_ctes('orders_dirty')}, {_stats_cte('orders_dirty', ORD_FEATS)}, "
            f"{_dups_cte('orders_dirty', TB.ORDERS_COLS)}, u AS ({union_all([fill, _DEDUPE, _TYPE])}), "
            "r AS (SELECT *, row_number() OVER (ORDER BY estimated_impact DESC, emit_pos) AS rec_id FROM u) "
            "SELECT CAST(rec_id AS INTEGER) AS rec_id, action_type, col_name, strategy, estimated_impact, "
            "CAST(confidence AS DOUBLE) AS confidence FROM r WHERE rec_id <= 4")


CLEAN_SQL = _clean_sql()


@register("b4_clean", CLEAN_SQL)
def b4_clean(spark, sf):
    return RC.clean(TB.orders_dirty(spark, sf), "o_orderstatus", OK).select(
        "rec_id", "action_type", "col_name", "strategy", "estimated_impact", "confidence")


_CLS = ("c AS (SELECT target AS lab, count(*) AS cnt FROM dq_dirty WHERE target IS NOT NULL GROUP BY 1), "
        "m AS (SELECT max(cnt) AS mx, min(cnt) AS mn, count(*) AS k, (SELECT count(*) FROM dq_dirty) AS total FROM c)")


@register("b5_augment", f"""WITH {TB.sql_ctes('dq_dirty')}, {_CLS},
top AS (SELECT * FROM c ORDER BY cnt DESC, lab LIMIT 3),
g AS (SELECT lab, cnt, mx - cnt AS gap, total, mx FROM top, m WHERE mx - cnt > 0),
s AS (SELECT *, least(gap, greatest(5, floor(gap * 0.5)))::BIGINT AS n_synth FROM g)
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, lab) AS INTEGER) AS rec_id, CAST(lab AS VARCHAR) AS cls, n_synth,
  round(least(0.04 + n_synth / total * 0.4, 0.10), 3) AS estimated_impact, 0.82::DOUBLE AS confidence,
  CASE WHEN cnt / mx < 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s""")
def b5_augment(spark, sf):
    return RC.augment(TB.dq_dirty(spark, sf), "target").select(
        "rec_id", "cls", "n_synth", "estimated_impact", "confidence", "risk")


_BAL = (f"ext AS (SELECT mx, mn, (SELECT min(lab) FROM c WHERE cnt = mn) AS min_cls, "
        f"(SELECT min(lab) FROM c WHERE cnt = mx) AS max_cls, mn / mx AS ratio FROM m WHERE k >= 2)")


@register("b6_oversample_advice", f"""WITH {TB.sql_ctes('dq_dirty')}, {_CLS}, {_BAL}
SELECT 1 AS rec_id, CAST(min_cls AS VARCHAR) AS cls, mx::BIGINT AS target_count,
  round(least(0.05 + (1 - ratio) * 0.15, 0.12), 3) AS estimated_impact, 0.80::DOUBLE AS confidence,
  CASE WHEN ratio < 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM ext""")
def b6_oversample_advice(spark, sf):
    return RC.oversample(TB.dq_dirty(spark, sf), "target").select(
        "rec_id", "cls", "target_count", "estimated_impact", "confidence", "risk")


@register("b7_undersample_advice", f"""WITH {TB.sql_ctes('dq_dirty')}, {_CLS}, {_BAL}
SELECT 2 AS rec_id, CAST(max_cls AS VARCHAR) AS cls, (mn * 2)::BIGINT AS target_count,
  round(least(0.03 + (1 - ratio) * 0.08, 0.08), 3) AS estimated_impact, 0.75::DOUBLE AS confidence,
  'MEDIUM' AS risk FROM ext WHERE ratio < 0.5""")
def b7_undersample_advice(spark, sf):
    return RC.undersample(TB.dq_dirty(spark, sf), "target").select(
        "rec_id", "cls", "target_count", "estimated_impact", "confidence", "risk")


def _sev_cte():
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in TB.ORDERS_COLS)
    te = " + ".join(f"count(*) FILTER (WHERE {c} IS NOT NULL AND ({to_number(c, t)}) IS NULL)"
                    for c, t in ORD_FEATS if t)
    return (f"cc AS (SELECT count(*) AS n FROM orders_dirty WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus), "
            f"sev AS (SELECT least(1.0, ({miss}) / (greatest(count(*), 1) * 2.0) * 5.0) AS missing_severity, "
            f"(SELECT CASE WHEN count(*) >= 2 THEN 1.0 - min(n) / max(n) ELSE 0.0 END FROM cc) AS imbalance_severity, "
            f"least(1.0, ({te}) / (greatest(count(*), 1) * 2.0) * 10.0) AS type_severity, "
            f"greatest(0.0, 0.73 - 0.60) AS accuracy_gap FROM orders_dirty)")


def _severities(spark, sf):
    return DG.severities(TB.orders_dirty(spark, sf), "o_orderstatus", OK, None, 0.60, 0.73)


@register("b8_severities", f"""WITH {TB.sql_ctes('orders_dirty')}, {_sev_cte()}
SELECT {s6('missing_severity')} AS missing_severity, {s6('imbalance_severity')} AS imbalance_severity,
  {s6('type_severity')} AS type_severity, {s6('accuracy_gap')} AS accuracy_gap FROM sev""")
def b8_severities(spark, sf):
    return r6(_severities(spark, sf))


_RANK = ("rk AS (SELECT *, row_number() OVER (ORDER BY severity DESC, tie) AS rnk FROM ("
         "SELECT 'class imbalance' AS problem, imbalance_severity AS severity, 'query_balancer' AS specialist, 0 AS tie "
         "FROM sev UNION ALL SELECT 'missing values', missing_severity, 'query_cleaner', 1 FROM sev "
         "UNION ALL SELECT 'type errors', type_severity, 'query_cleaner', 2 FROM sev))")


@register("b9_rank_problems", f"""WITH {TB.sql_ctes('orders_dirty')}, {_sev_cte()}, {_RANK}
SELECT CAST(rnk AS INTEGER) AS rank, problem, {s6('severity')} AS severity,
  CASE WHEN severity < 0.05 THEN 'NONE' WHEN severity < 0.3 THEN 'LOW' WHEN severity < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END
  AS level, specialist FROM rk""")
def b9_rank_problems(spark, sf):
    return r6(DG.rank(_severities(spark, sf)))


@register("b10_action_plan", f"""WITH {TB.sql_ctes('orders_dirty')}, {_sev_cte()}, {_RANK},
steps AS (SELECT rnk AS ord, specialist || ' -> apply best recommendation' AS action FROM rk
          WHERE severity >= 0.1 AND rnk <= 3
  UNION ALL SELECT 10, 'validate (check accuracy improvement)'
  UNION ALL SELECT 11, CASE WHEN accuracy_gap < 0.02 THEN 'submit - you are very close to target'
                            ELSE 'Repeat if accuracy gap remains > 0.02, then submit' END FROM sev
  UNION ALL SELECT 13, CASE WHEN imbalance_severity > missing_severity AND imbalance_severity > 0.2
         THEN 'PRIORITY NOTE: Class imbalance is the dominant issue - fix this first.'
         WHEN missing_severity > 0.2 THEN 'PRIORITY NOTE: High missing-value rate - clean data before augmenting.' END
    FROM sev)
SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS step, action FROM steps WHERE action IS NOT NULL""")
def b10_action_plan(spark, sf):
    return DG.plan(_severities(spark, sf), budget_remaining=20)


@register("b11_check_fresh", f"SELECT rec_id, true AS fresh_before, false AS fresh_after FROM ({CLEAN_SQL})")
def b11_check_fresh(spark, sf):
    """Advice stamped on the dirty table is stale once a repair changed it."""
    d = TB.orders_dirty(spark, sf)
    recs = RC.stamp(RC.clean(d, "o_orderstatus", OK), d)
    a = RC.check_fresh(recs, d).select("rec_id", F.col("fresh").alias("fresh_before"))
    b = RC.check_fresh(recs, RP.dedupe(d)).select("rec_id", F.col("fresh").alias("fresh_after"))
    return a.join(b, "rec_id")


@register("b12_exclude_rejected", CLEAN_SQL.replace(
    "AS rec_id FROM u)", "AS rec_id FROM u WHERE NOT (action_type = 'fill_missing' AND "
                         "col_name IS NOT DISTINCT FROM 'o_custkey'))"))
def b12_exclude_rejected(spark, sf):
    rejected = spark.createDataFrame([("fill_missing", "o_custkey")], "action_type string, col_name string")
    return RC.clean(TB.orders_dirty(spark, sf), "o_orderstatus", OK, rejected=rejected).select("rec_id", "action_type", "col_name", "strategy", "estimated_impact",
                                             "confidence")


@register("x5_severity_label", f"""WITH {TB.sql_ctes('orders_dirty')}, {_sev_cte()}
SELECT s.name AS problem, CASE WHEN s.v < 0.05 THEN 'NONE' WHEN s.v < 0.3 THEN 'LOW' WHEN s.v < 0.6 THEN 'MEDIUM'
  ELSE 'HIGH' END AS level FROM sev, (SELECT 'missing' AS name, missing_severity AS v FROM sev UNION ALL
  SELECT 'imbalance', imbalance_severity FROM sev UNION ALL SELECT 'type', type_severity FROM sev) s""")
def x5_severity_label(spark, sf):
    from ...functions.expr import severity_label
    s = _severities(spark, sf)
    arr = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(c).alias("v")) for n, c in
                    (("missing", "missing_severity"), ("imbalance", "imbalance_severity"), ("type", "type_severity"))])
    return s.select(F.explode(arr).alias("p")).select("p.problem", severity_label("p.v").alias("level"))
