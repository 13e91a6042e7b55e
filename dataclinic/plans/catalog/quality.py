"""Family D (validation, drift, quality, integrity) and V2 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import drift as DR
from ...operators import integrity as IG
from ...operators import profile as P
from ...operators import quality as Q
from ...operators import repair as RP
from ...operators import validate as V
from ...sources import tables as TB
from . import register
from .common import r6
from .profiling import LI_FEATS, ORD_FEATS, stats_sql
from .sqlgen import r6 as s6, to_number, union_all

LK = TB.LINEITEM["keys"]


# --- D1 ----------------------------------------------------------------------------------------
def _d1_sql():
    parts = []
    for c, txt in ORD_FEATS:
        x = to_number(c, txt)
        parts.append(f"SELECT '{c}' AS col_name, 'dtype=float64' AS rule, cnt::BIGINT AS count, "
                     f"{s6('cnt * 100.0 / n')} AS pct, CASE WHEN cnt * 100.0 / n > 10 THEN 'CRITICAL' "
                     f"ELSE 'WARNING' END AS severity FROM (SELECT count(*) FILTER (WHERE {c} IS NOT NULL AND "
                     f"({x}) IS NULL) AS cnt, count(*) AS n FROM orders_dirty) WHERE cnt > 0")
    return f"WITH {TB.sql_ctes('orders_dirty')}\n" + union_all(parts)


@register("d1_dtype_rule", _d1_sql())
def d1_dtype_rule(spark, sf):
    v = V.dtype_rule(TB.orders_dirty(spark, sf), None, "o_orderstatus", ["o_orderkey"])
    return r6(v.select("col_name", "rule", "count", "pct", "severity"))


# --- D2 ----------------------------------------------------------------------------------------
def _d2_sql():
    parts = []
    for (c, dt, lo, hi, cats, nullable, e) in TB.RULES:
        if lo is None:
            continue
        parts.append(
            f"SELECT '{c}' AS col_name, 'range=[{float(lo)},{float(hi)}]' AS rule, cnt::BIGINT AS count, "
            f"{s6('mn')} AS observed_min, {s6('mx')} AS observed_max, {s6('z')} AS max_z, "
            f"CASE WHEN z > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM ("
            f"SELECT count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS cnt, min({c}) AS mn, max({c}) AS mx, "
            f"abs(max({c}) - avg({c})) / CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 1.0 "
            f"ELSE stddev_samp({c}) END AS z FROM lineitem_dirty) WHERE cnt > 0")
    return f"WITH {TB.sql_ctes('lineitem_dirty')}\n" + union_all(parts)


@register("d2_range_rule", _d2_sql())
def d2_range_rule(spark, sf):
    v = V.range_rule(TB.lineitem_dirty(spark, sf), TB.lineitem_rules(spark), "l_returnflag", LK)
    return r6(v.select("col_name", "rule", "count", "observed_min", "observed_max", "max_z", "severity"))


# --- D3 ----------------------------------------------------------------------------------------
@register("d3_category_rule", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT * FROM (SELECT 'l_returnflag' AS col_name, 'categories' AS rule,
  count(*) FILTER (WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A', 'N'))::BIGINT AS count
  FROM lineitem_dirty) WHERE count > 0""")
def d3_category_rule(spark, sf):
    v = V.category_rule(TB.lineitem_dirty(spark, sf), TB.lineitem_rules(spark), "l_returnflag", LK)
    return v.select("col_name", "rule", "count")


@register("d3_not_null_rule", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT * FROM (SELECT 'l_tax' AS col_name, 'not_null' AS rule,
  count(*) FILTER (WHERE l_tax IS NULL)::BIGINT AS count FROM lineitem_dirty
  UNION ALL SELECT 'l_returnflag', 'not_null', count(*) FILTER (WHERE l_returnflag IS NULL)::BIGINT
  FROM lineitem_dirty) WHERE count > 0""")
def d3_not_null_rule(spark, sf):
    v = V.not_null_rule(TB.lineitem_dirty(spark, sf), TB.lineitem_rules(spark), "l_returnflag", LK)
    return v.select("col_name", "rule", "count")


# --- D4 ----------------------------------------------------------------------------------------
@register("d4_expression_rule", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT * FROM (SELECT 'l_quantity>=l_discount' AS col_name, 'expr: l_quantity >= l_discount' AS rule,
  count(*) FILTER (WHERE NOT (l_quantity >= l_discount))::BIGINT AS count FROM lineitem_dirty) WHERE count > 0""")
def d4_expression_rule(spark, sf):
    v = V.expression_rule(TB.lineitem_dirty(spark, sf), TB.lineitem_rules(spark), "l_returnflag", LK)
    return v.select("col_name", "rule", "count")


# --- D5 / D6 -----------------------------------------------------------------------------------
def _drift_cte():
    return (f"w AS ({stats_sql('lineitem_dirty', LI_FEATS)}), t AS ({stats_sql('lineitem_clean', LI_FEATS)}), "
            f"dr AS (SELECT w.col_name, w.pos, CASE WHEN w.n > 0 AND t.n > 0 THEN round(abs(w.mean - t.mean) / "
            f"(t.std + 1e-8) + abs(1.0 - w.std / (t.std + 1e-8)), 3) ELSE 0.0 END AS drift "
            f"FROM w LEFT JOIN t ON w.col_name = t.col_name)")


@register("d5_drift", f"""WITH {TB.sql_ctes('lineitem_dirty', 'lineitem_clean')}, {_drift_cte()}
SELECT col_name, pos, drift FROM dr""")
def d5_drift(spark, sf):
    return DR.compute(TB.lineitem_dirty(spark, sf), TB.lineitem_clean(spark, sf), "l_returnflag", LK)


@register("d6_drift_top", f"""WITH {TB.sql_ctes('lineitem_dirty', 'lineitem_clean')}, {_drift_cte()}
SELECT col_name, drift, CASE WHEN drift < 0.2 THEN 'NONE' WHEN drift < 0.5 THEN 'LOW' WHEN drift < 1.0 THEN 'MEDIUM'
  ELSE 'HIGH' END AS level FROM dr ORDER BY drift DESC, pos LIMIT 5""")
def d6_drift_top(spark, sf):
    return DR.top(DR.compute(TB.lineitem_dirty(spark, sf), TB.lineitem_clean(spark, sf), "l_returnflag", LK))


# --- D7 / D8 -----------------------------------------------------------------------------------
def _quality_sql(work: str, tag: str) -> str:
    cols = ", ".join(TB.ORDERS_COLS)
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in TB.ORDERS_COLS)
    te = " + ".join(
        f"CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND ({to_number(c, t)}) IS NULL) = 0 THEN 1 ELSE 0 END"
        for c, t in ORD_FEATS)
    return (f"q{tag} AS (SELECT *, round(least(0.4 * ms + 0.2 * ds + 0.2 * ts + 0.2 * rs, 1.0), 4) AS quality FROM ("
            f"SELECT greatest(0.0, 1.0 - wm / CASE WHEN im > 0 THEN im ELSE greatest(wm, 1) END) AS ms, "
            f"CASE WHEN gd = 0 AND wd = 0 THEN 1.0 WHEN gd = 0 THEN greatest(0.0, 1.0 - wd / greatest(wr, 1)) "
            f"ELSE greatest(0.0, 1.0 - wd / greatest(gd, 1)) END AS ds, tok / {len(ORD_FEATS)}.0 AS ts, "
            f"least(wr / greatest(orig, 1), 1.0) AS rs, wm, wd, gd, tok, wr, orig FROM ("
            f"SELECT (SELECT {miss} FROM {work}) AS wm, (SELECT {miss} FROM orders_dirty) AS im, "
            f"(SELECT count(*) - count(DISTINCT ({cols})) FROM {work}) AS wd, "
            f"(SELECT count(*) - count(DISTINCT ({cols})) FROM orders_clean) AS gd, "
            f"(SELECT {te} FROM {work}) AS tok, (SELECT count(*) FROM {work}) AS wr, "
            f"(SELECT count(*) FROM orders_dirty) AS orig)))")


def _fill_sql():
    return ("filled AS (SELECT o_orderkey, coalesce(o_custkey, (SELECT avg(o_custkey) FROM orders_dirty)) "
            "AS o_custkey, o_totalprice, o_orderstatus FROM orders_dirty)")


@register("d7_quality_score", f"""WITH {TB.sql_ctes('orders_dirty', 'orders_clean')}, {_fill_sql()},
{_quality_sql('filled', 'w')}
SELECT wm::BIGINT AS wc_missing, wd::BIGINT AS wc_dups, gd::BIGINT AS gt_dups, {s6('ms')} AS missing_score,
  {s6('ds')} AS dup_score, {s6('ts')} AS type_score, {s6('rs')} AS rows_score, {s6('quality')} AS quality FROM qw""")
def d7_quality_score(spark, sf):
    d = TB.orders_dirty(spark, sf)
    work = RP.fill_missing(d, "o_custkey", "mean")
    init = P.total_missing(d).select(F.col("total_missing").alias("initial_missing"))
    orig = d.agg(F.count(F.lit(1)).alias("original_rows"))
    c = Q.components(work, TB.orders_clean(spark, sf), orig, "o_orderstatus", ["o_orderkey"], None, init)
    return r6(c.select("wc_missing", "wc_dups", "gt_dups", "missing_score", "dup_score", "type_score",
                       "rows_score", "quality"))


@register("d8_quality_delta", f"""WITH {TB.sql_ctes('orders_dirty', 'orders_clean')},
deduped AS (SELECT DISTINCT * FROM orders_dirty), {_quality_sql('orders_dirty', 'b')}, {_quality_sql('deduped', 'a')}
SELECT {s6('qb.quality')} AS q_before, {s6('qa.quality')} AS q_after, {s6('round(qa.quality - qb.quality, 4)')} AS delta
FROM qb, qa""")
def d8_quality_delta(spark, sf):
    d = TB.orders_dirty(spark, sf)
    init = P.total_missing(d).select(F.col("total_missing").alias("initial_missing"))
    orig = d.agg(F.count(F.lit(1)).alias("original_rows"))
    return r6(Q.delta(d, RP.dedupe(d), TB.orders_clean(spark, sf), orig, "o_orderstatus", ["o_orderkey"], None, init))


# --- D9 / D10 / V2 -----------------------------------------------------------------------------
@register("d9_assert_unchanged", """SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM orders)::BIGINT AS rec_rows,
  true AS count_ok, true AS content_ok, 'same' AS case_name FROM orders
UNION ALL SELECT count(*), count(*), true, false, 'one value changed' FROM orders
UNION ALL SELECT count(*) - 1, count(*), false, false, 'one row gone' FROM orders""")
def d9_assert_unchanged(spark, sf):
    truth = TB.orders_clean(spark, sf)
    rec = IG.fingerprint(TB.table(spark, sf, "orders").select(*truth.columns).withColumn(
        "o_custkey", F.col("o_custkey").cast("double")))
    first = truth.agg(F.min("o_orderkey").alias("__k"))
    d = truth.crossJoin(F.broadcast(first))  # one row
    edited = d.withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("__k"), F.col("o_totalprice") + 1)
                          .otherwise(F.col("o_totalprice"))).select(*truth.columns)
    shorter = d.where(F.col("o_orderkey") != F.col("__k")).select(*truth.columns)
    out = None
    for name, t in (("same", truth), ("one value changed", edited), ("one row gone", shorter)):
        r = IG.assert_unchanged(t, rec).withColumn("case_name", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("n_rows", "rec_rows", "count_ok", "content_ok", "case_name")


@register("d10_data_loss", f"""WITH {TB.sql_ctes('orders_dirty')},
x AS (SELECT {to_number('o_totalprice', True)} AS v FROM orders_dirty),
kept AS (SELECT count(*) AS c FROM x WHERE v >= (SELECT quantile_cont(v, 0.6) FROM x))
SELECT c::BIGINT AS current_rows, (SELECT count(*) FROM orders_dirty)::BIGINT AS original_rows,
  {s6('c / (SELECT count(*) FROM orders_dirty)')} AS ratio, c / (SELECT count(*) FROM orders_dirty) < 0.5 AS catastrophic
FROM kept""")
def d10_data_loss(spark, sf):
    d = TB.orders_dirty(spark, sf)
    cur = RP.trim_low(d, "o_totalprice", 60)
    return r6(IG.data_loss(cur, d.agg(F.count(F.lit(1)).alias("original_rows"))))


@register("d9_changed_buckets", """SELECT substr(md5(concat_ws('|', 'bucket', o_orderkey)), 1, 4) AS bucket,
  count(*) FILTER (WHERE o_orderkey % 1499 <> 7)::BIGINT AS now_rows, count(*)::BIGINT AS then_rows FROM orders GROUP BY 1
HAVING bool_or(o_orderkey % 1499 = 7 OR o_orderkey % 997 = 5)""")
def d9_changed_buckets(spark, sf):
    """Where a truth table was edited: the leaves of the content tree that differ from the recorded ones."""
    truth = TB.orders_clean(spark, sf)
    edited = truth.where(F.col("o_orderkey") % 1499 != 7).withColumn("o_totalprice", F.when(
        F.col("o_orderkey") % 997 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return IG.changed_buckets(IG.content_tree(edited, ["o_orderkey"]), IG.content_tree(truth, ["o_orderkey"]))


@register("v2_fingerprint", f"""WITH {TB.sql_ctes('orders_dirty')}
SELECT count(*)::BIGINT AS n_rows, true AS order_free, true AS changed_after_edit FROM orders_dirty""")
def v2_fingerprint(spark, sf):
    """Order-free content hash: the same for another order, another one after an edit."""
    d = TB.orders_dirty(spark, sf)

    def sums(x, tag):
        return IG.fingerprint(x).select("n_rows", F.struct("hash_sum", "hash_xor").alias(f"h_{tag}"))

    other = sums(d.repartition(3, "o_totalprice"), "order").drop("n_rows")
    edited = sums(d.withColumn("o_custkey", F.col("o_custkey") + 1), "edit").drop("n_rows")
    return sums(d, "now").crossJoin(other).crossJoin(edited).select(
        "n_rows", (F.col("h_now") == F.col("h_order")).alias("order_free"),
        (F.col("h_now") != F.col("h_edit")).alias("changed_after_edit"))


@register("v2_null_moves", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT count(*) FILTER (WHERE (l_quantity IS NULL) <> (l_tax IS NULL))::BIGINT AS n_moved,
  count(*) FILTER (WHERE (l_quantity IS NULL) <> (l_tax IS NULL)) > 0 AS seen FROM lineitem_dirty""")
def v2_null_moves(spark, sf):
    """Values that change places with a NULL in their row change the fingerprint."""
    d = TB.lineitem_dirty(spark, sf)
    one = F.col("l_quantity").isNull() != F.col("l_tax").isNull()
    moved = d.select(*[F.when(one, F.col({"l_quantity": "l_tax", "l_tax": "l_quantity"}.get(c, c))).otherwise(F.col(c)).alias(c)
                       for c in d.columns])
    a = IG.fingerprint(d).select(F.struct("hash_sum", "hash_xor").alias("a"))
    b = IG.fingerprint(moved).select(F.struct("hash_sum", "hash_xor").alias("b"))
    n = d.agg(F.count(F.when(one, 1)).alias("n_moved"))
    return n.crossJoin(a).crossJoin(b).select("n_moved", (F.col("a") != F.col("b")).alias("seen"))


@register("v2_tree_update", f"""WITH {TB.sql_ctes('orders_dirty')}
SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_unlike, true AS root_is_fingerprint FROM orders_dirty""")
def v2_tree_update(spark, sf):
    """The content tree updated by the changed rows only equals a recount, and its root is the fingerprint."""
    d = TB.orders_dirty(spark, sf)
    hit = F.col("o_orderkey") % 97 == 3
    old = d.where(hit)
    new = old.withColumn("o_custkey", F.when(F.col("o_custkey").isNull(), F.lit(0.0)))
    edited = d.where(~hit).unionByName(new)
    tree = IG.update_tree(IG.content_tree(d, ["o_orderkey"]), old, new, ["o_orderkey"])
    unlike = IG.changed_buckets(tree, IG.content_tree(edited, ["o_orderkey"])).agg(F.count(F.lit(1)).alias("n_unlike"))
    root = IG.tree_root(tree).select(F.struct("n_rows", "hash_sum", "hash_xor").alias("r"))
    whole = IG.fingerprint(edited).select("n_rows", F.struct("n_rows", "hash_sum", "hash_xor").alias("w"))
    return whole.crossJoin(root).crossJoin(unlike).select("n_rows", "n_unlike", (F.col("r") == F.col("w")).alias("root_is_fingerprint"))


# --- X4 ----------------------------------------------------------------------------------------
@register("x4_drift_label", f"""WITH {TB.sql_ctes('lineitem_dirty', 'lineitem_clean')}, {_drift_cte()}
SELECT col_name, drift, CASE WHEN drift < 0.2 THEN 'NONE' WHEN drift < 0.5 THEN 'LOW' WHEN drift < 1.0 THEN 'MEDIUM'
  ELSE 'HIGH' END AS level FROM dr""")
def x4_drift_label(spark, sf):
    from ...functions.expr import drift_label
    d = DR.compute(TB.lineitem_dirty(spark, sf), TB.lineitem_clean(spark, sf), "l_returnflag", LK)
    return d.select("col_name", "drift", drift_label("drift").alias("level"))
