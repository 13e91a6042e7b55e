"""Family C (repair transforms) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions.expr import to_number as tn
from ...operators import profile as P
from ...operators import quality as Q
from ...operators import recommend as RC
from ...operators import repair as RP
from ...operators.versions import ChangeLog, VersionedTable
from ...sources import tables as TB
from .. import auto_repair
from ...session import cut_lineage, ensure_checkpoint_dir
from . import register
from .common import r6
from .profiling import ORD_FEATS, _stats_cte
from .quality import _quality_sql
from .sqlgen import r6 as s6, to_number

LK = TB.LINEITEM["keys"]
OK = ["o_orderkey"]


def _num_out(df):
    """Output view with every text feature coerced back to a number (engines print doubles differently)."""
    return r6(df.select(*[tn(f.name, f.dataType).alias(f.name) if f.dataType.simpleString() == "string"
                          and f.name not in ("o_orderstatus", "l_returnflag") else F.col(f.name)
                          for f in df.schema.fields]))


@register("c1_fill_missing", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT {', '.join(LK)}, {s6("coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem_dirty))")}
  AS l_quantity FROM lineitem_dirty""")
def c1_fill_missing(spark, sf):
    d = RP.fill_missing(TB.lineitem_dirty(spark, sf), "l_quantity", "median")
    return r6(d.select(*LK, "l_quantity"))


DEDUPED_SQL = f"WITH {TB.sql_ctes('orders_dirty')}\nSELECT DISTINCT * FROM orders_dirty"


@register("c2_dedupe", DEDUPED_SQL)
def c2_dedupe(spark, sf):
    return RP.dedupe(TB.orders_dirty(spark, sf))


_TP = to_number("o_totalprice", True)


@register("c3_fix_types", f"""WITH {TB.sql_ctes('orders_dirty')}
SELECT o_orderkey, o_custkey, {s6(f"coalesce({_TP}, (SELECT avg({_TP}) FROM orders_dirty))")} AS o_totalprice,
  o_orderstatus FROM orders_dirty""")
def c3_fix_types(spark, sf):
    return r6(RP.fix_types(TB.orders_dirty(spark, sf), "o_totalprice"))


def _draw_sql(cls, k_sql, tag):
    ties = ", ".join(f"{c} NULLS LAST" for c in TB.DQ_COLS)
    return (f"part AS (SELECT * FROM dq_dirty WHERE target = {cls}), "
            f"pool AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '{tag}', doc_id)), {ties}) AS rk "
            f"FROM part), draws AS (SELECT (('0x' || substr(md5(concat_ws('|', '42', '{tag}-draw', i)), 1, 15))::BIGINT "
            f"% (SELECT count(*) FROM part)) + 1 AS pick FROM (SELECT unnest(range(0, ({k_sql})::BIGINT)) AS i)), "
            f"drawn AS (SELECT {', '.join('p.' + c for c in TB.DQ_COLS)} FROM draws d JOIN pool p ON p.rk = d.pick)")


_NC = to_number("n_chars", True)
_DQ_OUT = f"doc_id, {s6(_NC)} AS n_chars, {s6('n_words')} AS n_words, {s6('n_lines')} AS n_lines, target"


@register("c4_augment_class", f"""WITH {TB.sql_ctes('dq_dirty')}, {_draw_sql(0, '50', 'augment')},
sd AS (SELECT coalesce(stddev_samp({_NC}), 0.0) AS s1, coalesce(stddev_samp(n_words), 0.0) AS s2,
  coalesce(stddev_samp(n_lines), 0.0) AS s3 FROM drawn),
synth AS (SELECT doc_id, CAST({_NC} + 0.1 * s1 AS VARCHAR) AS n_chars, n_words + 0.1 * s2 AS n_words,
  n_lines + 0.1 * s3 AS n_lines, target FROM drawn, sd),
u AS (SELECT * FROM dq_dirty UNION ALL SELECT * FROM synth)
SELECT {_DQ_OUT} FROM u""")
def c4_augment_class(spark, sf):
    return _num_out(RP.augment_class(TB.dq_dirty(spark, sf), "target", 0, 50, 42, ["doc_id"]))


def _count(df, label, cls):
    return df.where(F.col(label) == cls).count()


@register("c5_oversample", f"""WITH {TB.sql_ctes('dq_dirty')},
{_draw_sql(0, "greatest(0, (SELECT count(*) FROM dq_dirty WHERE target = 1) - "
              "(SELECT count(*) FROM dq_dirty WHERE target = 0))", 'oversample')},
u AS (SELECT * FROM dq_dirty UNION ALL SELECT * FROM drawn)
SELECT {_DQ_OUT} FROM u""")
def c5_oversample(spark, sf):
    d = TB.dq_dirty(spark, sf)
    return _num_out(RP.oversample(d, "target", 0, _count(d, "target", 1), 42, ["doc_id"]))


@register("c5_oversample_split", f"""WITH {TB.sql_ctes('dq_dirty')}
SELECT greatest((SELECT count(*) FROM dq_dirty WHERE target = 0), (SELECT count(*) FROM dq_dirty WHERE target = 1))::BIGINT AS n_class,
  (SELECT count(*) FROM dq_dirty WHERE target IS NULL OR target <> 0)::BIGINT AS n_other, 0::BIGINT AS n_unknown""")
def c5_oversample_split(spark, sf):
    """Draws as counts per row: the class reaches the majority's size exactly, with copies of its own rows only."""
    d = TB.dq_dirty(spark, sf)
    out = cut_lineage(RP.oversample(d, "target", 0, _count(d, "target", 1), 42, ["doc_id"], mode="split"))
    new = out.exceptAll(d).join(d, [out[c].eqNullSafe(d[c]) for c in d.columns], "left_anti")
    mine = F.coalesce(F.col("target") == 0, F.lit(False))
    return out.agg(F.count(F.when(mine, 1)).alias("n_class"), F.count(F.when(~mine, 1)).alias("n_other")).crossJoin(
        new.agg(F.count(F.lit(1)).alias("n_unknown")))


@register("c6_undersample", f"""WITH {TB.sql_ctes('dq_dirty')},
r AS (SELECT *, row_number() OVER (PARTITION BY target = 1 ORDER BY md5(concat_ws('|', '42', 'undersample', doc_id)),
  {', '.join(c + ' NULLS LAST' for c in TB.DQ_COLS)}) AS rk FROM dq_dirty)
SELECT {_DQ_OUT} FROM r WHERE target IS NULL OR target <> 1
  OR rk <= 2 * (SELECT count(*) FROM dq_dirty WHERE target = 0)""")
def c6_undersample(spark, sf):
    d = TB.dq_dirty(spark, sf)
    return _num_out(RP.undersample(d, "target", 1, 2 * _count(d, "target", 0), 42, ["doc_id"]))


@register("c7_trim_low", f"""WITH {TB.sql_ctes('lineitem_dirty')}
SELECT * FROM lineitem_dirty
WHERE l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.05) FROM lineitem_dirty)""")
def c7_trim_low(spark, sf):
    return RP.trim_low(TB.lineitem_dirty(spark, sf), "l_extendedprice", 5)


def _c8_sql():
    miss = lambda t: " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in TB.ORDERS_COLS) + f" FROM {t}"  # noqa
    dups = lambda t: f"count(*) - count(DISTINCT ({', '.join(TB.ORDERS_COLS)})) FROM {t}"  # noqa
    st = _stats_cte("orders_dirty", ORD_FEATS)
    fv = lambda c: (f"(SELECT CASE WHEN abs(skew) > 0.5 THEN median ELSE mean END FROM st2 "  # noqa
                    f"WHERE col_name = '{c}')")
    return f"""WITH {TB.sql_ctes('orders_dirty')}, {st},
a AS (SELECT o_orderkey, coalesce(o_custkey, {fv('o_custkey')}) AS o_custkey,
  coalesce({_TP}, {fv('o_totalprice')}) AS o_totalprice, o_orderstatus FROM orders_dirty),
n AS (SELECT count(*) AS o FROM orders_dirty)
SELECT 'missing' AS metric, (SELECT {miss('orders_dirty')})::BIGINT AS before, (SELECT {miss('a')})::BIGINT AS after,
  {s6(f"(SELECT {miss('a')}) / o")} AS after_frac_of_original FROM n
UNION ALL SELECT 'duplicates', (SELECT {dups('orders_dirty')})::BIGINT, (SELECT {dups('a')})::BIGINT,
  {s6(f"(SELECT {dups('a')}) / o")} FROM n
UNION ALL SELECT 'rows', o::BIGINT, (SELECT count(*) FROM a)::BIGINT, {s6('(SELECT count(*) FROM a) / o')} FROM n"""


@register("c8_apply_top2", _c8_sql())
def c8_apply_top2(spark, sf):
    d = TB.orders_dirty(spark, sf)
    recs = RC.clean(d, "o_orderstatus", OK)
    after = cut_lineage(auto_repair.apply_top(d, recs, 2, "o_orderstatus", OK))
    return r6(RP.health_report(d, after, d.agg(F.count(F.lit(1)).alias("original_rows"))))


@register("c9_undo", DEDUPED_SQL)
def c9_undo(spark, sf):
    """apply dedupe, apply a fill, undo: the current version equals the dedupe result."""
    vt = VersionedTable(TB.orders_dirty(spark, sf))
    vt.apply(RP.dedupe)
    vt.apply(RP.fill_missing, "o_custkey", "mean")
    assert vt.undo()
    return vt.current


def _log(spark, sf):
    """A change log of the dirty orders with two applies: dedupe, then a fill."""
    log = ChangeLog.create(TB.orders_dirty(spark, sf), f"{ensure_checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex}")
    yield log
    log.apply(RP.dedupe)
    yield log
    log.apply(RP.fill_missing, "o_custkey", "mean")
    yield log


@register("c9_undo_log", DEDUPED_SQL)
def c9_undo_log(spark, sf):
    """The change log opened anew after two applies and undone once: the dedupe result."""
    *_, log = _log(spark, sf)
    again = ChangeLog.open(spark, log.path)
    assert again.undo() and ChangeLog.open(spark, log.path).snapshots == 1
    return ChangeLog.open(spark, log.path).read()


@register("c9_change_rows", f"""WITH {TB.sql_ctes('orders_dirty')},
d AS (SELECT {', '.join(TB.ORDERS_COLS)}, count(*) AS c FROM orders_dirty GROUP BY ALL)
SELECT 1 AS version, count(*) FILTER (WHERE c > 1)::BIGINT AS n_stored, count(*)::BIGINT AS n_rows FROM d
UNION ALL SELECT 2, 2 * count(*) FILTER (WHERE o_custkey IS NULL), count(*) FROM d""")
def c9_change_rows(spark, sf):
    """Rows that a version stores: those that its repair changed, before and after."""
    out = None
    for v, log in enumerate(_log(spark, sf)):
        if v:
            one = log.changes().agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n_stored")).crossJoin(
                log.read().agg(F.count(F.lit(1)).alias("n_rows")))
            out = one if out is None else out.unionByName(one)
    return out


_KEPT = ["o_custkey", "o_totalprice"]


@register("d8_kept_counts", f"""WITH {TB.sql_ctes('orders_dirty', 'orders_clean')}, deduped AS (SELECT DISTINCT * FROM orders_dirty),
filled AS (SELECT o_orderkey, coalesce(o_custkey, (SELECT avg(o_custkey) FROM deduped)) AS o_custkey, o_totalprice, o_orderstatus
  FROM deduped), {_quality_sql('orders_dirty', 'a')}, {_quality_sql('deduped', 'b')}, {_quality_sql('filled', 'c')}
SELECT 0 AS version, wr::BIGINT AS n_rows, wm::BIGINT AS n_missing, wd::BIGINT AS n_duplicates, {s6('quality')} AS quality FROM qa
UNION ALL SELECT 1, wr, wm, wd, {s6('quality')} FROM qb UNION ALL SELECT 2, wr, wm, wd, {s6('quality')} FROM qc""")
def d8_kept_counts(spark, sf):
    """Counts and quality after each repair, kept from the changed rows only."""
    out = counts = None
    gt = P.duplicates(TB.orders_clean(spark, sf)).first()["n_duplicates"]
    for v, log in enumerate(_log(spark, sf)):
        if v == 0:
            counts = cut_lineage(Q.kept_counts(log.read(), _KEPT))
            first = counts.first()
        else:
            counts = cut_lineage(Q.updated_counts(counts, log.changes(), _KEPT))
        q = Q.score_counts(counts, _KEPT, gt, first["n_rows"], first["n_missing"])
        one = q.select(F.lit(v).alias("version"), F.col("wc_rows").alias("n_rows"), F.col("wc_missing").alias("n_missing"),
                       F.col("wc_dups").alias("n_duplicates"), "quality")
        out = one if out is None else out.unionByName(one)
    return r6(out)


@register("c10_repair_path", f"""WITH {TB.sql_ctes('dq_dirty')}
SELECT count(*)::BIGINT AS n_start, true AS starts_with_inspect, true AS two_repairs_first, true AS ends_validated,
  true AS cleaning_never_lowers_quality, true AS accuracies_in_range FROM dq_dirty""")
def c10_repair_path(spark, sf):
    """The stages of the automatic repair and what must hold of them."""
    s = cut_lineage(auto_repair.auto_repair(spark, sf)).orderBy("step").collect()  # a row a stage
    q = [r["quality"] for r in s if r["stage"] in ("inspect",) or r["stage"].startswith("apply ")][:3]
    acc = [r[c] for r in s if r["stage"] == "validate" for c in ("rf_accuracy", "lr_accuracy")]
    row = (s[0]["n_rows"], s[0]["stage"] == "inspect", all(r["stage"].startswith("apply ") for r in s[1:3]),
           s[-1]["stage"] == "validate", q == sorted(q), bool(acc) and all(0.0 <= a <= 1.0 for a in acc))
    return spark.createDataFrame([row], "n_start bigint, starts_with_inspect boolean, two_repairs_first boolean, "
                                        "ends_validated boolean, cleaning_never_lowers_quality boolean, accuracies_in_range boolean")


@register("c10_auto_repair")
def c10_auto_repair(spark, sf):
    """Heuristic plan inspect -> clean -> apply 1, 2 -> validate -> balance -> apply 1 -> validate
    (MLlib fits: rows-only check)."""
    return auto_repair.auto_repair(spark, sf)
