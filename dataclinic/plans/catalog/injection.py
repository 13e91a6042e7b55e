"""Family F (dirty-data injection) queries: each injector on a clean driver table."""

from __future__ import annotations

from ...operators import inject as I
from ...sources import tables as TB
from .. import recipes
from . import register

OK = ["o_orderkey"]
LK = TB.LINEITEM["keys"]


def _sql(name, base, cols, keys, steps, select="*"):
    return f"WITH {TB._recipe_sql(name, base, cols, keys, steps)}\nSELECT {select} FROM {name}"


@register("f1_inject_missing", _sql("t", TB.ORDERS_SQL, TB.ORDERS_COLS, OK,
                                    [("missing", dict(cols=["o_totalprice", "o_custkey"], frac=0.15))]))
def f1_inject_missing(spark, sf):
    return I.inject_missing(TB.orders_clean(spark, sf), ["o_totalprice", "o_custkey"], 0.15, 42, OK)


@register("f2_inject_duplicates", _sql("t", TB.ORDERS_SQL, TB.ORDERS_COLS, OK,
                                       [("duplicates", dict(frac=0.05))]))
def f2_inject_duplicates(spark, sf):
    return I.inject_duplicates(TB.orders_clean(spark, sf), 0.05, 42, OK)


@register("f3_inject_imbalance", _sql("t", TB.ORDERS_SQL, TB.ORDERS_COLS, OK,
                                      [("imbalance", dict(label="o_orderstatus", ratio=0.30))]))
def f3_inject_imbalance(spark, sf):
    return I.inject_imbalance(TB.orders_clean(spark, sf), "o_orderstatus", 0.30, None, 42, OK)


@register("f4_inject_type_errors", _sql("t", TB.ORDERS_SQL, TB.ORDERS_COLS, OK,
                                        [("type_errors", dict(col="o_totalprice", frac=0.04))]))
def f4_inject_type_errors(spark, sf):
    return I.inject_type_errors(TB.orders_clean(spark, sf), "o_totalprice", 0.04, 42, OK)


@register("f5_inject_outliers", _sql("t", TB.LINEITEM_SQL, TB.LINEITEM_COLS, LK,
                                     [("outliers", dict(col="l_extendedprice", frac=0.03))]))
def f5_inject_outliers(spark, sf):
    return I.inject_outliers(TB.lineitem_clean(spark, sf), "l_extendedprice", 0.03, 42, LK)


@register("f6_inject_cross_column", _sql("t", TB.LINEITEM_SQL, TB.LINEITEM_COLS, LK,
                                         [("cross_column", dict(a="l_quantity", b="l_discount", frac=0.02))]))
def f6_inject_cross_column(spark, sf):
    return I.inject_cross_column(TB.lineitem_clean(spark, sf), "l_quantity", "l_discount", 0.02, 42, LK)


_HARD = recipes.task_recipe("task_3_hard", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                            label="l_returnflag")


@register("f7_task_recipe", _sql("t", TB.LINEITEM_SQL, TB.LINEITEM_COLS, LK, _HARD))
def f7_task_recipe(spark, sf):
    return I.recipe(TB.lineitem_clean(spark, sf), _HARD, seed=42, keys=LK)
