"""Readers for the driver tables and the derived fixtures (FIXTURES.md §4).

Every fixture is built twice from the same definition: lazily in Spark (what
the operators run on) and as DuckDB SQL CTEs (what the oracle runs on).  Both
pick faulty rows by ``row_number() over (order by md5(seed|tag|key), key)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inject

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MEMO: dict = {}


def _memo(spark, sf_dir, name, build):
    """Checkpointed fixtures are built once per session and directory."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


# --------------------------------------------------------------------------------------------
# Fixture definitions: (base columns, key columns, label, injection steps)
# --------------------------------------------------------------------------------------------

DQ = dict(keys=["doc_id"], label="target",
          steps=[("missing", dict(cols=["n_words", "n_lines"], frac=0.15)),
                 ("type_errors", dict(col="n_chars", frac=0.04)),
                 ("duplicates", dict(frac=0.05))])
ORDERS = dict(keys=["o_orderkey"], label="o_orderstatus",
              steps=[("missing", dict(cols=["o_totalprice", "o_custkey"], frac=0.15)),
                     ("type_errors", dict(col="o_totalprice", frac=0.04)),
                     ("duplicates", dict(frac=0.05))])
LINEITEM = dict(keys=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], label="l_returnflag",
                steps=[("missing", dict(cols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                        frac=0.10)),
                       ("outliers", dict(col="l_extendedprice", frac=0.03)),
                       ("cross_column", dict(a="l_quantity", b="l_discount", frac=0.02))])


def dq_train(spark, sf_dir) -> DataFrame:
    """labels ⋈ documents: doc_id, n_chars, n_words, n_lines (DOUBLE), target = quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    t = F.col("text")
    return lab.join(d, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("double").alias("n_words"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        F.col("quality").cast("int").alias("target"))


def dq_dirty(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "dq_dirty", lambda: inject.recipe(
        dq_train(spark, sf_dir), DQ["steps"], seed=SEED, keys=DQ["keys"]))


def orders_clean(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"),
                    "o_totalprice", "o_orderstatus")


def orders_dirty(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "orders_dirty", lambda: inject.recipe(
        orders_clean(spark, sf_dir), ORDERS["steps"], seed=SEED, keys=ORDERS["keys"]))


def lineitem_clean(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def lineitem_dirty(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "lineitem_dirty", lambda: inject.recipe(
        lineitem_clean(spark, sf_dir), LINEITEM["steps"], seed=SEED, keys=LINEITEM["keys"]))


RULES = [
    # col_name, expected_dtype, lo, hi, categories, nullable, expression
    ("l_quantity", "float64", 0.0, 60.0, None, True, None),
    ("l_extendedprice", "float64", 0.0, 200000.0, None, True, None),
    ("l_discount", "float64", 0.0, 0.1, None, True, None),
    ("l_tax", "float64", 0.0, 0.1, None, False, None),
    ("l_returnflag", "str", None, None, ["A", "N"], False, None),
    ("l_quantity>=l_discount", "rule", None, None, None, True, "l_quantity >= l_discount"),
]
RULES_SCHEMA = ("col_name string, expected_dtype string, lo double, hi double, categories array<string>, "
                "nullable boolean, expression string")


def lineitem_rules(spark) -> DataFrame:
    """Column rules for ``lineitem_dirty`` (configuration: one row per column)."""
    return spark.createDataFrame(RULES, RULES_SCHEMA)


# --------------------------------------------------------------------------------------------
# DuckDB mirror of the fixtures
# --------------------------------------------------------------------------------------------

def _h(tag: str, keys) -> str:
    return "md5(concat_ws('|', '%s', '%s', %s))" % (SEED, tag, ", ".join(keys))


def _rn(tag, keys, cols=None, partition: str = "") -> str:
    ties = list(keys) + [c for c in (cols or []) if c not in keys]
    part = f"PARTITION BY {partition} " if partition else ""
    return "row_number() OVER (%sORDER BY %s, %s)" % (part, _h(tag, keys),
                                                    ", ".join(f"{k} NULLS LAST" for k in ties))


def _recipe_sql(name: str, base_sql: str, cols: list[str], keys: list[str], steps) -> str:
    ctes = [f"{name}_0 AS ({base_sql})"]
    prev = f"{name}_0"
    for i, (step, kw) in enumerate(steps, 1):
        cur = f"{name}_{i}"
        n = f"(SELECT count(*) FROM {prev})"
        if step == "missing":
            sel = []
            for c in cols:
                if c in kw["cols"]:
                    sel.append(f"CASE WHEN {_rn('missing|' + c, keys, cols)} <= floor({n} * {kw['frac']}) "
                               f"THEN NULL ELSE {c} END AS {c}")
                else:
                    sel.append(c)
            ctes.append(f"{cur} AS (SELECT {', '.join(sel)} FROM {prev})")
        elif step == "type_errors":
            c0 = kw["col"]
            sel = [f"CASE WHEN {_rn('type|' + c0, keys, cols)} <= greatest(1, floor({n} * {kw['frac']})) "
                   f"THEN 'ERR' ELSE CAST({c0} AS VARCHAR) END AS {c0}" if c == c0 else c for c in cols]
            ctes.append(f"{cur} AS (SELECT {', '.join(sel)} FROM {prev})")
        elif step == "outliers":
            c0 = kw["col"]
            sign = f"(('0x' || substr({_h('sign|' + c0, keys)}, 1, 15))::BIGINT % 2)"
            sel = [f"CASE WHEN {_rn('outlier|' + c0, keys, cols)} <= greatest(1, floor({n} * {kw['frac']})) "
                   f"THEN CASE WHEN {sign} = 0 THEN 999.0 ELSE -999.0 END ELSE {c0} END AS {c0}"
                   if c == c0 else c for c in cols]
            ctes.append(f"{cur} AS (SELECT {', '.join(sel)} FROM {prev})")
        elif step == "cross_column":
            a, b = kw["a"], kw["b"]
            ctes.append(f"{cur}_r AS (SELECT *, {_rn('cross|' + a + '|' + b, keys, cols)} AS __r FROM {prev})")
            hit = (f"(__r <= greatest(1, floor({n} * {kw['frac']})) AND {a} IS NOT NULL AND {b} IS NOT NULL "
                   f"AND {a} >= {b})")
            sel = []
            for c in cols:
                if c == a:
                    sel.append(f"CASE WHEN {hit} THEN {b} - 1.0 ELSE {a} END AS {a}")
                elif c == b:
                    sel.append(f"CASE WHEN {hit} THEN {a} + 1.0 ELSE {b} END AS {b}")
                else:
                    sel.append(c)
            ctes.append(f"{cur} AS (SELECT {', '.join(sel)} FROM {cur}_r)")
        elif step == "duplicates":
            pool = f"{cur}_pool"
            ctes.append(f"{pool} AS (SELECT *, {_rn('dup-pool', keys, cols)} AS __rank FROM {prev})")
            draws = (f"SELECT i, (('0x' || substr(md5(concat_ws('|', '{SEED}', 'dup-draw', i)), 1, 15))::BIGINT "
                     f"% {n}) + 1 AS pick FROM (SELECT unnest(range(0, (SELECT greatest(1, floor(count(*) * "
                     f"{kw['frac']}))::BIGINT FROM {prev}))) AS i)")
            ctes.append(f"{cur}_draws AS ({draws})")
            cl = ", ".join(cols)
            pl = ", ".join(f"p.{c}" for c in cols)
            ctes.append(f"{cur} AS (SELECT {cl} FROM {prev} UNION ALL SELECT {pl} FROM {cur}_draws d "
                        f"JOIN {pool} p ON p.__rank = d.pick)")
        elif step == "imbalance":
            lab = kw["label"]
            cls = f"(SELECT min({lab}) FROM {prev})"
            rn = _rn("imbalance", keys, cols, partition=f"({lab} = {cls})")
            ctes.append(f"{cur} AS (SELECT {', '.join(cols)} FROM (SELECT *, {rn} AS __r FROM {prev}) "
                        f"WHERE {lab} IS NULL OR {lab} <> {cls} OR __r <= floor({n} * {kw['ratio']}))")
        else:
            raise ValueError(step)
        prev = cur
    ctes.append(f"{name} AS (SELECT * FROM {prev})")
    return ",\n".join(ctes)


DQ_TRAIN_SQL = ("SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, "
                "CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words, "
                "CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines, "
                "CAST(l.quality AS INTEGER) AS target FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
ORDERS_SQL = ("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, o_orderstatus "
              "FROM orders")
LINEITEM_SQL = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                "l_discount, l_tax, l_returnflag FROM lineitem")

DQ_COLS = ["doc_id", "n_chars", "n_words", "n_lines", "target"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag"]


def sql_ctes(*names: str) -> str:
    """CTE text defining the named fixtures for a DuckDB oracle query."""
    parts = []
    for n in names:
        if n == "dq_train":
            parts.append(f"dq_train AS ({DQ_TRAIN_SQL})")
        elif n == "dq_dirty":
            parts.append(_recipe_sql("dq_dirty", DQ_TRAIN_SQL, DQ_COLS, DQ["keys"], DQ["steps"]))
        elif n == "orders_clean":
            parts.append(f"orders_clean AS ({ORDERS_SQL})")
        elif n == "orders_dirty":
            parts.append(_recipe_sql("orders_dirty", ORDERS_SQL, ORDERS_COLS, ORDERS["keys"], ORDERS["steps"]))
        elif n == "lineitem_clean":
            parts.append(f"lineitem_clean AS ({LINEITEM_SQL})")
        elif n == "lineitem_dirty":
            parts.append(_recipe_sql("lineitem_dirty", LINEITEM_SQL, LINEITEM_COLS, LINEITEM["keys"],
                                     LINEITEM["steps"]))
        else:
            from . import trajectories
            parts.append(trajectories.sql_cte(n))
    return ",\n".join(parts)
