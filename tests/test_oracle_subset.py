"""A subset of the driver's correctness gate at sf0.001: Spark result == DuckDB oracle."""

import duckdb
import pytest

from dataclinic.plans.catalog import load_all
from dataclinic.sources.tables import TABLES
from tools.oracle_check import _rows

NAMES = ["a1_missing", "a6_numeric_stats", "f7_task_recipe", "b4_clean", "c4_augment_class", "c8_apply_top2",
         "d7_quality_score", "e3_stratified_split", "g2_process_rubric", "h1_cooldown", "h2_apply_limits",
         "r2_adaptive_rolling", "r10_curriculum_replay_w5", "r13_compare_agents", "s2_prompt", "io2_normalize"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, con, name):
    q, o = load_all()
    sdf = q[name](spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(o[name])
    orows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, srows) == _rows(rel.columns, orows)


def test_every_query_has_a_callable_and_most_have_oracles():
    q, o = load_all()
    assert set(o) <= set(q)
    assert len(q) >= 110 and len(o) >= 100
