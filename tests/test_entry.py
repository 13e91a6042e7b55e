"""The driver contract: entry() runs on sf0.001 with a stable schema."""

import __spark_entry__ as E


def test_entry_schema_and_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["stage", "wc_rows", "wc_missing", "wc_dups", "quality"]
    rows = {r["stage"]: r for r in df.collect()}
    assert set(rows) == {"before", "after_top2"}
    assert rows["after_top2"]["quality"] >= rows["before"]["quality"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
