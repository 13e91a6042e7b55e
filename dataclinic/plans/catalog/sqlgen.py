"""Small helpers that write the DuckDB side of the oracle."""

from __future__ import annotations

from ...functions.expr import NUMERIC_PATTERN


def to_number(col: str, is_text: bool) -> str:
    if is_text:
        return (f"CASE WHEN regexp_matches(trim({col}), '{NUMERIC_PATTERN}') "
                f"THEN TRY_CAST(trim({col}) AS DOUBLE) END")
    return f"CASE WHEN isnan(CAST({col} AS DOUBLE)) THEN NULL ELSE CAST({col} AS DOUBLE) END"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
