"""Trajectory rows: parsing (L1) and the fixed command vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parse_command

# Fixed values from the reference: the 12 valid commands, in their order.
VALID_COMMANDS = ["inspect_dataset", "inspect_model", "query_analyst",
                  "query_cleaner", "query_augmenter", "query_balancer", "query_validator",
                  "apply", "reject", "undo", "validate", "submit"]
# Queries that open a new recommendation session (analyst / validator do not).
SESSION_QUERIES = ["query_cleaner", "query_augmenter", "query_balancer"]
# Commands that cost two budget steps.
DOUBLE_COST = ["query_analyst", "query_validator"]


def is_valid_format(action) -> Column:
    """Text (stripped) starts with one of the 12 commands."""
    a = F.trim(F.col(action) if isinstance(action, str) else action)
    return reduce(lambda x, y: x | y, [a.startswith(c) for c in VALID_COMMANDS])


def parse(df: DataFrame, action: str = "action") -> DataFrame:
    """L1: (cmd, arg, valid_format) from the action text."""
    cmd, arg = parse_command(action)
    return df.withColumns({"cmd": cmd, "arg": arg, "valid_format": is_valid_format(action)})
