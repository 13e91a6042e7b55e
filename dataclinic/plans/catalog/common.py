"""Spark-side helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.expr import round_to


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (oracle compares rounded values)."""
    return df.select(*[round_to(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
