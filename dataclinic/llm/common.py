"""Helpers shared by the corpus operators: shared tables, sizes, text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space and U+0009..U+000D).
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: what counts as one word, as a Java / DuckDB pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    return f"{base.rstrip('/')}/llm/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a parquet table in the shared folder: computed once,
    and later jobs survive the loss of any executor."""
    path = shared_folder(df.sparkSession)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text, native; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")

