"""The corpus pipeline: documents in, byte-level BPE tokens of a clean, mixed corpus out.

Each stage calls one corpus operator, works on all that its predecessor kept, and
is written as Parquet before the next one reads it.

1. language_id     rejects texts without a language (``und``: null or no letter)
                   and those whose best language has under half of the text
2. exact_dedup     one row of each group of equal texts stays
3. near_dedup      one document of each group linked by n-gram Jaccard stays: the
                   smallest id, a row without an id only where no other has one;
                   rows that share an id are judged one by one
4. mix             documents repeat or leave by the sources' targets, in the order
                   of the curriculum
5. tokenize        byte-level BPE ids of every row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataclinic.llm.common import stored, table

#: A document stays if its best language has at least this share of it.
MIN_LANGUAGE_SHARE = 0.5
#: Near duplicates: words in a shingle and similarity in per cent.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from dataclinic.llm.language_mixture import language_mixture
    judged = language_mixture(docs, with_row=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from dataclinic.llm.exact_dedup import keep_one
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from dataclinic.llm.ngram_jaccard import one_of_each
    return one_of_each(docs, gram=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from dataclinic.llm.curriculum_mix import mixed_rows
    return mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from dataclinic.llm.byte_bpe import RANKS, byte_bpe
    # executors also hold what the earlier stages' Python workers took
    return byte_bpe(docs, P.path(RANKS), P.PATTERN, cache=200_000)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix),
          ("tokenize", tokenize)]

#: Language inference and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
