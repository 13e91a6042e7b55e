import pytest


@pytest.fixture()
def as_docs(spark):
    """Rows (doc_id, text, ...) -> DataFrame with clashing extra columns."""
    def make(rows, extra=True):
        d = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            from pyspark.sql import functions as F
            d = d.withColumns({c: F.lit("x") for c in ("block", "kind", "n", "h", "bits", "size", "target", "norm")})
        return d
    return make
