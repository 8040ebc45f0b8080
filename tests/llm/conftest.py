from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("row", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n_words", T.StringType())]
)


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text[, lang]) with extra columns of clashing names."""

    def make(rows, parts: int = 3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", f"row{i}", i, "x") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
