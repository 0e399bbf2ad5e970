import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.01"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text, lang, source) rows; missing values are null."""

    def make(rows, partitions=3):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        return spark.createDataFrame([r + (None if r[1] is None else len(r[1]),) for r in full], DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
