import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *(T.StructField(n, T.StringType()) for n in ("score", "at", "row", "digest", "lang_pred", "toxicity", "component_id", "key", "order"))])
CLASH = ("x",) * 9

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of documents with columns whose names the operators use themselves."""
    def make(rows, lang=None):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *CLASH) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return {n: spark.read.parquet(f"{SAMPLE}/{n}.parquet") for n in ("documents", "labels", "embeddings", "pages")}
