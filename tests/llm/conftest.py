import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text, source) rows."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)
    return make


@pytest.fixture
def as_dir(tmp_path):
    """Write tables as Parquet and give their folder, as a query's sf_dir."""
    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make
