import pytest

from awkward_rows import CLASHING, SCHEMA, awkward_rows


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(awkward_rows(), SCHEMA)
    return rows.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
