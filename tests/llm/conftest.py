import pytest
from llm_rows import CLASHING, FULL, odd_rows, prose_texts
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@pytest.fixture
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(prose_texts()), FULL)


@pytest.fixture
def clashing(odd: DataFrame) -> DataFrame:
    return odd.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FULL)


@pytest.fixture
def labels(spark: SparkSession) -> DataFrame:
    rows = [(i, i % 3 and 1, int(i % 4 == 0)) for i in range(12)] + [(None, 1, 1), (100, None, None), (101, 1, 0), (3, 0, 1), (105, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
