import pytest
from messy_rows import CLASHES, SCHEMA, messy_rows


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(k, t, None if i % 3 else "en", *[None if i % 2 else "mine"] * len(CLASHES)) for i, (k, t) in enumerate(messy_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 10 == 1)) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
