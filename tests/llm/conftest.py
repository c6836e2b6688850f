import pytest
from awkward_texts import AWKWARD, awkward_texts


@pytest.fixture(scope="session")
def awkward(spark):
    langs = ["en", "fr", None]
    rows = [(i, t, langs[k % 3], f"src{k % 2}" if k % 5 else None, None if t is None else len(t), "r", "t", k, "h", 1, "g", "k", 0.5, "s", 2, "y")
            for k, (i, t) in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, AWKWARD).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], AWKWARD)
