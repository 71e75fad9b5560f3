import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd import odd_rows  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.fixture
def clash(odd):
    """The odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "key mark kept size pattern posterior copies class component set_id signature spans base terms node group chunk n_words start".split()
    return odd.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
