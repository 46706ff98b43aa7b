import pytest
from sitegrain.plans.staging import Staging

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def stage(spark):
    s = Staging(spark, "test")
    yield s
    s.release()


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source)."""

    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The documents of the small data as plain rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
