import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts (or full rows), with an extra column whose name clashes with nothing the operators may assume."""

    def build(texts, langs=None, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("x")).withColumn("size", F.lit(1)).withColumn("rank", F.lit(None).cast("int")).withColumn("h", F.lit(0))

    return build


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return words
