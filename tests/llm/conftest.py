import pytest
from pyspark.sql import types as T

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
def shared(spark, tmp_path_factory):
    """A checkpoint folder for the session, as a cluster would name one."""
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@pytest.fixture(scope="session")
def docs_of(spark, shared):
    """A table of documents from texts or (id, text) pairs, in several partitions."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def sentences():
    """Distinct sentences of invented words."""
    import random

    def make(seed, n_words):
        r = random.Random(seed)
        return " ".join("".join(r.choice("aeioubcdfgklmnprst") for _ in range(r.randint(2, 9))) for _ in range(n_words))

    return make


ODD = [None, "", " ", "\n\t ", "x", "é", "word", "a b", "😀 é z", "same line\n" * 3, "\x00 nul", "-" * 700]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty texts, white space only, single words, signs, repeats."""
    return list(ODD)
