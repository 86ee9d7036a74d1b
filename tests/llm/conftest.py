import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """documents from a list of texts (ids 0..) or of (id, text[, source])."""

    def build(rows, parts=3):
        full = []
        for k, r in enumerate(rows):
            i, t, *s = (k, r) if r is None or isinstance(r, str) else r
            full.append((i, t, None, s[0] if s else "src0", None))
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return build


@pytest.fixture(scope="session")
def real():
    """(doc_id, text) of some whole documents of the small table."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


ODD = [None, "", "", " ", "\n\n", "a", "A", "é É", "x" * 30_000, "ab " * 9_000, "line\n" * 500, "\x00a\x00", "日本語 テキスト", "🙂 don't", "Same text here", "same TEXT here", "same text here"]


@pytest.fixture(scope="session")
def odd():
    return ODD
