import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """(id, text[, lang[, source]]) rows -> a documents table, with columns whose
    names clash with those that the operators use inside."""
    def make(rows, extra=True):
        full = []
        for r in rows:
            i, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
            full.append((i, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS).repartition(2)
        if extra:
            df = df.selectExpr("*", "'x' as fp", "1 as row", "2 as key", "'y' as hits", "3 as token", "4 as h", "5 as part", "6 as spans", "7 as score")
        return df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977} thing{i % 13}" for i in range(60_000))
    return [(1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "a"), (None, "no id here at all", "en", "b"), (4, "same text twice over", "en", "a"),
            (4, "same text twice over", "en", "a"), (5, "same text twice over", "de", "c"), (6, long, "en", "a"), (7, "x", "en", None),
            (8, "12 34 !! ??", "en", "a"), (9, "漢字 und Straße ñandú é", "de", "b")]
