"""Small documents that hold every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("row", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), 0.5, "r", "b") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


LONG = " ".join(f"word{i % 977} and." for i in range(30_000))
ODD = [None, "", "  \n\t ", "a", "a", "é\U0001f600 x", LONG, LONG, "same words here now then", "same words here now then "]
