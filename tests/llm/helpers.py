"""Small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def docs_table(spark, rows):
    """rows: (doc_id, text, source)."""
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(data, DOCS)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "no id at all here", None),
    (5, "word " * 30_000, "a"), (6, "été naïve 🙂 déjà\nété naïve 🙂 déjà\n\n", "c"),
]
CLASHING = ["part", "rank", "base", "place", "n_words", "kept", "row", "length_", "key", "label"]


def odd_table(spark):
    return docs_table(spark, ODD)


def sf(spark, name, scale="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{scale}/{name}.parquet")
