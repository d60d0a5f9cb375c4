"""Small documents with the odd cases every operator must stand: nulls, empty and
long texts, ties, repeated rows, columns whose names clash with internal ones."""
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long = " ".join(f"word{i % 997} thing{i}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (3, None, "en", "b", None), (4, "", None, None, 0), (5, "  \n\t ", "de", "b", 3),
        (None, "the quick brown fox jumps over the lazy dog again and again", None, None, 1),
        (None, None, None, None, None), (6, long, "en", "c", 9), (7, "123 !!! 456", "fr", None, 2),
        (8, "\U0001F600 Ünïcode ſ K İ\nline two has five words here\nline two has five words here", "de", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """More columns, named as operators might name their own."""
    names = ["id", "h", "th", "fp", "size", "rate", "copies", "spans", "words", "component", "label", "vector", "_r", "key", "shard"]
    out = df
    for n in names:
        if n not in df.columns:
            out = out.withColumn(n, F.lit("x"))
    return out


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
