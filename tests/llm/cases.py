"""Documents with the awkward cases, among columns called like results."""
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # columns called like results
    T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("shard", T.StringType()),
])

LONG = " ".join(f"w{i} thing" for i in range(30_000))  # 60,000 words

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three four five"), (5, "one two three four five"),
    (6, "ONE two\nthree  four five"), (7, LONG), (8, LONG + " end"), (9, "é è 日本語 ½ 12"), (10, "123 456 !!!"),
    (None, "no id here at all"), (12, "twice"), (12, "twice"), (13, "twice"), (14, "a\n\nb c d\n"), (15, None),
    (16, "x" * 50_000), (17, "cc by cc by and All rights reserved."), (18, "the the the the the the the the"),
]


def docs_of(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t), "k", "n", "r", "h", "i", "s") for i, t in rows]
    return spark.createDataFrame(full, DOCS)
