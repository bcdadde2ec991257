"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree in silence"

TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "one two three"),
    (7, PASSAGE), (8, PASSAGE), (8, PASSAGE), (9, PASSAGE + " indeed"), (10, "Totally different words stand here alone, friend."),
    (11, LONG), (12, LONG + " end"), (13, "日本語 の テキスト 🙂 ▁▁ x"), (14, "x" * 3000), (None, PASSAGE), (None, None),
]

# names that operators use inside
CLASH = ("id", "n", "h", "f", "weight", "kind", "sig", "record", "bucket", "place", "train", "words", "line", "score", "v")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])


def documents(spark, texts=TEXTS):
    rows = [(i, t, None, "s", None, *["z"] * len(CLASH)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
