"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""

import random

from pyspark.sql import functions as F
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
CLASHING = ("id", "hash", "fp", "score", "size", "row", "k", "label", "text_sha256", "copies", "taken", "recipe", "host", "sha", "root", "key")


def long_text(words: int = 40_000, seed: int = 1) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé's\n") for _ in range(rng.randint(1, 9))) for _ in range(words))


def rows():
    same = "the same words stand here in two rows and more of them follow after these"
    return [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "no id at all", "en", "a", 12), (3, same, "en", "b", 1), (3, same, "en", "b", 1), (8, same, "en", "a", 1),
        (4, long_text(), "de", "c", 1), (5, " \n\t ", "en", "c", 4), (6, "a", "en", None, 1), (7, "Ünï cödé \U0001f600 漢字 it's 've 12 345", "xx", "b", 9), (None, None, None, "a", None),
        (9, "x" * 5000, "en", "c", 5000), (10, same + " but not quite", "en", "b", 2),
    ]


def documents(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, pairs=((3, 1, 0), (4, 0, 1), (6, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (9, 1, 0))):
    return spark.createDataFrame(list(pairs), "doc_id bigint, quality int, toxic int")
