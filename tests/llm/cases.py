"""Rows that every operator must take: nulls, empties, long texts, ties, repeats, clashing names."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor sit amet " * 8_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (None, "no id here, none at all", "de", "b"),
    (4, LONG, "la", "a"),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "b"),
    (6, " \n\t  ", "fr", ""),
    (7, "12 34 !!", None, "a"),
    (8, "日本語の文章です。 naïve café 𝒳", "ja", None),
    (-9, "x", "en", "a"),
]
EXTRA = "node long, fp binary, score double, component_id string, ids string, source_ string, _id int, pass int, bucket string, weight string, label int, sequence_id string"


def documents(spark: SparkSession) -> DataFrame:
    """The rows above, with columns that are named like those that operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    for field in EXTRA.split(", "):
        name, kind = field.split()
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def empty(df: DataFrame) -> DataFrame:
    return df.where("1 = 0")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
