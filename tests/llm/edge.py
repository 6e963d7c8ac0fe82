"""A small documents table with everything that an operator must bear."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = "word " * 30_000 + "x" * 70_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "b"),
    (5, "12345 !!! ...", "de", "b"),
    (6, LONG, "en", "b"),
    (None, "Ein Satz ohne Nummer aber mit einigen Worten darin.", "de", None),
    (7, "émigré naïve 😀 ünïcode", None, "c"),
    (8, "émigré naïve 😀 ünïcode", None, "c"),
]


def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    # names that operators use themselves
    for name in ("size", "target", "shard", "slot", "n", "node", "id", "tokens", "score", "k", "component_id", "url", "html", "words", "stratum", "kept", "_number"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return docs(spark).limit(0)
