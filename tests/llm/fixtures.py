"""Small tables with the awkward cases every operator must define a result for."""

from __future__ import annotations

LONG = " ".join(f"word{k} filler" for k in range(3000))
PASSAGE = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds sing loudly"
DOCS = [
    (1, f"Intro words here. {PASSAGE} and then more text follows after it.", "en", "s1"),
    (2, "short text", "en", "s2"),
    (3, None, "en", "s3"),
    (4, "", None, None),
    (5, "   \n\t ", "de", "s4"),
    (6, "Das ist ein kleiner deutscher Satz über Häuser und Bäume.", "de", "s5"),
    (6, "Das ist ein kleiner deutscher Satz über Häuser und Bäume.", "de", "s5"),
    (7, "Das ist ein kleiner deutscher Satz über Häuser und Bäume.", "de", None),
    (8, LONG, "en", "s6"),
    (None, "a row without an id, in plain words", "en", "s7"),
    (9, "12345 67890 !!! ???", None, "s8"),
    (10, LONG + " tail", "en", "s9"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    """Documents with extra columns whose names clash with what operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.withColumns({"fp": F.lit("x"), "score": F.lit(1), "term": F.lit("t"), "pos": F.lit(2), "ids": F.lit("i"), "n_removed": F.lit("n"), "shard": F.lit(0)})


def empty(spark):
    return docs(spark).limit(0)
