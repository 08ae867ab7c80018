"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``:

* language ID fits on the rows' own labels and drops rows without a recognised language;
* line dedup rewrites texts, taking lines that spread over many sites out of all documents but their first,
  and drops documents that consisted of such lines alone (their text stays where it comes first);
* near-dedup keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more);
* decontamination drops documents that hold a window of a benchmark item;
* SentencePiece encodes the rest and checks that the ids decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubiform.llm import common, decontaminate, langid, linededup, shingles
from cubiform.llm.queries import encoded_documents, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.workers_import(spark)
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.without_boilerplate(docs)
    emptied = (F.col("n_removed") > 0) & (F.coalesce(F.btrim("text"), F.lit("")) == "")
    sized = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~emptied).withColumn("n_chars", sized).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.workers_import(spark)
    return shingles.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.workers_import(spark)
    return encoded_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: Fitting, fingerprints and piece merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
