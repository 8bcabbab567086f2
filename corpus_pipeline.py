"""Pipeline from raw documents to token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on
all rows it gets and returns a DataFrame, written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``docs``.

| stage | rows that go |
|-|-|
| quality | documents whose probability of the top grade is too small (junk, toxic) |
| exact_dedup | of equal texts (A-Z folded) all but the largest id |
| near_dedup | of each component of near copies all but the smallest id |
| mixing | documents that the calibrated draw passes over |
| tokens | none: each document becomes its token ids |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.llm import exact, jaccard, mixing, pieces, quality
from dupstream.llm.common import stored, table
from dupstream.session import prepare

ORACLE_SQL = None          # trained models and tokenisers: SQL cannot express them


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the ordinal classifier rejects."""
    prepare(spark)
    names = ("_grade", "_tail", "_passes")
    ratings = quality.graded_labels(table(spark, sf_dir, "labels"))
    return quality.grade(docs, ratings, carry=tuple(docs.columns), names=names).filter("_passes").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts."""
    prepare(spark)
    return exact.distinct_rows(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    prepare(spark)
    return jaccard.without_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by calibrated probabilities."""
    prepare(spark)
    return mixing.sampled(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``n_tokens`` and packed ``ids``."""
    prepare(spark)
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    return (pieces.encode_decode(docs, path, carry=("doc_id", "source", "lang"))
            .select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                    F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mixing", mixing_stage), ("tokens", tokens_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
