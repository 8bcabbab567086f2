"""Registered queries of the subpackage: each applies one operator, with its
production parameters, to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` repeated from smaller ids, per document."""
    from dupstream.llm.substring import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    from dupstream.llm.jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling probability and draw of every document."""
    from dupstream.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents"))


# The rules of the URL query (verdict, host, start of the path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    from dupstream.llm.urls import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its validated personal numbers, dates and addresses
    replaced by linked pseudonyms."""
    from dupstream.llm.private import pseudonymise
    return pseudonymise(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    """Path of a public vocabulary file (installed alike on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    from dupstream.llm.quality import grade, graded_labels
    return grade(table(spark, sf_dir, "documents"), graded_labels(table(spark, sf_dir, "labels")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every query vector."""
    from dupstream.llm.nearest import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts; the largest id stays."""
    from dupstream.llm.exact import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from dupstream.llm.pieces import encode_decode
    out = encode_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


TOKEN_LIMIT = 1024


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    from dupstream.llm.token_counts import token_counts
    out = token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    from dupstream.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations of two to four words."""
    from dupstream.llm.phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from dupstream.llm.simhash import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mix_sources": op3_mix_sources,
    "op4_url_filter": op4_url_filter,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_nearest": op8_nearest,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_simhash": op13_simhash,
}
