"""Lookup API for a batch of query images (OP4: JN6, JN7, AGG3, AGG4,
WIN1-WIN3, SRT1-SRT3, FLT6, FLT8).

The reference answers one fingerprint or digest at a time; here a whole
DataFrame of queries is answered in one job:

* similarity lookups join the query fingerprints with the *class roots* of
  the index (``pairs.similarity_join``), so a group of identical copies in
  the index is one candidate, and aggregate per class before expanding;
* digest lookups pre-aggregate the index per digest (count, newest, oldest,
  capped newest-first list) and then join the queries to those rows.

Row caps are the reference's ``fetchmany(1024)`` contract; they are applied
with ``row_number() <= cap`` per group, which Spark runs as a partial
per-partition limit before the shuffle (``WindowGroupLimit``), so a hot
group never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstream.operators import pairs as P
from dupstream.operators.history import POST_FIELDS, post_key

LOOKUP_CAP = 1024   # default of ``most``: the reference's fetch size
LIST_FIELDS = ["datetime", "userurl", "link", "title"]   # columns a lookup returns


def _with_posts(images: DataFrame, posts: DataFrame) -> DataFrame:
    p = posts.select(F.col("id").alias("pid"), *POST_FIELDS)
    return images.join(p, F.col("post_id") == F.col("pid")).drop("pid")


def _class_summary(index: DataFrame, posts: DataFrame, *, bits_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, class aggregates, class members with post struct)."""
    roots, members = P.fingerprint_classes(index, bits_col)
    mem = _with_posts(members.join(index.select("id", "post_id"), "id"), posts) \
        .select("id", "root", post_key().alias("s"))
    agg = mem.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("newest"),
                                  F.min("s").alias("oldest"))
    return roots, agg, mem


def similar_lookup(queries: DataFrame, index: DataFrame, posts: DataFrame, th: P.Thresholds = P.LOOKUP, *,
                   bits_col: str = "bits", most: int | None = LOOKUP_CAP) -> dict[str, DataFrame]:
    """OP4 similarity side for a batch of query fingerprints.

    Returns DataFrames ``count`` (q, n; 0 when nothing matches), ``newest``
    and ``oldest`` (q + post columns) and ``all`` (q, rank + post columns,
    newest first, at most ``most`` per query; None gives all).  Queries carry ``id``,
    the 12 words and ``bits_col``.
    """
    still = P.still_images(index)
    roots, agg, mem = _class_summary(still, posts, bits_col=bits_col)
    matches = (P.similarity_join(queries, roots, th, bits_col=bits_col)
               .select(F.col("l_id").alias("q"), F.col("r_id").alias("root")))
    per_q = (matches.join(agg, "root").groupBy("q")
             .agg(F.sum("n").alias("n"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest")))
    qids = queries.select(F.col("id").alias("q"))
    count = qids.join(per_q.select("q", "n"), "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))
    newest = per_q.select("q", *[F.col(f"newest.{c}").alias(c) for c in LIST_FIELDS])
    oldest = per_q.select("q", *[F.col(f"oldest.{c}").alias(c) for c in LIST_FIELDS])
    # Cap each class to its newest ``most`` members before expanding, then cap
    # each query over the union of its classes; only classes that match are ranked.
    mem = mem.join(matches.select("root").distinct(), "root", "left_semi")
    w_cls = Window.partitionBy("root").orderBy(F.col("s").desc())
    top_cls = _at_most(mem.withColumn("r", F.row_number().over(w_cls)), "r", most) if most else mem
    expanded = matches.join(top_cls.select("root", "s"), "root")
    w_q = Window.partitionBy("q").orderBy(F.col("s").desc())
    all_ = (_at_most(expanded.withColumn("rank", F.row_number().over(w_q)), "rank", most)
            .select("q", "rank", *[F.col(f"s.{c}").alias(c) for c in LIST_FIELDS]))
    return {"count": count, "newest": newest, "oldest": oldest, "all": all_}


def _at_most(df: DataFrame, rank: str, most: int | None) -> DataFrame:
    return df if most is None else df.filter(F.col(rank) <= most)


def digest_lookup(queries: DataFrame, index: DataFrame, posts: DataFrame,
                  most: int | None = LOOKUP_CAP) -> dict[str, DataFrame]:
    """OP4 digest side (JN7, AGG4, WIN3) for a batch of query digests.

    Queries carry ``id`` and ``crc``; the index is every stored image
    (animated or not), as in the reference.
    """
    # only digests that some query asks for are aggregated and ranked
    asked = index.select("id", "post_id", "crc").join(queries.select("crc").distinct(), "crc", "left_semi")
    idx = _with_posts(asked, posts).select("crc", post_key().alias("s"))
    agg = idx.groupBy("crc").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("newest"),
                                 F.min("s").alias("oldest"))
    q = queries.select(F.col("id").alias("q"), "crc")
    count = q.join(agg, "crc", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))
    hit = q.join(agg, "crc")
    newest = hit.select("q", *[F.col(f"newest.{c}").alias(c) for c in LIST_FIELDS])
    oldest = hit.select("q", *[F.col(f"oldest.{c}").alias(c) for c in LIST_FIELDS])
    w = Window.partitionBy("crc").orderBy(F.col("s").desc())
    top = _at_most(idx.withColumn("rank", F.row_number().over(w)), "rank", most)
    all_ = q.join(top, "crc").select("q", "rank", *[F.col(f"s.{c}").alias(c) for c in LIST_FIELDS])
    return {"count": count, "newest": newest, "oldest": oldest, "all": all_}
