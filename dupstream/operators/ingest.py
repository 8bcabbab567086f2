"""Ingest of a batch of post records (OP1 front half: FLT1, FLT2, FLT13,
PRJ1, PRJ2, DML1, DML2, AGG11, SNK1-SNK5).

A batch is a DataFrame of API post records.  Every record gets one outcome
(album, known, error, new) computed with joins instead of per-record
lookups; known posts refresh the stored rows with an upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dupstream.operators.report import MIN_SCORE

POSTS_PER_PAGE = 50


def api_link(rec_link: str = "link", gifv: str = "gifv", animated: str = "animated") -> Column:
    """PRJ1: use the ``gifv`` link for animated posts whose link is the
    thumbnail form ``...h.gif``."""
    return (F.when(F.col(animated) & F.col(rec_link).endswith("h.gif")
                   & (F.length(F.coalesce(F.col(gifv), F.lit(""))) > 0), F.col(gifv))
            .otherwise(F.col(rec_link)))


def score(ups: str = "ups", downs: str = "downs") -> Column:
    """PRJ2: ups minus downs."""
    return F.col(ups) - F.col(downs)


def first_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first record (smallest ``order``) for each key of a batch,
    as a partial aggregate (no group is gathered whole)."""
    cols = [c for c in batch.columns if c != key]
    return (batch.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("r"))
            .select(key, "r.*"))


def classify(batch: DataFrame, stored_posts: DataFrame, images: DataFrame) -> DataFrame:
    """Outcome per record: ``album`` (FLT1), ``known`` (FLT2, link already
    stored), ``error`` (FLT13, no image bytes), else ``new`` with
    ``low_score`` for FLT3's indexed-but-not-reported branch."""
    known = stored_posts.select(F.col("link").alias("id")).withColumn("known", F.lit(True))
    has_img = images.filter(F.col("size") > 0).select(F.col("post_id").cast("string").alias("id"),
                                                      F.lit(True).alias("has_image"))
    j = batch.join(known, "id", "left").join(has_img, "id", "left")
    outcome = (F.when(F.col("is_album"), "album").when(F.col("known").isNotNull(), "known")
               .when(F.col("has_image").isNull(), "error").otherwise("new"))
    return j.select("*", outcome.alias("outcome"),
                    ((outcome == "new") & (score() < MIN_SCORE)).alias("low_score"))


def page_counters(classified: DataFrame, decision: DataFrame, pages: DataFrame) -> DataFrame:
    """AGG11: per page: updates, known, skipped, errors, albums.

    ``skipped`` counts new posts below the score limit and those above it whose
    duplicates fail the report ``decision`` (``link``, ``decision``; only posts with
    older duplicates have a row).  ``errors`` also counts elements of a page
    that are no post object (``pages``: ``page``, ``n_bad``).
    """
    o = F.col("outcome")
    refused = F.coalesce(~F.col("decision"), F.lit(False))
    j = classified.join(decision.select(F.col("link").alias("id"), "decision"), "id", "left")
    counted = j.groupBy("page").agg(
        F.count_if(o == "new").alias("updates"), F.count_if(o == "known").alias("known"),
        F.count_if(F.col("low_score") | ((o == "new") & refused)).alias("skipped"),
        F.count_if(o == "error").alias("failed"), F.count_if(o == "album").alias("albums"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("updates", "known", "skipped", "failed", "n_bad", "albums")}
    # a page may hold bad elements only
    return (counted.join(pages.select("page", "n_bad"), "page", "full")
            .select("page", *[zero[c].alias(c) for c in ("updates", "known", "skipped")],
                    (zero["failed"] + zero["n_bad"]).alias("errors"), zero["albums"].alias("albums")))


def observed(classified: DataFrame, decision: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """AGG11 live: ``classified`` unchanged, and the counters updates, known, skipped,
    failed, albums of its rows, which the action that reads them all gathers on its way."""
    o = F.col("outcome")
    j = classified.join(decision.select(F.col("link").alias("id"), (~F.col("decision")).alias("refused")), "id", "left")
    seen = Observation(name)
    j = j.observe(seen, F.count_if(o == "new").alias("updates"), F.count_if(o == "known").alias("known"),
                  F.count_if(F.col("low_score") | ((o == "new") & F.coalesce("refused", F.lit(False)))).alias("skipped"),
                  F.count_if(o == "error").alias("failed"), F.count_if(o == "album").alias("albums"))
    return j.select(*classified.columns), seen


def new_posts(classified: DataFrame) -> DataFrame:
    """Records to insert: id, final image link, score."""
    return (classified.filter(F.col("outcome") == "new")
            .select("id", api_link().alias("link"), score().alias("score")))


def refresh_posts(stored_posts: DataFrame, known: DataFrame) -> DataFrame:
    """DML1: stored posts with the author of their known record (the old one where
    the record has none)."""
    upd = known.select(F.col("id").alias("link"), F.col("account_id").alias("n_userid"))
    return (stored_posts.join(upd, "link", "left").withColumn("userid", F.coalesce("n_userid", "userid"))
            .select(*stored_posts.columns))


def refresh_images(stored_images: DataFrame, stored_posts: DataFrame, known: DataFrame,
                   now: float | None = None) -> DataFrame:
    """DML2: stored images with size, width and height of their post's known
    record (the old value where it has none); ``last_checked`` becomes ``now``."""
    upd = (known.select(F.col("id").alias("link"), *[F.col(c).alias(f"n_{c}") for c in ("size", "width", "height")],
                        F.lit(True).alias("refreshed"))
           .join(stored_posts.select(F.col("id").alias("post_id"), "link"), "link").drop("link"))
    df = stored_images.join(upd, "post_id", "left")
    for c in ("size", "width", "height"):
        df = df.withColumn(c, F.coalesce(f"n_{c}", c))
    if now is not None:
        df = df.withColumn("last_checked", F.when(F.col("refreshed"), F.lit(float(now))).otherwise(F.col("last_checked")))
    return df.select(*stored_images.columns)


def refresh(stored_images: DataFrame, stored_posts: DataFrame, classified: DataFrame,
            now: float | None = None) -> DataFrame:
    """DML1/DML2 as an upsert: stored image rows with author, size, width and
    height taken from the known records (old value when the record has
    none), and ``last_checked`` set to ``now`` for the refreshed ones."""
    upd = classified.filter(F.col("outcome") == "known").select(
        F.col("id").alias("link"), F.col("account_id").alias("n_userid"), F.col("size").alias("n_size"),
        F.col("width").alias("n_width"), F.col("height").alias("n_height"), F.lit(True).alias("refreshed"))
    p = stored_posts.select(F.col("id").alias("post_id"), "link", "userid")
    old_checked = (F.col("last_checked") if "last_checked" in stored_images.columns
                   else F.lit(None).cast("double")).alias("last_checked")
    j = (stored_images.select("id", "post_id", "size", "width", "height", old_checked)
         .join(p, "post_id").join(upd, "link", "left"))
    checked = F.col("last_checked") if now is None else \
        F.when(F.col("refreshed"), F.lit(float(now))).otherwise(F.col("last_checked"))
    return j.select("id", F.coalesce("n_userid", "userid").alias("userid"),
                    F.coalesce("n_size", "size").alias("size"),
                    F.coalesce("n_width", "width").alias("width"),
                    F.coalesce("n_height", "height").alias("height"),
                    checked.alias("last_checked"))
