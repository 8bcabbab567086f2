"""Pages streamed into outcomes, with live counters (SRC3, SRC4, AGG11).

Every micro-batch of captured pages is split, its posts are classified against the stored
tables, and the outcomes are written.  The counters are observed by that very write, so
they cost no job of their own, and become one row per batch.  A replayed batch writes its
own folders again.

Results: a page that is an error or corrupt has no rows and no counts; elements that are
no post object count as errors; a post delivered twice in a batch counts once (the one
of the smallest page); a run without pages leaves no counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.operators import ingest as IG
from dupstream.session import stored
from dupstream.sources import envelope as EV
from dupstream.sources.pages import PageSource

COUNTERS = "updates bigint, known bigint, skipped bigint, errors bigint, albums bigint"


def take_pages(pages: DataFrame, batch_id: int, out: str, posts: DataFrame, images: DataFrame, decision: DataFrame) -> None:
    """One batch of (``page``, ``body``) into ``<out>/outcomes`` and ``<out>/counters``."""
    spark = pages.sparkSession
    elements = stored(EV.page_posts(EV.split_envelopes(pages)), "page-posts")
    posts_in = elements.filter("is_object").select("page", "post.*").filter("id IS NOT NULL")
    batch = IG.first_per_key(posts_in, "id", "page")
    kept, seen = IG.observed(IG.classify(batch, posts, images), decision, f"pages-{batch_id}")
    (kept.select("page", "id", "outcome", "low_score").write.mode("overwrite").parquet(f"{out}/outcomes/batch={batch_id}"))
    got = seen.get
    bad = elements.filter("NOT is_object OR post.id IS NULL").count()
    row = (got["updates"], got["known"], got["skipped"], got["failed"] + bad, got["albums"])
    spark.createDataFrame([row], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/batch={batch_id}")


def run_page_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, posts: DataFrame, images: DataFrame,
                    decision: DataFrame) -> None:
    """Take every page of the capture ``folder`` that an earlier run with this
    checkpoint has not taken (then stop)."""
    spark.dataSource.register(PageSource)
    q = (spark.readStream.format("captured_pages").option("path", folder).load().writeStream
         .foreachBatch(lambda df, n: take_pages(df, n, out, posts, images, decision))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def counters(spark: SparkSession, out: str) -> DataFrame:
    """The counters of all batches so far, one row."""
    rows = spark.read.schema(COUNTERS).parquet(f"{out}/counters")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("updates", "known", "skipped", "errors", "albums")])
