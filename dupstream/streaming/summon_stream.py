"""Summons answered to their end (OP3): a batch of notifications is classified once and
routed to several sinks inside one ``foreachBatch``.

| status | what happens |
|-|-|
| ``unparsable`` | nothing |
| ``already_reported`` | nothing: the report log has the post |
| ``repost`` | a message from the post's oldest earlier duplicate, and a log line |
| ``no_repost`` | nothing |
| ``ingested`` | the unknown post is fetched and ingested with ``always_post``, which writes its message and log line if it repeats an older one |
| ``not_found`` | nothing: no record of the unknown post |

Several summons at one post get one message.  The ingest and the summons are two versions
of the store.  A replay reads the tables as they were before the batch, so it comes to the
same classes, and finished versions are left alone: nothing is added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.operators import history as H
from dupstream.operators import report as R
from dupstream.operators import store as SO
from dupstream.session import stored
from dupstream.streaming import index_stream as IX


def answer_summons(spark: SparkSession, store: str, notifications: DataFrame, records: DataFrame, images: DataFrame,
                   batch_id: int, ingest_id: int, now: float) -> None:
    """Answer one batch.  ``records`` and ``images`` are what the site would deliver for
    unknown posts; they are ingested as batch ``ingest_id`` of the store."""
    if SO.is_done(spark, store, "summons", batch_id):
        return
    posts, stored_images = (SO.read_table(spark, store, t, before=ingest_id) for t in ("posts", "images"))
    log = SO.read_table(spark, store, "report_log", before=ingest_id, writer_before=("summons", batch_id))
    asked = stored(R.summon_requests(notifications).select("notif_id", "post_link"), "summons")
    open_links = (asked.filter("post_link != ''").select(F.col("post_link").alias("link")).distinct()
                  .join(log.select(F.col("post_id").alias("link")), "link", "left_anti"))
    index = IX.read_classes(spark, f"{store}/near_index", stored_images, before=ingest_id)
    found = stored(H.reposts_by_link(open_links, stored_images, posts, index=index), "summon-reposts")
    unknown = found.filter("status = 'unknown'").select(F.col("link").alias("id"))
    fetched = stored(records.join(unknown, "id", "left_semi"), "summon-records")
    pictures = images.join(fetched.select(F.col("id").cast("bigint").alias("post_id")), "post_id", "left_semi")
    SO.ingest_batch(spark, store, fetched, pictures, ingest_id, now=now, always_post=True)
    have = fetched.select(F.col("id").alias("link"), F.lit(True).alias("have")).distinct()
    status = found.join(have, "link", "left").select(
        F.col("link").alias("post_link"), F.when(F.col("have"), "ingested").when(F.col("status") == "unknown", "not_found")
        .otherwise(F.col("status")).alias("status"))
    answered = asked.join(status, "post_link", "left").withColumn("status", F.coalesce(
        "status", F.when(F.col("post_link") == "", "unparsable").otherwise("already_reported")))
    texts = stored(R.repost_messages(found, posts), "summon-messages")
    SO.append(spark, store, "summons", batch_id, {
        "summons": answered, "messages": texts,
        "report_log": texts.select("post_id", F.lit(-1).cast("bigint").alias("comment_id"))})


def run_summon_stream(spark: SparkSession, source_dir: str, schema, store: str, checkpoint: str, records: DataFrame,
                      images: DataFrame, first_ingest_id: int, now: float, files_per_batch: int = 1) -> None:
    """Answer every notification file under ``source_dir`` (then stop)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, n: answer_summons(spark, store, df, records, images, n, first_ingest_id + n, now))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
