"""The stored index as versioned parquet tables, and the ingest of a batch (DDL, OP1,
DML1, DML2, SNK1-SNK6).

``<store>/data/<table>/v=<n>/`` holds what version ``n`` wrote; ``<store>/snapshots/
<writer>/v=<n>/`` lists, for every table, the folders that make up the table at that
version.  A version is written in two steps: first all its data, then its list.  The
list is the switch: readers take the newest finished one (``_SUCCESS``), so they see
all of a batch or nothing of it, whatever fails in between.  A batch whose version is
finished does nothing when it is run again; one that broke off overwrites its own folders.

Posts and images are cut into ``SLOTS`` slots by a hash of the post's id.  A refresh of
known posts rewrites the slots that hold one (copy on write) and leaves the others'
files as they are; rewriting also merges what earlier batches appended to the slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.operators import history as H
from dupstream.operators import ingest as IG
from dupstream.operators import report as R
from dupstream.schemas import TABLES
from dupstream.session import path_of, stored
from dupstream.streaming import index_stream as IX

SLOTS = 16                                            # fixed for a store's life
SLOT_KEY = {"posts": "id", "images": "post_id"}       # tables whose rows may change
WRITERS = ("ingest", "reports", "points", "summons")  # each with versions of its own
# what the ingest reads of an API record; the rest never crosses its shuffles
RECORD_FIELDS = ("id", "is_album", "account_id", "account_url", "datetime", "title", "size", "width", "height", "ups", "downs", "page")
LIST = "name string, slot int, folder string"


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose list is complete."""
    fs, path = path_of(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names
                  if n.startswith("v=") and fs.exists(path_of(spark, f"{folder}/{n}/_SUCCESS")[1]))


def _snapshot(spark: SparkSession, store: str, writer: str, upto: int | None = None) -> list:
    """(name, slot, folder) rows of the newest finished version (at most ``upto``)."""
    versions = [v for v in _finished(spark, f"{store}/snapshots/{writer}") if upto is None or v <= upto]
    if not versions:
        return []
    rows = spark.read.schema(LIST).parquet(f"{store}/snapshots/{writer}/v={versions[-1]}").collect()
    return [tuple(r) for r in rows]                   # one row per table, slot and folder


def create_store(spark: SparkSession, store: str) -> None:
    """DDL: every table can be read (empty, with its schema) after this call."""
    for writer in WRITERS:
        if not _finished(spark, f"{store}/snapshots/{writer}"):
            _commit(spark, store, writer, 0, [])


def _commit(spark: SparkSession, store: str, writer: str, version: int, rows: list) -> None:
    spark.createDataFrame(rows, LIST).coalesce(1).write.mode("overwrite").parquet(f"{store}/snapshots/{writer}/v={version}")


def read_table(spark: SparkSession, store: str, name: str, before: int | None = None,
               writer_before: tuple[str, int] | None = None) -> DataFrame:
    """A table as the newest finished versions left it (``before``: as it was before
    that ingest batch; ``writer_before``: before a batch of another writer too)."""
    if name == "near_pairs":
        done = max(_finished(spark, f"{store}/snapshots/ingest"), default=0)
        upto = done if before is None else min(done, before)
        if upto:
            return IX.read_pairs(spark, f"{store}/near_index", before=upto)
        return spark.createDataFrame([], TABLES[name])
    upto = {"ingest": before, **({writer_before[0]: writer_before[1]} if writer_before else {})}
    folders = [f for w in WRITERS for n, _, f in _snapshot(spark, store, w, upto.get(w)) if n == name]
    return _folders(spark, store, name, folders)


def _folders(spark: SparkSession, store: str, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{store}/{f}" for f in folders])


def slot_of(name: str, slots: int = SLOTS):
    return F.pmod(F.xxhash64(SLOT_KEY[name]), F.lit(slots)).cast("int")


def _put(df: DataFrame, store: str, name: str, version: int, mark: str = "") -> list:
    """Write rows of a version; returns its folders as list rows."""
    folder = f"data/{name}{mark}/v={version}"
    df = df.select(*[c if c in df.columns else F.lit(None).cast(TABLES[name][c].dataType).alias(c) for c in TABLES[name].fieldNames()])
    if name not in SLOT_KEY:
        df.write.mode("overwrite").parquet(f"{store}/{folder}")
        return [(name, None, folder)]
    df.withColumn("slot", slot_of(name)).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{store}/{folder}")
    fs, path = path_of(df.sparkSession, f"{store}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [(name, int(n[5:]), f"{folder}/{n}") for n in names if n.startswith("slot=")]


def _merged(old: list, new: list, rewritten: set) -> list:
    """List rows after a version: rewritten (table, slot) keep the new folders only."""
    return [r for r in old if (r[0], r[1]) not in rewritten] + new


def ingest_batch(spark: SparkSession, store: str, records: DataFrame, images: DataFrame, batch_id: int,
                 blocked: DataFrame | None = None, now: float | None = None, always_post: bool = False) -> None:
    """OP1 for a batch of API records and their fingerprinted images.

    Albums are skipped.  Known links refresh the stored rows (DML1, DML2): the author
    of the post, size, width and height of its image, and ``last_checked``, set to
    ``now``.  Records without image bytes are errors.  New posts and their images are
    appended (SNK1), with their near and exact edges against everything stored before
    and within the batch (SNK3, SNK4).  With ``now``, new posts that repeat an older one
    and pass the report rules (or all of them with ``always_post``) get their message
    (``messages``) and a line of the report log (SNK5).  The outcome of every
    record is counted per page (``page_counts``).  All of it is one version.
    """
    version = batch_id + 1
    if version in _finished(spark, f"{store}/snapshots/ingest"):
        return
    before = _snapshot(spark, store, "ingest", batch_id)

    def at(name: str, slots: set | None = None) -> DataFrame:
        return _folders(spark, store, name, [f for n, s, f in before if n == name and (slots is None or s in slots)])

    records = records.select(*[c for c in RECORD_FIELDS if c in records.columns])
    cls = stored(IG.classify(IG.first_per_key(records, "id", "datetime"), at("posts"), images), "ingest-outcomes")
    new, known = cls.filter(F.col("outcome") == "new"), cls.filter(F.col("outcome") == "known")
    post_id = F.coalesce(F.col("id").try_cast("bigint"), F.xxhash64("id"))
    posts = new.select(post_id.alias("id"), F.col("account_url").alias("userurl"), F.col("id").alias("link"),
                       "datetime", "title", F.col("account_id").alias("userid"), IG.score().alias("score"))
    kept = images.select(*[c for c in images.columns if c in TABLES["images"].fieldNames()])
    own = kept.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")

    # copy on write: the slots that hold a known post are rewritten with their new rows
    touched = {r["s"] for r in at("posts").join(known.select(F.col("id").alias("link")), "link", "left_semi")
               .select(slot_of("posts").alias("s")).distinct().collect()}            # at most ``SLOTS`` numbers
    old_posts, old_images = at("posts", touched), at("images", touched)
    rows_posts, rows_images = posts.drop("score"), own
    if touched:
        own = stored(own, "ingest-images")
        rows_posts = IG.refresh_posts(old_posts, known).unionByName(rows_posts)
        rows_images = IG.refresh_images(old_images, old_posts, known, now).unionByName(own, allowMissingColumns=True)
    put_images = _put(rows_images, store, "images", version)
    if not touched:                                  # the version's folders hold just these
        own = _folders(spark, store, "images", [f for _, _, f in put_images])
    lists = _put(rows_posts, store, "posts", version) + put_images
    rewritten = {(n, s) for n in SLOT_KEY for s in touched}

    # near edges: the same per-batch step as the streaming index; exact edges: animated
    # copies by digest, to the first stored copy
    IX.process_batch(own, batch_id, f"{store}/near_index")
    anim = own.filter(F.col("animated")).select("id", "crc")
    old = at("images").filter(F.col("animated")).groupBy("crc").agg(F.min("id").alias("sroot"))
    first_new = anim.groupBy("crc").agg(F.min("id").alias("broot"))
    roots = first_new.join(old, "crc", "left").select("crc", F.coalesce("sroot", "broot").alias("root"))
    lists += _put(anim.join(roots, "crc").filter(F.col("id") != F.col("root"))
                  .select(F.col("root").alias("a"), F.col("id").alias("b")), store, "exact_pairs", version)

    after = _merged(before, lists, rewritten)
    refused = spark.createDataFrame([], "link string, decision boolean")
    if now is not None:
        reported, refused = _reports(spark, store, after, posts, blocked, now, always_post, version)
        after += reported
    counted = IG.page_counters(cls, refused, cls.select("page", F.lit(0).cast("bigint").alias("n_bad")).distinct()) \
        if "page" in cls.columns else spark.createDataFrame([], TABLES["page_counts"])
    after += _put(counted, store, "page_counts", version)
    _commit(spark, store, "ingest", version, after)


def _reports(spark: SparkSession, store: str, lists: list, posts: DataFrame, blocked: DataFrame | None, now: float,
             always_post: bool, version: int) -> tuple[list, DataFrame]:
    """Messages and log lines of the batch's new posts that repeat an older one."""
    def at(name):
        return _folders(spark, store, name, [f for n, _, f in lists if n == name])

    index = IX.read_classes(spark, f"{store}/near_index", at("images"), before=version)
    summary = stored(H.duplicate_summary(at("images"), at("posts"), index=index, only=posts.select("id")), "ingest-summary")
    blocked = blocked if blocked is not None else spark.createDataFrame([], "userid bigint")
    decided = stored(R.report_decision(summary, posts, blocked, int(now), always_post), "ingest-decision")
    texts = R.compose_messages(summary.join(decided.filter("post_it").select("id"), "id"), posts)
    done = at("report_log").select("post_id")
    texts = stored(texts.join(done, "post_id", "left_anti"), "ingest-messages")
    refused = decided.join(posts.select("id", "link"), "id").select("link", "decision")
    return (_put(texts, store, "messages", version)
            + _put(texts.select("post_id", F.lit(-1).cast("bigint").alias("comment_id")), store, "report_log", version)), refused


def is_done(spark: SparkSession, store: str, writer: str, batch_id: int) -> bool:
    return batch_id + 1 in _finished(spark, f"{store}/snapshots/{writer}")


def append(spark: SparkSession, store: str, writer: str, batch_id: int, tables: dict[str, DataFrame]) -> None:
    """Append rows to several tables as one version of a writer; again: nothing."""
    if not is_done(spark, store, writer, batch_id):
        rows = [r for name, df in tables.items() for r in _put(df, store, name, batch_id + 1, f"-{writer}")]
        _commit(spark, store, writer, batch_id + 1, _snapshot(spark, store, writer, batch_id) + rows)


def log_reports(store: str, messages: DataFrame, batch_id: int) -> None:
    """SNK5: append written reports (comment id -1 until sent)."""
    log = messages.select(F.col("post_id"), F.lit(-1).cast("bigint").alias("comment_id"))
    append(messages.sparkSession, store, "reports", batch_id, {"report_log": log})


def append_points(store: str, points: DataFrame, batch_id: int) -> None:
    """SNK6: append (time, value) points to the series."""
    rows = points.select(F.col("ts").cast("double").alias("ts"), F.col("value").cast("bigint").alias("value"))
    append(points.sparkSession, store, "points", batch_id, {"point_series": rows})
