"""Readers for the parquet inputs and the post/image tables derived from them.

The test data has no image-sharing posts, so the index tables are derived
from ``documents`` joined with ``events`` (one post and one image per
document).  Every column is a Spark expression over those two tables, so the
work grows with them and the same definition is written in DuckDB SQL for the
oracle (``dupstream.plans.oracle``).

Derived post (``posts_fx``): id/link from doc_id, author from the event's
user, event time as epoch seconds, the document's first line (printable
ASCII) as title, a score and album flag from the event.

Derived image (``images_fx``): twelve fingerprint words built so that every
block of 25 consecutive documents shares a base fingerprint with a few
flipped bits per member (near duplicates); one block in five has a sparse
first word, which makes a hot band value; the content digest is the MD5 of
the whole document text, so exact copies of a text share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.functions.bits import exact_bits, reference_bits, signed_sum_is_zero
from dupstream.functions.text import GALLERY_URL, ascii_printable
from dupstream.schemas import WORDS
from dupstream.session import ensure_checkpoint_dir, prepare

# ---- fixed values of the derived fixture --------------------------------
BLOCK = 25            # documents per base fingerprint
SPARSE_EVERY = 5      # every 5th block has a sparse first aHash word
ANIMATED_TYPES = ("click", "view")
NO_URL_EVERY = 10     # userid % 10 == 0 -> unknown profile url
ALBUM_EVERY = 11      # doc_id % 11 == 0 -> album
NO_SIZE_EVERY = 17    # size unknown (0)
NO_WIDTH_EVERY = 13   # width unknown (-1)
NO_HEIGHT_EVERY = 19  # height unknown (-1)
# --------------------------------------------------------------------------

LONG_MIN = -(2 ** 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ, independent of the session
    time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    # title, digest and the event's values are taken before the join: whole texts and
    # event columns that nothing reads never cross a shuffle
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", ascii_printable(F.substring_index(F.col("text"), "\n", 1)).alias("title"),
        F.md5(F.col("text")).alias("crc"), "n_chars")
    events = read_table(spark, sf_dir, "events").select(
        "event_id", epoch_seconds(F.col("ts")).alias("datetime"), "user_id",
        F.col("event_type").isin(*ANIMATED_TYPES).alias("animated"), F.floor("value").cast("bigint").alias("points"))
    return docs.join(events, docs.doc_id == events.event_id).drop("event_id")


def base_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their events, joined once per input folder: posts, images and API
    records all start from these rows."""
    return _materialized(spark, sf_dir, "base", _base)


def _derived_dir(spark: SparkSession, sf_dir: str) -> str:
    """Folder (under the session's checkpoint folder) holding the derived
    tables of one input folder, keyed by the inputs' names, sizes and
    modification times."""
    import hashlib
    import os
    sig = []
    for name in ("documents", "events"):
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        st = os.stat(path) if os.path.exists(path) else None
        sig.append(f"{path}:{st.st_size if st else 0}:{st.st_mtime_ns if st else 0}")
    key = hashlib.sha1("|".join(sig).encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/derived-v1/{key}"


def _materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The derived table ``name``, written once as parquet to the shared
    checkpoint folder and read back (pushdown and pruning apply to it like
    to any stored table; the lineage to the raw inputs is cut)."""
    prepare(spark)
    path = f"{_derived_dir(spark, sf_dir)}/{name}"
    if not _exists(spark, path):
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def posts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post rows: id, link, userid, userurl, datetime, title, score,
    is_album, animated (a projection of the stored join)."""
    return _posts_fx(spark, sf_dir, base_fx(spark, sf_dir))


def images_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows (see ``_images_fx``), materialised once per input folder."""
    return _materialized(spark, sf_dir, "images", lambda sp, d: _images_fx(sp, d, base=base_fx(sp, d)))


def _posts_fx(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    b = base if base is not None else _base(spark, sf_dir)
    return b.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("link"),
        F.col("user_id").alias("userid"),
        F.when(F.col("user_id") % NO_URL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("userurl"),
        "datetime",
        "title",
        (F.col("points") - F.col("doc_id") % 7).alias("score"),
        (F.col("doc_id") % ALBUM_EVERY == 0).alias("is_album"),
        "animated",
    )


def _staged_words(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add the twelve words (derived from column ``key``) in stages (digest,
    body, word), so that each expression is computed once and the plan stays
    small."""
    c = F.floor(F.col(key) / BLOCK).cast("bigint")
    m = (F.col(key) % BLOCK).cast("int")
    df = df.select("*", *[F.md5(F.concat(c.cast("string"), F.lit(w))).alias(f"h_{w}") for w in WORDS])
    df = df.select("*", *[F.conv(F.substring(f"h_{w}", 1, 15), 16, 10).cast("bigint").alias(f"body_{w}")
                          for w in WORDS])
    words = []
    for i, w in enumerate(WORDS):
        body = F.col(f"body_{w}")
        sparse = F.lit(w == "ahash_1") & (c % SPARSE_EVERY == 0)
        high = F.substring(f"h_{w}", 16, 1).isin(*list("89abcdef"))
        v = (F.when(sparse, body.bitwiseAND(F.lit(255)))
             .when(high, F.bitwise_not(body))
             .otherwise(body))
        flip = F.expr(f"shiftleft(1L, cast(({key} % {BLOCK} + {5 * i}) % 60 as int))")
        v = F.when((m + i) % 3 == 0, v.bitwiseXOR(flip)).otherwise(v)
        if w == "ahash_1":
            v = F.when(m % 7 == 1, v.bitwiseXOR(F.lit(LONG_MIN))).otherwise(v)
        words.append(v.alias(w))
    keep = [x for x in df.columns if not x.startswith(("h_", "body_"))]
    return df.select(*keep, *words)


def _images_fx(spark: SparkSession, sf_dir: str, copies_share_fingerprint: bool = True,
               base: DataFrame | None = None) -> DataFrame:
    """Image rows: id, post_id, userid, datetime, animated, 12 words, crc,
    bits (reference definition), tbits (true popcount).  Still images whose
    words sum to zero are rejected at ingest (FLT4) and therefore absent.

    Documents with identical text are copies of one file, so they share the
    fingerprint of the first of them (``copies_share_fingerprint``; off, the
    words depend on the document id alone)."""
    b = (base if base is not None else _base(spark, sf_dir)).drop("title")
    if copies_share_fingerprint:
        first = b.groupBy("crc").agg(F.min("doc_id").alias("fp_id"))
        b = b.join(first, "crc")
    else:
        b = b.withColumn("fp_id", F.col("doc_id"))
    b = _staged_words(b, "fp_id")
    df = b.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("post_id"),
        F.col("user_id").alias("userid"),
        "datetime",
        "animated",
        *WORDS,
        "crc",
        F.concat(F.lit("i/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("imagepath"),
        F.when(F.col("doc_id") % NO_SIZE_EVERY == 0, F.lit(0).cast("bigint"))
         .otherwise(F.col("n_chars")).alias("size"),
        F.when(F.col("doc_id") % NO_WIDTH_EVERY == 0, F.lit(-1))
         .otherwise((F.col("n_chars") % 900 + 100).cast("int")).alias("width"),
        F.when(F.col("doc_id") % NO_HEIGHT_EVERY == 0, F.lit(-1))
         .otherwise((F.col("n_chars") % 700 + 100).cast("int")).alias("height"),
    )
    df = df.select(
        "*",
        F.when(F.col("animated"), F.lit(0)).otherwise(reference_bits()).alias("bits"),
        exact_bits().alias("tbits"),
    )
    return df.filter(F.col("animated") | ~signed_sum_is_zero())


# ---- other inputs derived from the given tables -------------------------
# fixed values of the derivations
BLOCK_ADD_VALUE = 150.0      # error events at or above this value ask to block their user
BLOCK_REMOVE_VALUE = 250.0   # signup events at or above this value ask to unblock
SUMMON_ID_FACTOR = 2         # notifications name ids up to this many times the largest post id


def blocklist_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(add lines, remove lines) as a block/unblock file would hold them:
    one id per line, some padded with blanks, some junk."""
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    add = (ev.filter((F.col("event_type") == "error") & (F.col("value") >= BLOCK_ADD_VALUE))
           .select(F.when(F.col("event_id") % 3 == 0, uid)
                   .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), uid, F.lit(" ")))
                   .otherwise(F.concat(F.lit("x"), uid)).alias("line")))
    remove = (ev.filter((F.col("event_type") == "signup") & (F.col("value") >= BLOCK_REMOVE_VALUE))
              .select(uid.alias("line")))
    return add, remove


def miss_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image misses: the error events (user, epoch seconds)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("userid"), epoch_seconds(F.col("ts")).alias("ts"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notification messages built from conversation turns: user turns come
    from the summoning account; every third turn names a post."""
    cv = read_table(spark, sf_dir, "conversations")
    largest = read_table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("m")).first()["m"] or 0
    space = SUMMON_ID_FACTOR * (largest + 1)
    named = F.concat(F.lit(f"someone mentioned you in a comment: glory at {GALLERY_URL}"),
                     ((F.col("conv_id") * 37 + F.col("turn") * 11) % space).cast("string"),
                     F.lit("/comment/"), F.col("turn").cast("string"), F.lit("/"))
    body = (F.when(F.col("turn") % 3 == 0, named)
            .when(F.col("turn") % 3 == 1, F.concat(F.lit("mentioned you in a comment: "), F.col("text")))
            .otherwise(F.col("text")))
    return cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("notif_id"),
                     F.col("conv_id").alias("conv"), F.col("turn").alias("seq"),
                     F.when(F.col("role") == "user", F.lit("48")).otherwise(F.lit("7")).alias("with_account"),
                     body.alias("body"))


POSTS_PER_PAGE = 50          # records per API page
NON_OBJECT_EVERY = 5         # page % 5 == 1 carries one non-object element
ERROR_PAGE_EVERY = 7         # page % 7 == 3 is an error response
CORRUPT_PAGE_EVERY = 13      # page % 13 == 5 is a truncated body
ERROR_MESSAGE = "Permission denied"
IMAGE_HOST = "http://images.example/"   # image links of the derived API records


def records_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``api_records`` over the stored join."""
    return api_records(spark, sf_dir, base_fx(spark, sf_dir))


def api_records(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Every document as the site's API would deliver its post (the keys
    the ingest reads), with the page it arrives on."""
    b = base if base is not None else _base(spark, sf_dir)
    did = F.col("doc_id").cast("string")
    animated = F.col("animated")
    link = F.concat(F.lit(IMAGE_HOST), did,
                    F.when(animated & (F.col("doc_id") % 4 == 0), F.lit(".gif"))
                    .when(animated, F.lit("h.gif")).otherwise(F.lit(".jpg")))
    gifv = F.when(animated, F.concat(F.lit(IMAGE_HOST), did, F.lit(".gifv"))).otherwise(F.lit(""))
    score = F.col("points") - F.col("doc_id") % 7
    return b.select(
        did.alias("id"), (F.col("doc_id") % ALBUM_EVERY == 0).alias("is_album"),
        F.col("user_id").alias("account_id"),
        F.when(F.col("user_id") % NO_URL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("account_url"),
        "datetime",
        "title",
        link.alias("link"), gifv.alias("gifv"), "animated",
        F.col("n_chars").alias("size"), (F.col("n_chars") % 900 + 100).cast("int").alias("width"),
        (F.col("n_chars") % 700 + 100).cast("int").alias("height"),
        (score + 10).alias("ups"), F.lit(10).cast("bigint").alias("downs"),
        F.floor(F.col("doc_id") / POSTS_PER_PAGE).cast("bigint").alias("page"),
    )


def api_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response body per page (``page, body``); a page holds at most
    ``POSTS_PER_PAGE`` records by construction, so the per-page list is
    bounded."""
    rec = records_fx(spark, sf_dir)
    el = rec.select("page", F.to_json(F.struct(*[c for c in rec.columns if c != "page"])).alias("el"))
    pages = el.groupBy("page").agg(F.array_join(F.collect_list("el"), ",").alias("items"))
    items = F.when(F.col("page") % NON_OBJECT_EVERY == 1, F.concat(F.col("items"), F.lit(",17"))) \
        .otherwise(F.col("items"))
    ok = F.concat(F.lit('{"success": true, "status": 200, "data": ['), items, F.lit("]}"))
    err = F.lit('{"success": false, "status": 403, "data": {"error": {"message": "'
                + ERROR_MESSAGE + '"}}}')
    body = (F.when(F.col("page") % ERROR_PAGE_EVERY == 3, err)
            .when(F.col("page") % CORRUPT_PAGE_EVERY == 5, F.lit('{"success": true, "data": [{"id": '))
            .otherwise(ok))
    return pages.select("page", body.alias("body"))



def stored_near_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The near-duplicate index of the derived images as stored tables
    (``members``: id -> class root; ``root_edges``: a < b, diff_a, diff_d),
    built once per input folder like the reference builds its pair table
    at ingest; lookups and reports read it instead of re-joining."""
    from dupstream.operators.pairs import fingerprint_classes, near_index

    def members(sp, d):
        return fingerprint_classes(images_fx(sp, d))[1]

    def edges(sp, d):
        return near_index(images_fx(sp, d))[1]
    return (_materialized(spark, sf_dir, "near_members", members),
            _materialized(spark, sf_dir, "near_root_edges", edges))
