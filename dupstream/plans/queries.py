"""Registered queries: one per operator group of the survey's inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
derived post/image tables (or other given tables).  The matching DuckDB
text lives in ``dupstream.plans.oracle``; column names agree one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstream.functions import bits as B
from dupstream.functions import text as X
from dupstream.functions import whole_text as WT
from dupstream.functions.sql import register_sql
from dupstream.operators import history as H
from dupstream.operators import ingest as IG
from dupstream.operators import limits as LM
from dupstream.operators import lookup as L
from dupstream.operators import pairs as P
from dupstream.operators import report as R
from dupstream.operators import stats as ST
from dupstream.schemas import WORDS
from dupstream.sources import envelope as EV
from dupstream.sources.tables import (api_envelopes, blocklist_lines, images_fx, miss_events, notifications,
                                      posts_fx, read_table, records_fx, stored_near_index)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_MARKS: dict = {}


def time_marks(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(split, now) of a registered run, from one aggregate over the posts:
    images before the middle of the time range form the stored index, and
    "now" is one day after the newest post.  Remembered per application and
    input folder (the inputs are read-only)."""
    from dupstream.sources.tables import _derived_dir
    key = (spark.sparkContext.applicationId, _derived_dir(spark, sf_dir))
    if key not in _MARKS:
        row = posts_fx(spark, sf_dir).agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi")).first()
        _MARKS[key] = ((row["lo"] + row["hi"]) // 2, row["hi"] + 86400)
    return _MARKS[key]


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- pairs ----------------------------------------------------------------

@register("near_pairs")
def q_near_pairs(spark, sf_dir):
    return P.near_pairs(images_fx(spark, sf_dir))


@register("near_pairs_exact_bits")
def q_near_pairs_exact_bits(spark, sf_dir):
    return P.near_pairs(images_fx(spark, sf_dir), bits_col="tbits")


@register("near_pairs_returned")
def q_near_pairs_returned(spark, sf_dir):
    return P.returned(P.near_pairs(images_fx(spark, sf_dir)))


@register("near_pairs_new_only")
def q_near_pairs_new_only(spark, sf_dir):
    im = images_fx(spark, sf_dir)
    split, _ = time_marks(spark, sf_dir)
    stored = P.near_pairs(im.filter(F.col("datetime") < split))
    return P.new_pairs_only(P.near_pairs(im), stored)


@register("exact_pairs")
def q_exact_pairs(spark, sf_dir):
    return P.exact_pairs(images_fx(spark, sf_dir))


@register("exact_groups")
def q_exact_groups(spark, sf_dir):
    return P.exact_groups(images_fx(spark, sf_dir))


# ---- scans and scalar functions --------------------------------------------

@register("hash_scan")
def q_hash_scan(spark, sf_dir):
    """SRC6: fingerprints and path of every still image."""
    return images_fx(spark, sf_dir).filter(~F.col("animated")).select(*WORDS, "imagepath")


@register("hash_by_path")
def q_hash_by_path(spark, sf_dir):
    """SRC7 for a batch of paths (the images of well-scored posts)."""
    im = images_fx(spark, sf_dir)
    paths = (posts_fx(spark, sf_dir).filter(F.col("score") >= 40)
             .select(F.concat(F.lit("i/"), F.col("link"), F.lit(".jpg")).alias("imagepath")))
    return (im.filter(~F.col("animated")).join(paths, "imagepath", "left_semi")
            .select(*WORDS, "id"))


@register("sql_functions")
def q_sql_functions(spark, sf_dir):
    """UDF1/UDF2: the registered SQL functions called from SQL text."""
    register_sql(spark)
    images_fx(spark, sf_dir).createOrReplaceTempView("fx_images")
    return spark.sql("""
        SELECT id,
               hamming3(ahash_1, dhash_h_1) AS h3,
               hamming1(ahash_2, ahash_3) AS h1,
               hamming2(dhash_v_1, NULL) AS h2_null,
               xor(ahash_1, ahash_4) AS x14,
               xor(NULL, dhash_v_2) AS x_null,
               popcount(ahash_2) AS pc32
        FROM fx_images""")


@register("popcounts")
def q_popcounts(spark, sf_dir):
    """FN2-FN5, AGG12, FLT4 over every image."""
    im = images_fx(spark, sf_dir)
    return im.select(
        "id",
        B.xor64("ahash_1", "dhash_h_1").alias("x"),
        B.hamming("ahash_1", "ahash_2").alias("ham"),
        B.popcount32("ahash_1").alias("pc32"),
        B.popcount_sm("ahash_1").alias("pc_sm"),
        B.hamming_sm("ahash_1", "dhash_v_4").alias("ham_sm"),
        B.reference_bits().alias("ref_bits"),
        B.exact_bits().alias("true_bits"),
        B.signed_sum_is_zero().alias("zero_sum"),
    )


@register("signed_words")
def q_signed_words(spark, sf_dir):
    """FN10: 64-character 0/1 strings (signs of an embedding) and a word's
    own binary text read back as signed words."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = F.concat_ws("", F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")))
    return emb.select("vec_id", s.alias("bit_string"), B.signed_word(s, 0).alias("word"))


# ---- duplicate history ---------------------------------------------------

@register("duplicate_summary")
def q_duplicate_summary(spark, sf_dir):
    """AGG9/JN10/SRT4: first/last seen and count of strictly older
    duplicates, over the stored pair index."""
    return H.duplicate_summary(images_fx(spark, sf_dir), posts_fx(spark, sf_dir),
                               index=stored_near_index(spark, sf_dir))


@register("duplicates_before")
def q_duplicates_before(spark, sf_dir):
    """JN5/JN10: number of strictly older duplicates and the newest of them."""
    d = H.duplicate_summary(images_fx(spark, sf_dir), posts_fx(spark, sf_dir), titles=(),
                            index=stored_near_index(spark, sf_dir))
    return d.select("id", "seen", "last_link", "last_datetime")


@register("neighbours_before")
def q_neighbours_before(spark, sf_dir):
    """JN8/JN9/JN11/JN12: oldest duplicate at or before each post, over the
    stored pair index."""
    return H.neighbours_before(images_fx(spark, sf_dir), posts_fx(spark, sf_dir),
                               index=stored_near_index(spark, sf_dir))


# ---- lookup API (a batch of new images against the stored index) ----------

def _split_images(spark, sf_dir):
    im = images_fx(spark, sf_dir)
    split, _ = time_marks(spark, sf_dir)
    return im.filter(F.col("datetime") < split), im.filter(F.col("datetime") >= split)


def _similar(spark, sf_dir, part, th=P.LOOKUP):
    index, new = _split_images(spark, sf_dir)
    return L.similar_lookup(P.still_images(new), index, posts_fx(spark, sf_dir), th)[part]


def _digest(spark, sf_dir, part):
    index, new = _split_images(spark, sf_dir)
    return L.digest_lookup(new, index, posts_fx(spark, sf_dir))[part]


for _part in ("all", "count", "newest", "oldest"):
    register(f"similar_{_part}")(lambda spark, sf_dir, _p=_part: _similar(spark, sf_dir, _p))
    register(f"same_digest_{_part}")(lambda spark, sf_dir, _p=_part: _digest(spark, sf_dir, _p))


@register("avg_exists_combined")
def q_avg_exists_combined(spark, sf_dir):
    """FLT8: newest post within aHash 3 and combined dHash 10, no bits window."""
    return _similar(spark, sf_dir, "newest", P.COMBINED)


# ---- report ----------------------------------------------------------------

def _summary(spark, sf_dir, shared: bool = False, titles: tuple[str, ...] = ("first", "last")):
    """Per-post duplicate summary; ``shared`` writes it once to the
    checkpoint folder when a query reads it several times."""
    s = H.duplicate_summary(images_fx(spark, sf_dir), posts_fx(spark, sf_dir), titles=titles,
                            index=stored_near_index(spark, sf_dir))
    return s.checkpoint(eager=True) if shared else s


def _blocked(spark, sf_dir):
    add, remove = blocklist_lines(spark, sf_dir)
    empty = spark.createDataFrame([], "userid bigint")
    return LM.update_blocklist(empty, add, remove)


@register("title_distance")
def q_title_distance(spark, sf_dir):
    """FN8/FN9/FN12: edit distance between a post's title and the titles of
    its last and first earlier duplicate."""
    df = R.with_post(_summary(spark, sf_dir), posts_fx(spark, sf_dir))
    last, first = R.title_distance(df, "last_title"), R.title_distance(df, "first_title")
    return df.select("id", last["distance"].alias("last_distance"), last["similarity"].alias("last_norm"),
                     first["distance"].alias("first_distance"), first["similarity"].alias("first_norm"))


@register("similarity_bar")
def q_similarity_bar(spark, sf_dir):
    """FN16: the five-star title similarity bar of each report."""
    df = R.with_post(_summary(spark, sf_dir), posts_fx(spark, sf_dir))
    return df.select("id", R.title_distance(df, "last_title")["bar"].alias("last_bar"),
                     R.title_distance(df, "first_title")["bar"].alias("first_bar"))


@register("time_gap_text")
def q_time_gap_text(spark, sf_dir):
    """FN15: time since the last and the first earlier duplicate, as text."""
    df = R.with_post(_summary(spark, sf_dir, titles=()), posts_fx(spark, sf_dir))
    return df.select("id", X.duration_text(F.col("x_datetime") - F.col("last_datetime")).alias("last_gap"),
                     X.duration_text(F.col("x_datetime") - F.col("first_datetime")).alias("first_gap"))


@register("string_mismatch")
def q_string_mismatch(spark, sf_dir):
    """FN6/FN7: positional mismatches of titles and of binary word texts
    over the reported root edges."""
    im = images_fx(spark, sf_dir)
    members, root_edges = stored_near_index(spark, sf_dir)
    e = P.returned(root_edges)
    po = posts_fx(spark, sf_dir)
    a = im.select(F.col("id").alias("a"), F.col("ahash_1").alias("wa")).join(
        po.select(F.col("id").alias("a"), F.col("title").alias("ta")), "a")
    b = im.select(F.col("id").alias("b"), F.col("ahash_1").alias("wb")).join(
        po.select(F.col("id").alias("b"), F.col("title").alias("tb")), "b")
    j = e.select("a", "b").join(a, "a").join(b, "b")
    return j.select("a", "b", X.positional_mismatch("ta", "tb").alias("title_mismatch"),
                    X.bin_mismatch("wa", "wb").alias("bin_mismatch"))


@register("text_distance")
def q_text_distance(spark, sf_dir):
    """FN7/FN8 on whole texts: for the reported root edges, differing positions and edit
    distance (in UTF-8 bytes) of the two documents' whole texts, and whether that is below
    the share that makes two titles the same."""
    _, root_edges = stored_near_index(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("t"))
    j = P.with_texts(P.returned(root_edges).select("a", "b"), docs, "doc_id", "t")
    j = j.withColumn("distance", WT.byte_distance("ta", "tb"))
    return j.select("a", "b", WT.byte_mismatch("ta", "tb").alias("mismatch"), "distance",
                    X.distance_below("ta", "tb", R.SAME_TITLE, known="distance").alias("alike"))


def _decision(spark, sf_dir, summary=None):
    _, now = time_marks(spark, sf_dir)
    summary = summary if summary is not None else _summary(spark, sf_dir, titles=("last",))
    return R.report_decision(summary, posts_fx(spark, sf_dir), _blocked(spark, sf_dir), now)


@register("report_decision")
def q_report_decision(spark, sf_dir):
    """FLT3/FLT9/FLT11/FN13/FN14 for every post with older duplicates."""
    return _decision(spark, sf_dir)


def _report_log(spark, sf_dir, decision=None):
    """Posts already reported: those eligible before the stored-index split."""
    split, _ = time_marks(spark, sf_dir)
    d = (decision if decision is not None else _decision(spark, sf_dir)).filter("post_it")
    po = posts_fx(spark, sf_dir).filter(F.col("datetime") < split)
    return d.join(po, "id").select(F.col("link").alias("post_id"))


@register("report_messages")
def q_report_messages(spark, sf_dir):
    """OP2/FN17/FN19 for reportable posts not in the report log (FLT10)."""
    summ = _summary(spark, sf_dir, shared=True)
    dec = _decision(spark, sf_dir, summ)
    todo = dec.filter("post_it").select("id")
    msgs = R.compose_messages(summ.join(todo, "id"), posts_fx(spark, sf_dir))
    return msgs.join(_report_log(spark, sf_dir, dec), "post_id", "left_anti")


@register("summon_ids")
def q_summon_ids(spark, sf_dir):
    """OP3: summons -> post id -> unparsable / already reported / repost /
    no repost / unknown (to be fetched and ingested)."""
    req = R.newest_first(R.summon_requests(notifications(spark, sf_dir)))
    po = posts_fx(spark, sf_dir).select("id", "link")
    nb = H.neighbours_before(images_fx(spark, sf_dir), posts_fx(spark, sf_dir), titles=(),
                             index=stored_near_index(spark, sf_dir)).select(
        F.col("id").alias("nb_id"), F.lit(True).alias("has_nb"))
    log = _report_log(spark, sf_dir).withColumn("logged", F.lit(True))
    j = (req.join(po, req.post_link == po.link, "left")
         .join(nb, F.col("id") == F.col("nb_id"), "left")
         .join(log, req.post_link == log.post_id, "left"))
    status = (F.when(F.col("post_link") == "", "unparsable")
              .when(F.col("logged").isNotNull(), "already_reported")
              .when(F.col("link").isNull(), "unknown")
              .when(F.col("has_nb").isNotNull(), "repost")
              .otherwise("no_repost"))
    return j.select("notif_id", "post_link", status.alias("status"), "newest_rank")


# ---- block lists and limits -------------------------------------------------

@register("blocklist")
def q_blocklist(spark, sf_dir):
    """SRC5/SET1: blocked users after applying the add and remove lists."""
    return _blocked(spark, sf_dir)


@register("miss_limit")
def q_miss_limit(spark, sf_dir):
    """AGG8/WIN5/DML3: misses in the trailing 180 s at each miss."""
    return LM.miss_counts(miss_events(spark, sf_dir))


# ---- statistics and hash groups ---------------------------------------------

@register("corpus_stats")
def q_corpus_stats(spark, sf_dir):
    """OP5/AGG1/AGG2/AGG5/AGG7/PRJ5 in long form."""
    im, po = images_fx(spark, sf_dir), posts_fx(spark, sf_dir)
    _, now = time_marks(spark, sf_dir)
    dec = _decision(spark, sf_dir, _summary(spark, sf_dir, shared=True, titles=("last",)))
    members, root_edges = stored_near_index(spark, sf_dir)
    return ST.corpus_stats(im, po, members, root_edges, _blocked(spark, sf_dir),
                           _report_log(spark, sf_dir, dec), now)


@register("quality_counts")
def q_quality_counts(spark, sf_dir):
    """AGG6: rows still missing user id, size, width or height."""
    return ST.quality_counts(images_fx(spark, sf_dir), posts_fx(spark, sf_dir))


@register("hash_groups")
def q_hash_groups(spark, sf_dir):
    """AGG10: still images sharing an exact aHash / dHash_h / dHash_v."""
    return ST.hash_groups(P.still_images(images_fx(spark, sf_dir)))


@register("hash_running")
def q_hash_running(spark, sf_dir):
    """WIN4: images repeating an earlier image's exact hash."""
    return ST.hash_running(P.still_images(images_fx(spark, sf_dir)))


@register("ahash64_embedding")
def q_ahash64_embedding(spark, sf_dir):
    """FN22 on 8x8 grids: each embedding scaled to 0-255 gray levels."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).selectExpr(
        "vec_id", "array_min(v) AS mn", "array_max(v) AS mx", "v").selectExpr(
        "vec_id", "transform(v, x -> CASE WHEN mx = mn THEN 0 ELSE CAST(floor(255 * (x - mn) / (mx - mn)) AS INT) END) AS pix"
    ).selectExpr("vec_id", "pix", "CAST(aggregate(pix, 0L, (a, x) -> a + x) DIV 64 AS INT) AS avg").selectExpr(
        "vec_id", "avg",
        "aggregate(sequence(0, 63), 0L, (acc, i) -> acc | IF(pix[i] < avg, shiftleft(1L, 63 - i), 0L)) AS ahash")


# ---- API pages and ingest ------------------------------------------------------

@register("envelope_split")
def q_envelope_split(spark, sf_dir):
    """SRC4: outcome per page, post objects and bad elements, error text."""
    return EV.page_summary(EV.split_envelopes(api_envelopes(spark, sf_dir)))


@register("envelope_posts")
def q_envelope_posts(spark, sf_dir):
    """SRC3: the post objects of ok pages, parsed with the post schema."""
    p = EV.page_posts(EV.split_envelopes(api_envelopes(spark, sf_dir))).filter("is_object")
    return p.select("page", F.col("post.id").alias("id"), F.col("post.account_url").alias("account_url"),
                    F.col("post.datetime").alias("datetime"), IG.score("post.ups", "post.downs").alias("score"))


def _classified(spark, sf_dir):
    split, _ = time_marks(spark, sf_dir)
    po = posts_fx(spark, sf_dir).filter(F.col("datetime") < split)
    batch = IG.first_per_key(records_fx(spark, sf_dir), "id", "datetime")
    return IG.classify(batch, po, images_fx(spark, sf_dir))


@register("post_outcomes")
def q_post_outcomes(spark, sf_dir):
    """AGG11/FLT1/FLT2/FLT13: per-page counters of an ingest batch."""
    dec = _decision(spark, sf_dir).join(posts_fx(spark, sf_dir).select("id", "link"), "id")
    pages = EV.page_summary(EV.split_envelopes(api_envelopes(spark, sf_dir)))
    return IG.page_counters(_classified(spark, sf_dir), dec, pages)


def _paged_run(spark, sf_dir) -> str:
    """The API's pages captured in two halves, each streamed before the next one comes; the
    second run starts from the first one's checkpoint."""
    from dupstream.sources.pages import capture
    from dupstream.streaming import page_stream as PS
    base = _scratch(spark, "pages")
    split, _ = time_marks(spark, sf_dir)
    stored_posts = posts_fx(spark, sf_dir).filter(F.col("datetime") < split)
    dec = _decision(spark, sf_dir).join(posts_fx(spark, sf_dir).select("id", "link"), "id")
    pages = api_envelopes(spark, sf_dir)
    half = (pages.agg(F.max("page").alias("m")).first()["m"] or 0) // 2
    for part in (F.col("page") <= half, F.col("page") > half):
        capture(pages.filter(part), f"{base}/in")
        PS.run_page_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", stored_posts, images_fx(spark, sf_dir), dec)
    return f"{base}/out"


@register("paged_outcomes")
def q_paged_outcomes(spark, sf_dir):
    """SRC3/SRC4: outcome of every post that the paged source delivered in two runs."""
    out = spark.read.parquet(f"{_paged_run(spark, sf_dir)}/outcomes")
    return out.select("batch", "page", "id", "outcome", "low_score")


@register("live_counters")
def q_live_counters(spark, sf_dir):
    """AGG11 live: counters that the two runs observed while writing."""
    from dupstream.streaming import page_stream as PS
    return PS.counters(spark, _paged_run(spark, sf_dir))


@register("new_posts")
def q_new_posts(spark, sf_dir):
    """PRJ1/PRJ2 + JN14 anti join: records inserted by the batch."""
    return IG.new_posts(_classified(spark, sf_dir))


@register("post_refresh")
def q_post_refresh(spark, sf_dir):
    """DML1/DML2: stored images after the known records refreshed them."""
    split, now = time_marks(spark, sf_dir)
    po = posts_fx(spark, sf_dir).filter(F.col("datetime") < split)
    im = images_fx(spark, sf_dir).filter(F.col("datetime") < split)
    return IG.refresh(im, po, _classified(spark, sf_dir), now)


# ---- exact total-distance join (the LSH prototype's query) -------------------------

@register("lsh_pairs")
def q_lsh_pairs(spark, sf_dir):
    """JN15: still-image pairs within total distance 20 over 768 bits."""
    return P.total_distance_pairs(images_fx(spark, sf_dir))


@register("lsh_nearest")
def q_lsh_nearest(spark, sf_dir):
    """SRT6: the five nearest partners of each image within distance 20."""
    return P.nearest(P.total_distance_pairs(images_fx(spark, sf_dir)), 5)


def _two_vector_batches(spark, sf_dir):
    """Still images stored in two batches; returns (store, answers of both)."""
    from dupstream.operators import vector_index as V
    base = _scratch(spark, "vectors")
    old, new = (P.still_images(d).select("id", *WORDS) for d in _split_images(spark, sf_dir))
    return base, [V.insert_and_get(d, n, base, most=5) for n, d in enumerate((old, new))]


@register("lsh_insert_get")
def q_lsh_insert_get(spark, sf_dir):
    """JN15: two batches inserted into the stored 768-bit index; each image's five nearest
    among what was there before it."""
    _, (first, second) = _two_vector_batches(spark, sf_dir)
    return first.unionByName(second)


@register("lsh_check")
def q_lsh_check(spark, sf_dir):
    """JN15: later images checked against the stored index of the earlier ones."""
    from dupstream.operators import vector_index as V
    base, _ = _two_vector_batches(spark, sf_dir)
    new = P.still_images(_split_images(spark, sf_dir)[1]).select("id", *WORDS)
    return V.check(new, base, before=1)


# ---- streaming --------------------------------------------------------------

def _scratch(spark, tag: str) -> str:
    import uuid
    from dupstream.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


STREAM_CHUNKS = 4


@register("stream_pairs")
def q_stream_pairs(spark, sf_dir):
    """ST1: the near-duplicate index built incrementally by a file stream of
    image arrivals (four micro-batches, in any order); equals near_pairs."""
    from dupstream.streaming import index_stream as S
    base = _scratch(spark, "stream-pairs")
    im = images_fx(spark, sf_dir)
    files = S.write_arrivals(im, f"{base}/in", STREAM_CHUNKS)
    S.run_index_stream(spark, f"{base}/in", im.schema, f"{base}/store", f"{base}/ckpt", files)
    return S.read_pairs(spark, f"{base}/store")


@register("stream_miss_limit")
def q_stream_miss_limit(spark, sf_dir):
    """ST2: the miss limiter as a stateful stream over files that each span the whole time,
    so that misses arrive out of order; equals miss_limit."""
    from dupstream.streaming import miss_stream as S
    base = _scratch(spark, "stream-miss")
    misses = miss_events(spark, sf_dir)
    S.write_arrivals(misses, f"{base}/in", STREAM_CHUNKS, by_time=False)
    span = misses.agg((F.max("ts") - F.min("ts")).alias("s")).first()["s"] or 0
    S.run_miss_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", late=span + 1)
    return S.read_counts(spark, f"{base}/out")


# ---- image fingerprints --------------------------------------------------------

@register("image_fingerprints")
def q_image_fingerprints(spark, sf_dir):
    """FN20-FN25/PRJ4: fingerprints of 8x8 gray images (each embedding scaled
    to 0-255), resized by Lanczos to the 16/17-pixel hash grids; the 768-bit vector
    as text."""
    from dupstream.sources.images import fingerprint_pixels
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    grids = emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).selectExpr(
        "vec_id", "array_min(v) AS mn", "array_max(v) AS mx", "v").selectExpr(
        "vec_id",
        "transform(v, x -> CASE WHEN mx = mn THEN 0 ELSE CAST(floor(255 * (x - mn) / (mx - mn)) AS INT) END) AS pix")
    return fingerprint_pixels(grids, "vec_id", "pix", 8, 8).withColumn("vector768", F.concat_ws("", "vector768"))


# ---- stored index: ingest in two batches, then read back ---------------------

def _ingested_store(spark, sf_dir) -> str:
    from dupstream.operators import store as SO
    base = _scratch(spark, "store")
    SO.create_store(spark, base)
    split, _ = time_marks(spark, sf_dir)
    rec, im = records_fx(spark, sf_dir), images_fx(spark, sf_dir)
    SO.ingest_batch(spark, base, rec.filter(F.col("datetime") < split), im.filter(F.col("datetime") < split), 0)
    SO.ingest_batch(spark, base, rec.filter(F.col("datetime") >= split), im.filter(F.col("datetime") >= split), 1)
    return base


@register("ingest_posts")
def q_ingest_posts(spark, sf_dir):
    """OP1/SNK1/SNK4/DDL: posts ingested in two batches (albums and posts
    without image bytes skipped); the near-pair table read back."""
    from dupstream.operators import store as SO
    return SO.read_table(spark, _ingested_store(spark, sf_dir), "near_pairs")


@register("ingest_exact")
def q_ingest_exact(spark, sf_dir):
    """OP1/SNK3: the exact-pair table of the same two-batch ingest."""
    from dupstream.operators import store as SO
    return SO.read_table(spark, _ingested_store(spark, sf_dir), "exact_pairs")


def _overlapping_store(spark, sf_dir) -> tuple[str, int]:
    """Two batches of which the second brings half of the first one's posts again, with
    other authors, sizes, widths and heights; the second one is run twice."""
    from dupstream.operators import store as SO
    base = _scratch(spark, "store")
    SO.create_store(spark, base)
    split, now = time_marks(spark, sf_dir)
    rec, im = records_fx(spark, sf_dir), images_fx(spark, sf_dir)
    SO.ingest_batch(spark, base, rec.filter(F.col("datetime") < split), im.filter(F.col("datetime") < split), 0, now=now)
    again = rec.filter((F.col("datetime") >= split) | (F.col("id").cast("bigint") % 2 == 0)).select(
        *[c for c in rec.columns if c not in ("account_id", "size", "width", "height")],
        (F.col("account_id") + 1000).alias("account_id"), (F.col("size") + 1).alias("size"),
        (F.col("width") + 2).alias("width"), F.when(F.col("height") % 3 != 0, F.col("height") + 3).alias("height"))
    for _ in range(2):
        SO.ingest_batch(spark, base, again, im.filter(F.col("datetime") >= split), 1, _blocked(spark, sf_dir), now)
    return base, now


@register("ingest_refresh")
def q_ingest_refresh(spark, sf_dir):
    """DML1/DML2/OP1: posts and images read back after two overlapping batches; known
    posts have the author, size, width and height of the second one."""
    from dupstream.operators import store as SO
    base, _ = _overlapping_store(spark, sf_dir)
    po = SO.read_table(spark, base, "posts").select(F.col("id").alias("post_id"), "link", "userid")
    im = SO.read_table(spark, base, "images").select("id", "post_id", "size", "width", "height", "last_checked")
    return im.join(po, "post_id").select("id", "link", "userid", "size", "width", "height", "last_checked")


@register("ingest_messages")
def q_ingest_messages(spark, sf_dir):
    """OP1 to its end: the messages of both batches' new posts, with the report log's
    entry of each."""
    from dupstream.operators import store as SO
    base, _ = _overlapping_store(spark, sf_dir)
    log = SO.read_table(spark, base, "report_log")
    return SO.read_table(spark, base, "messages").join(log, "post_id").drop("retries", "child_retries")


@register("summon_messages")
def q_summon_messages(spark, sf_dir):
    """OP3/JN11/FLT3: summons streamed against a store of the earlier posts; messages of
    reposts and of unknown posts that were ingested, with the report log's entry."""
    from dupstream.operators import store as SO
    from dupstream.streaming import summon_stream as SU
    base = _scratch(spark, "summons")
    SO.create_store(spark, base)
    split, now = time_marks(spark, sf_dir)
    rec, im = records_fx(spark, sf_dir), images_fx(spark, sf_dir)
    SO.ingest_batch(spark, base, rec.filter(F.col("datetime") < split), im.filter(F.col("datetime") < split), 0, now=now)
    notes = notifications(spark, sf_dir)
    notes.write.parquet(f"{base}/in")
    SU.run_summon_stream(spark, f"{base}/in", notes.schema, base, f"{base}/ckpt", rec.filter(F.col("datetime") >= split), im, 1,
                         now, files_per_batch=1000)
    log = SO.read_table(spark, base, "report_log")
    return SO.read_table(spark, base, "messages").join(log, "post_id").drop("retries", "child_retries")


@register("point_series")
def q_point_series(spark, sf_dir):
    """SNK6: daily event counts appended as a (time, value) series in two
    runs, read back."""
    from dupstream.operators import store as SO
    base = _scratch(spark, "series")
    SO.create_store(spark, base)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                   F.col("ts")) / 86400).cast("bigint") * 86400
    pts = ev.groupBy(day.alias("ts")).agg(F.count(F.lit(1)).alias("value"))
    mid = pts.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    half = (mid["lo"] + mid["hi"]) // 2
    SO.append_points(base, pts.filter(F.col("ts") < half), 0)
    SO.append_points(base, pts.filter(F.col("ts") >= half), 1)
    return SO.read_table(spark, base, "point_series")


@register("report_log")
def q_report_log(spark, sf_dir):
    """SNK5/FLT10: reports of the stored half logged to the store (comment id
    -1 until sent) and read back."""
    from dupstream.operators import store as SO
    base = _scratch(spark, "reports")
    SO.create_store(spark, base)
    SO.log_reports(base, _report_log(spark, sf_dir), 0)
    return SO.read_table(spark, base, "report_log")
