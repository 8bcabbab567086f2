"""Report rules and text (FLT3, FLT9-FLT12, FN13-FN19, OP2, OP3).

All rules are Column expressions evaluated row-wise over the per-post
duplicate summary, so the whole report stage is one narrow projection after
the history joins.  ``now`` is a parameter (a literal), never read from the
clock inside a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupstream.functions import text as X

# ---- fixed values (reference rules) --------------------------------------
MIN_SCORE = 40                       # ups - downs needed to report
MAX_POST_AGE = 60 * 60 * 24 * 3      # seconds a post stays eligible
SAME_TITLE = 0.4                     # normalised edit distance: "same title"
MAX_GAP_OTHER_TITLE = 60 * 60 * 24 * 60
REPLY_RETRIES, CHILD_RETRIES = 5, 7
SUMMON_SENDER = "48"
# --------------------------------------------------------------------------


def _java(fmt: str) -> str:
    """The reference's printf templates in Java ``format_string`` syntax."""
    return fmt.replace("%i", "%d")


def with_post(summary: DataFrame, posts: DataFrame) -> DataFrame:
    """Summary rows plus the reported post's own fields (``x_*``)."""
    p = posts.select(F.col("id"), *[F.col(c).alias(f"x_{c}") for c in
                                    ("datetime", "title", "userurl", "userid", "link", "score")])
    return summary.join(p, "id")


def title_distance(df: DataFrame, old: str, new: str = "x_title") -> dict[str, Column]:
    a, b = X.normalize_title(F.col(old)), X.normalize_title(F.col(new))
    n = X.levenshtein_n(a, b)
    return {"distance": X.edit_distance(a, b), "similarity": n,
            "bar": X.star_bar(F.lit(1.0) - n)}


def should_post(now: int, blocked: DataFrame | None = None, *, max_age: int = MAX_POST_AGE,
                strict_author: bool = False) -> dict[str, Column]:
    """FLT9 components over a summary row joined with ``with_post`` and an
    optional ``blocked`` flag column.  The last duplicate is ``last_*``."""
    same_title = X.distance_below(X.normalize_title(F.col("x_title")), X.normalize_title(F.col("last_title")),
                                  SAME_TITLE)
    fresh = F.lit(now) < F.col("x_datetime") + F.lit(max_age)
    is_blocked = F.col("x_userurl").isNotNull() & F.coalesce(F.col("author_blocked"), F.lit(False))
    # Cheap tests first: And/Or short-circuit in generated code, so the edit
    # distance (quadratic in title length) runs only where it decides.
    title_ok = (
        ((F.abs(F.col("x_datetime") - F.col("last_datetime")) < MAX_GAP_OTHER_TITLE)
         & ~X.title_tokens_hit("x_title") & ~X.title_starts_with("x_title"))
        | same_title)
    other_author = F.col("x_userurl").isNull() | ~F.col("x_userurl").eqNullSafe(F.col("last_userurl"))
    if strict_author:
        other_id = ~F.col("x_userid").eqNullSafe(F.lit(0)) & ~F.col("x_userid").eqNullSafe(F.col("last_userid"))
    else:   # the reference's test, true for any non-zero account id
        other_id = ~F.col("x_userid").eqNullSafe(F.lit(0)) | ~F.col("x_userid").eqNullSafe(F.col("last_userid"))
    decision = fresh & ~is_blocked & other_author & other_id & title_ok
    return {"fresh": fresh, "author_blocked": is_blocked,
            "other_author": other_author, "decision": decision}


def report_decision(summary: DataFrame, posts: DataFrame, blocked: DataFrame, now: int,
                    always_post: bool = False) -> DataFrame:
    """FLT3 + FLT9 + FLT11 per post with strictly older duplicates."""
    flags = blocked.select(F.col("userid").alias("x_userid"), F.lit(True).alias("author_blocked"))
    df = with_post(summary, posts).join(flags, "x_userid", "left")
    parts = should_post(now)
    score_ok = F.col("x_score") >= MIN_SCORE
    post_it = F.lit(True) if always_post else (score_ok & parts["decision"])
    return df.select("id", score_ok.alias("score_ok"),
                     *[v.alias(k) for k, v in parts.items()], post_it.alias("post_it"))


def compose_messages(summary: DataFrame, posts: DataFrame) -> DataFrame:
    """OP2/FN17: the reply (last seen) and, when first and last seen differ
    by link, the child reply (first seen, or seen N-1 times since)."""
    df = with_post(summary, posts)
    crc = F.col("by_crc")
    last_gap = X.duration_text(F.col("x_datetime") - F.col("last_datetime"))
    first_gap = X.duration_text(F.col("x_datetime") - F.col("first_datetime"))
    last_info = X.title_similarity_text(F.col("last_title"), F.col("x_title"))
    first_info = X.title_similarity_text(F.col("first_title"), F.col("x_title"))
    text = F.when(crc, F.format_string(_java(X.STR_DUPLICATE), last_gap, F.col("last_link"), last_info)) \
        .otherwise(F.format_string(_java(X.STR_SIMILAR), last_gap, F.col("last_link"), last_info))
    times = F.col("seen") - 1
    child = (F.when(crc & (F.col("seen") > 2),
                    F.format_string(_java(X.STR_DUPLICATE_FIRST_TIMES), times, first_gap,
                                    F.col("first_link"), first_info))
             .when(crc, F.format_string(_java(X.STR_DUPLICATE_FIRST), first_gap, F.col("first_link"), first_info))
             .when(F.col("seen") > 2,
                   F.format_string(_java(X.STR_SIMILAR_FIRST_TIMES), times, first_gap,
                                   F.col("first_link"), first_info))
             .otherwise(F.format_string(_java(X.STR_SIMILAR_FIRST), first_gap, F.col("first_link"), first_info)))
    child = F.when(F.col("trip"), child)
    return df.select(F.col("x_link").alias("post_id"), text.alias("text"),
                     F.lit(REPLY_RETRIES).alias("retries"), X.cap_text(text).alias("text_capped"),
                     child.alias("child_text"),
                     F.when(F.col("trip"), F.lit(CHILD_RETRIES)).alias("child_retries"))


def summon_requests(notifications: DataFrame, sender: str = SUMMON_SENDER) -> DataFrame:
    """FLT12 + FN18: notifications from the summoning account that mention
    us, with the post id named in the text ('' when unparsable)."""
    return (notifications
            .filter((F.col("with_account") == sender) & F.col("body").contains(X.SUMMON_MARKER))
            .select("notif_id", "conv", "seq", X.summon_id("body").alias("post_link")))


def newest_first(requests: DataFrame, k: int | None = None) -> DataFrame:
    """SRT5: position of each request in its conversation, newest first
    (``k`` keeps the newest k, planned as a partial per-partition limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv").orderBy(F.col("seq").desc(), F.col("notif_id").desc())
    out = requests.withColumn("newest_rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("newest_rank") <= k)


def repost_messages(reposts: DataFrame, posts: DataFrame) -> DataFrame:
    """OP3: the reply to a summons at a stored post, from its one neighbour
    (``history.reposts_by_link``); there is no child reply."""
    p = posts.select("id", F.col("datetime").alias("x_datetime"), F.col("title").alias("x_title"))
    df = reposts.filter(F.col("status") == "repost").join(p, "id")
    gap = X.duration_text(F.col("x_datetime") - F.col("nb_datetime"))
    info = X.title_similarity_text(F.col("nb_title"), F.col("x_title"))
    text = F.when(F.col("animated"), F.format_string(_java(X.STR_DUPLICATE), gap, F.col("nb_link"), info)) \
        .otherwise(F.format_string(_java(X.STR_SIMILAR), gap, F.col("nb_link"), info))
    return df.select(F.col("link").alias("post_id"), text.alias("text"), F.lit(REPLY_RETRIES).alias("retries"),
                     X.cap_text(text).alias("text_capped"), F.lit(None).cast("string").alias("child_text"),
                     F.lit(None).cast("int").alias("child_retries"))
