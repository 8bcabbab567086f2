"""Table schemas of the duplicate index (explicit, strict Spark types)."""

from __future__ import annotations

from pyspark.sql import types as T

AHASH = ["ahash_1", "ahash_2", "ahash_3", "ahash_4"]
DHASH_H = ["dhash_h_1", "dhash_h_2", "dhash_h_3", "dhash_h_4"]
DHASH_V = ["dhash_v_1", "dhash_v_2", "dhash_v_3", "dhash_v_4"]
WORDS = AHASH + DHASH_H + DHASH_V

POSTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("userurl", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("datetime", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("userid", T.LongType(), True),
])

IMAGES = T.StructType(
    [T.StructField("id", T.LongType(), False),
     T.StructField("post_id", T.LongType(), False),
     T.StructField("imagepath", T.StringType(), True),
     T.StructField("animated", T.BooleanType(), True)]
    + [T.StructField(w, T.LongType(), True) for w in WORDS]
    + [T.StructField("crc", T.StringType(), True),
       T.StructField("bits", T.IntegerType(), True),
       T.StructField("size", T.LongType(), True),
       T.StructField("last_checked", T.DoubleType(), True),
       T.StructField("width", T.IntegerType(), True),
       T.StructField("height", T.IntegerType(), True)]
)

NEAR_PAIRS = T.StructType([
    T.StructField("a", T.LongType(), False),
    T.StructField("b", T.LongType(), False),
    T.StructField("diff_a", T.IntegerType(), False),
    T.StructField("diff_d", T.IntegerType(), False),
])

EXACT_PAIRS = T.StructType([
    T.StructField("a", T.LongType(), False),
    T.StructField("b", T.LongType(), False),
])

REPORT_LOG = T.StructType([
    T.StructField("post_id", T.StringType(), True),
    T.StructField("comment_id", T.LongType(), True),
])

BLOCKED_USERS = T.StructType([T.StructField("userid", T.LongType(), False)])

MISS_EVENTS = T.StructType([
    T.StructField("userid", T.LongType(), True),
    T.StructField("ts", T.LongType(), True),
])

POINT_SERIES = T.StructType([
    T.StructField("ts", T.DoubleType(), False),
    T.StructField("value", T.LongType(), True),
])

MESSAGES = T.StructType([
    T.StructField("post_id", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("retries", T.IntegerType(), True),
    T.StructField("text_capped", T.StringType(), True),
    T.StructField("child_text", T.StringType(), True),
    T.StructField("child_retries", T.IntegerType(), True),
])

SUMMONS = T.StructType([
    T.StructField("notif_id", T.LongType(), True),
    T.StructField("post_link", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])

PAGE_COUNTS = T.StructType([T.StructField(c, T.LongType(), True)
                            for c in ("page", "updates", "known", "skipped", "errors", "albums")])

# Post record as delivered by the site's API (only the keys that are read).
POST_JSON = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("is_album", T.BooleanType(), True),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("account_url", T.StringType(), True),
    T.StructField("datetime", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("gifv", T.StringType(), True),
    T.StructField("animated", T.BooleanType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("width", T.IntegerType(), True),
    T.StructField("height", T.IntegerType(), True),
    T.StructField("ups", T.LongType(), True),
    T.StructField("downs", T.LongType(), True),
])

# Response envelope: {"success": bool, "data": [post, ...] | {"error": ...}}
ENVELOPE = T.StructType([
    T.StructField("success", T.BooleanType(), True),
    T.StructField("status", T.LongType(), True),
    T.StructField("data", T.StringType(), True),
])

TABLES = {
    "posts": POSTS,
    "images": IMAGES,
    "near_pairs": NEAR_PAIRS,
    "exact_pairs": EXACT_PAIRS,
    "report_log": REPORT_LOG,
    "blocked_users": BLOCKED_USERS,
    "miss_events": MISS_EVENTS,
    "point_series": POINT_SERIES,
    "messages": MESSAGES,
    "page_counts": PAGE_COUNTS,
    "summons": SUMMONS,
}
