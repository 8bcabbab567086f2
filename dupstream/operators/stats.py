"""Corpus statistics and exact-hash grouping (OP5, OP6, AGG1, AGG2, AGG5-AGG7,
AGG10, WIN4, PRJ5).

Statistics are returned in long form (one ``metric, value`` row per figure)
so that figures over different tables are combined with ``unionByName``
instead of joining one-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstream.operators.skew import HOT_ROWS, join_back
from dupstream.schemas import AHASH, DHASH_H, DHASH_V

# ---- fixed values ----------------------------------------------------------
SECONDS_PER_YEAR = 31536000.0     # the age statistic's year (365 days)
# -----------------------------------------------------------------------------
HASH_KINDS = [("a", AHASH), ("dh", DHASH_H), ("dv", DHASH_V)]


def _metrics(df: DataFrame, **figures) -> DataFrame:
    """Several figures of one table from one aggregate, in long form."""
    row = df.agg(*[expr.cast("double").alias(name) for name, expr in figures.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
                                          for name in figures])).alias("m")).select("m.*")


def pair_counts(images: DataFrame, members: DataFrame, root_edges: DataFrame) -> DataFrame:
    """AGG5: numbers of duplicate *pairs* (near, exact, both), from class sizes:
    a class of ``m`` copies holds ``m (m - 1) / 2`` pairs and an edge between two
    classes stands for the product of their sizes.  No pair is ever expanded."""
    n = F.col("m") * (F.col("m") - 1) / 2
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    digests = images.filter(F.col("animated")).groupBy("crc").agg(F.count(F.lit(1)).alias("m"))
    across = (root_edges.select("a", "b").join(sizes.select(F.col("root").alias("a"), F.col("m").alias("ma")), "a")
              .join(sizes.select(F.col("root").alias("b"), F.col("m").alias("mb")), "b"))
    figures = (across.select(F.lit("near").alias("kind"), (F.col("ma") * F.col("mb")).cast("double").alias("n"))
               .unionByName(sizes.select(F.lit("near").alias("kind"), n.alias("n")))
               .unionByName(digests.select(F.lit("exact").alias("kind"), n.alias("n"))))
    def total(kind): return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0.0))
    return _metrics(figures, near_pairs=total("near"), exact_pairs=total("exact"),
                    reposts=F.coalesce(F.sum("n"), F.lit(0.0)))


def corpus_stats(images: DataFrame, posts: DataFrame, members: DataFrame, root_edges: DataFrame,
                 blocked: DataFrame, report_log: DataFrame, now: int) -> DataFrame:
    """OP5: images, oldest post time, its age in years, duplicate pair counts
    (near, exact, total), blocked users and reports written; one aggregate per
    table."""
    n = F.count(F.lit(1))
    parts = [
        _metrics(posts, oldest=F.min("datetime"),
                 age_years=(F.lit(now) - F.min("datetime")) / F.lit(SECONDS_PER_YEAR)),
        pair_counts(images, members, root_edges),
        _metrics(blocked, blocked=n),
        # a report is one or two comments: the reference prints "n - 2n"
        _metrics(report_log, reports=n, report_comments_max=2 * n),
    ]
    out = _metrics(images, images=n)
    for p in parts:
        out = out.unionByName(p)
    return out


def quality_counts(images: DataFrame, posts: DataFrame) -> DataFrame:
    """AGG6: posts without user id, images without size, width or height."""
    q_posts = posts.agg(F.count_if(F.col("userid") == 0).alias("n")).select(F.lit("no_userid").alias("metric"), "n")
    q_img = images.agg(F.count_if(F.col("size") == 0).alias("no_size"),
                       F.count_if(F.col("width") == -1).alias("no_width"),
                       F.count_if(F.col("height") == -1).alias("no_height"))
    q_img = q_img.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"))
                                             for c in ("no_size", "no_width", "no_height")])).alias("m")
                         ).select("m.metric", "m.n")
    return q_posts.unionByName(q_img)


def stacked_hashes(images: DataFrame) -> DataFrame:
    """One row per (image, hash kind): ``id, kind, h1..h4`` (single scan)."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(w).alias(f"h{i + 1}") for i, w in enumerate(ws)])
                     for k, ws in HASH_KINDS])
    return images.select("id", F.explode(rows).alias("r")).select("id", "r.*")


def hash_groups(images: DataFrame) -> DataFrame:
    """AGG10: images sharing one exact 256-bit hash, per hash kind
    (``kind, h1..h4, n, first_id, last_id``), groups of two or more."""
    return (stacked_hashes(images).groupBy("kind", "h1", "h2", "h3", "h4")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
            .filter(F.col("n") > 1))


ID_SLICE = 1 << 20    # id range of the two-level running count


def hash_running(images: DataFrame, id_slice: int = ID_SLICE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """WIN4: for each image that repeats an earlier image's hash (earlier =
    smaller id): how many earlier images share it, the first of them and the
    previous one.

    Two levels, so a hash shared by a huge number of images is never
    gathered in one task: per (hash, id slice) counts and max id with a
    running prefix over the slices, then a running count/lag inside a slice.
    The first image of a hash is a plain aggregate.
    """
    keys = ["kind", "h1", "h2", "h3", "h4"]
    s = stacked_hashes(images).withColumn("key", F.struct(*keys)).withColumn("sl", F.floor(F.col("id") / F.lit(id_slice)).cast("bigint"))
    per_slice = s.groupBy(*keys, "sl").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("mx"))
    before = Window.partitionBy(*keys).orderBy("sl").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_slice.select(*keys, "sl", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pn"),
                              F.max("mx").over(before).alias("pmx"))
    first = s.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy(*keys, "sl").orderBy("id")
    within = s.select("key", *keys, "sl", "id", (F.row_number().over(w) - 1).alias("wn"),
                      F.lag("id").over(w).alias("wprev"))
    return (join_back(within.join(prefix, [*keys, "sl"]), first, "key", "n_rows", hot_rows)
            .select("id", "kind", (F.col("pn") + F.col("wn")).cast("int").alias("n_before"), "first_id",
                    F.coalesce("wprev", "pmx").alias("prev_id"))
            .filter(F.col("n_before") > 0))
