"""Per-post duplicate history over the pair index (JN5, JN8-JN12, AGG9, SRT4).

The pair index is class based (``pairs.py``): every image belongs to a class
(identical fingerprint for still images, identical digest for animated ones)
and classes are linked by reported edges.  The duplicates of post x are the
other members of x's class and of the linked classes.

Nothing here joins a post to every member of a linked class.  Instead:

* **strictly earlier summary** (count, first, last seen): prefix sums over
  aggregated (class, hour, second) rows, read off at query rows
  ``(x, class, x.datetime)`` with equi-joins; no window ever holds more
  than one hour of seconds, whatever the size of a class.  Per-class
  partials are then combined per post with a partial (map-side) aggregate.
* **oldest neighbour at or before** (the reference returns the first row of
  an ascending scan): per class the smallest and second smallest member are
  two plain aggregates; the first one that is not x itself and not newer
  than x is x's answer from that class.

The ordering of a "post" is the reference's tuple order (datetime, userurl,
userid, link, title), with NULL before any value.  Titles can be as long as a
text, so they stay out of these plans: a post carries the place of its title
among the posts that agree in everything else, and the titles of the posts
that were found are looked up at the end, only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupstream.operators import pairs as P
from dupstream.operators.skew import join_back
from dupstream.session import prepare, stored

POST_FIELDS = ["datetime", "userurl", "userid", "link", "title"]
KEY_FIELDS = [*POST_FIELDS[:-1], "place"]   # the same order without the title


def post_key(prefix: str | None = None) -> Column:
    def col(c):
        return F.col(f"{prefix}.{c}") if prefix else F.col(c)
    return F.struct(*[col(c).alias(c) for c in POST_FIELDS])


def placed(posts: DataFrame) -> DataFrame:
    """Post rows with ``place``, the rank of the title among posts that agree in all
    other ``POST_FIELDS``, and ``first`` (the first row of its place).  Where no two posts
    agree, every place is 1 and ``posts`` must be rows that can be read again."""
    fields = POST_FIELDS[:-1]
    if posts.groupBy(*fields).count().filter("count > 1").isEmpty():     # no title decides: none is moved
        return posts.select("id", *POST_FIELDS, F.lit(1).alias("place"), F.lit(True).alias("first"))
    w = Window.partitionBy(*fields).orderBy("title")
    rows = posts.select("id", *POST_FIELDS, F.rank().over(w).alias("place"), F.row_number().over(w).alias("nth"))
    return stored(rows.withColumn("first", F.col("place") == F.col("nth")).drop("nth"), "placed")


def with_titles(df: DataFrame, posts: DataFrame, structs: tuple[str, ...]) -> DataFrame:
    """``df`` with ``<struct>_title`` for every post struct named; ``posts`` are placed."""
    titles = posts.filter("first").select(*[F.col(c).alias(f"of_{c}") for c in KEY_FIELDS], "title")
    for s in structs:
        same = [F.col(f"{s}.{c}").eqNullSafe(F.col(f"of_{c}")) for c in KEY_FIELDS]
        df = df.join(titles, same, "left").select(*df.columns, F.col("title").alias(f"{s}_title"))
    return df


def class_graph(images: DataFrame, posts: DataFrame, *, bits_col: str = "bits",
                max_a: int = P.RETURN_MAX_A, max_d: int = P.RETURN_MAX_D,
                salt_rows: int | None = P.DEFAULT_SALT_ROWS,
                index: tuple[DataFrame, DataFrame] | None = None,
                only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, adj)``.

    nodes: ``id, k, animated, datetime, s`` (s = post ordering struct of
    ``KEY_FIELDS``; ``posts`` may be placed already), one row per image with its class ``k``.  adj: ``k1, k2`` for every class
    pair linked by a reported edge, both orientations, plus ``(k, k)``.
    ``index`` is a stored ``(members, root_edges)`` pair index; without it
    the index is computed from ``images``.  ``only`` (post ``id``) keeps the
    classes that are linked to one of those posts' classes.
    """
    prepare(images.sparkSession)   # checkpoint folder, session settings
    members, root_edges = index if index is not None else \
        P.near_index(images, bits_col=bits_col, salt_rows=salt_rows)
    exact = P.exact_classes(images).select("id", "root")
    cls = (members.select("id", F.col("root").alias("k"), F.lit(False).alias("animated"))
           .unionByName(exact.select("id", F.col("root").alias("k"), F.lit(True).alias("animated"))))
    posts = posts if "place" in posts.columns else placed(posts)
    p = posts.select(F.col("id").alias("pid"), *KEY_FIELDS)
    imgs = images.select("id", "post_id")
    nodes = (cls.join(imgs, "id").join(p, F.col("post_id") == F.col("pid"))
             .select("id", "k", "animated", "datetime", F.struct(*KEY_FIELDS).alias("s")))
    linked = root_edges.filter((F.col("diff_a") <= max_a) & (F.col("diff_d") <= max_d))
    adj = (linked.select(F.col("a").alias("k1"), F.col("b").alias("k2"))
           .unionByName(linked.select(F.col("b").alias("k1"), F.col("a").alias("k2")))
           .unionByName(cls.select(F.col("k").alias("k1"), F.col("k").alias("k2")).distinct()))
    if only is not None:
        asked = images.join(only.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("id")
        near = adj.join(cls.join(asked, "id", "left_semi").select(F.col("k").alias("k1")).distinct(), "k1", "left_semi")
        nodes = nodes.join(near.select(F.col("k2").alias("k")).distinct(), "k", "left_semi").select(*nodes.columns)
    # Both are read by several branches of the history plans: write them once
    # (reliable checkpoint in the shared folder) instead of re-running the
    # class, image and post joins per branch.
    return nodes.checkpoint(eager=True), adj.checkpoint(eager=True)


SLICE_SECONDS = 3600   # level-1 time slice of the running aggregate


def earlier_summary(nodes: DataFrame, adj: DataFrame, slice_seconds: int = SLICE_SECONDS,
                    asked: DataFrame | None = None) -> DataFrame:
    """Per image with at least one strictly older duplicate:
    ``id, seen, first, last`` (first/last are post structs).

    Post times are whole seconds and only strictly older posts count, so
    posts of the same second never count each other and no ordering inside
    a second is needed.  The summary is built from aggregated rows only:

    1. members are aggregated per (class, slice, second) (count, min, max;
       a partial aggregate, so a class of any size is spread over tasks);
    2. a running prefix over the seconds of a (class, slice) gives the part
       of the slice before each second (at most ``slice_seconds`` rows per
       window);
    3. a running prefix over the slices of a class gives all earlier slices
       (one row per slice).

    Each query row (post x, linked class) reads both prefixes with
    equi-joins; the parts are combined per query with a map-side aggregate.
    ``asked`` (image ``id``) limits the query rows.
    """
    sl = F.floor(F.col("datetime") / F.lit(slice_seconds)).cast("bigint")
    s_type = nodes.schema["s"].dataType
    askers = nodes if asked is None else nodes.join(asked.select("id"), "id", "left_semi")
    queries = (askers.select(F.col("id").alias("qid"), F.col("k").alias("k1"), "datetime")
               .join(adj, "k1")
               .select("qid", F.col("k2").alias("k"), "datetime", sl.alias("sl")))
    q_keys = queries.select("k", "sl", "datetime").distinct()

    def with_queries(agg: DataFrame, keys: list[str], q: DataFrame) -> DataFrame:
        empty = q.select(*keys, F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(s_type).alias("mn"),
                         F.lit(None).cast(s_type).alias("mx"))
        return (agg.unionByName(empty).groupBy(*keys)
                .agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx")))

    per_sec = (nodes.select("k", sl.alias("sl"), "datetime", "s").groupBy("k", "sl", "datetime")
               .agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("mn"), F.max("s").alias("mx")))
    secs = with_queries(per_sec, ["k", "sl", "datetime"], q_keys)
    w_sec = Window.partitionBy("k", "sl").orderBy("datetime").rowsBetween(Window.unboundedPreceding, -1)
    sec_prefix = secs.select("k", "sl", "datetime", F.sum("n").over(w_sec).alias("sn"),
                             F.min("mn").over(w_sec).alias("smn"), F.max("mx").over(w_sec).alias("smx"))
    per_slice = per_sec.groupBy("k", "sl").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"),
                                                F.max("mx").alias("mx"))
    slices = with_queries(per_slice, ["k", "sl"], q_keys.select("k", "sl").distinct())
    w_sl = Window.partitionBy("k").orderBy("sl").rowsBetween(Window.unboundedPreceding, -1)
    sl_prefix = slices.select("k", "sl", F.sum("n").over(w_sl).alias("pn"),
                              F.min("mn").over(w_sl).alias("pmn"), F.max("mx").over(w_sl).alias("pmx"))
    per_class = (queries.join(sec_prefix, ["k", "sl", "datetime"]).join(sl_prefix, ["k", "sl"])
                 .select("qid", (F.coalesce("pn", F.lit(0)) + F.coalesce("sn", F.lit(0))).alias("n"),
                         F.least("pmn", "smn").alias("first"), F.greatest("pmx", "smx").alias("last"))
                 .filter(F.col("n") > 0))
    return (per_class.groupBy(F.col("qid").alias("id"))
            .agg(F.sum("n").alias("seen"), F.min("first").alias("first"), F.max("last").alias("last")))


def oldest_neighbour(nodes: DataFrame, adj: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Per image (of ``asked``): the oldest other duplicate posted at or before it
    (``id, nb``), or no row when there is none.  Members of a class of many images
    meet its smallest one by broadcast, so no task takes the class."""
    m1 = nodes.groupBy("k").agg(F.min("s").alias("m1"), F.count(F.lit(1)).alias("n_rows"))
    m2 = (join_back(nodes.select("k", "s"), m1, "k", "n_rows").filter(F.col("s.link") != F.col("m1.link"))
          .groupBy("k").agg(F.min("s").alias("m2")))
    # read back from files, so that a class asked for by very many posts can be split
    best = stored(m1.drop("n_rows").join(m2, "k", "left"), "oldest")
    askers = nodes if asked is None else nodes.join(asked.select("id"), "id", "left_semi")
    q = (askers.select(F.col("id").alias("qid"), F.col("k").alias("k1"), F.col("datetime").alias("qdt"),
                      F.col("s.link").alias("qlink"))
         .join(adj, "k1").join(best, F.col("k2") == F.col("k")))
    cand = F.when(F.col("m1.link") == F.col("qlink"), F.col("m2")).otherwise(F.col("m1"))
    return (q.select("qid", "qdt", cand.alias("cand"))
            .filter(F.col("cand").isNotNull() & (F.col("cand.datetime") <= F.col("qdt")))
            .groupBy(F.col("qid").alias("id")).agg(F.min("cand").alias("nb")))


def flatten(col: str, title: bool) -> list[Column]:
    """The post struct ``col`` as ``<col>_<field>`` columns, with the title looked up if it was."""
    return [*[F.col(f"{col}.{c}").alias(f"{col}_{c}") for c in POST_FIELDS[:-1]], *([F.col(f"{col}_title")] if title else [])]


def duplicate_summary(images: DataFrame, posts: DataFrame, titles: tuple[str, ...] = ("first", "last"), **kw) -> DataFrame:
    """AGG9: per post with strictly older duplicates: seen, first seen and
    last seen post, ``trip`` (first and last differ by link) and whether the
    match is by digest (animated) or by similarity.  ``only`` (post ``id``)
    limits the posts that are answered, ``titles`` the titles that are looked up."""
    posts = placed(posts)
    nodes, adj = class_graph(images, posts, **kw)
    img = images.select("id", "post_id", "animated")
    if kw.get("only") is not None:
        img = img.join(kw["only"].select(F.col("id").alias("post_id")), "post_id", "left_semi")
        summ = earlier_summary(nodes, adj, asked=img)
    else:
        summ = earlier_summary(nodes, adj)
    return (with_titles(summ.join(img, "id"), posts, titles)
            .select(F.col("post_id").alias("id"), F.col("animated").alias("by_crc"), "seen",
                    *flatten("first", "first" in titles), *flatten("last", "last" in titles),
                    (F.col("first.link") != F.col("last.link")).alias("trip")))


def neighbours_before(images: DataFrame, posts: DataFrame, titles: tuple[str, ...] = ("nb",), **kw) -> DataFrame:
    """JN8/JN9/JN11/JN12: the first row of the stored-edge lookup (oldest
    duplicate at or before the post), routed by the image's animated flag.
    ``titles`` empty leaves the title out."""
    posts = placed(posts)
    nodes, adj = class_graph(images, posts, **kw)
    img = images.select("id", "post_id", "animated")
    if kw.get("only") is not None:
        img = img.join(kw["only"].select(F.col("id").alias("post_id")), "post_id", "left_semi")
        nb = oldest_neighbour(nodes, adj, asked=img)
    else:
        nb = oldest_neighbour(nodes, adj)
    return with_titles(nb.join(img, "id"), posts, titles).select(
        F.col("post_id").alias("id"), "animated", *flatten("nb", "nb" in titles))


def reposts_by_link(links: DataFrame, images: DataFrame, posts: DataFrame, **kw) -> DataFrame:
    """JN11 by link: for every ``link`` asked for (column ``link``, each once) its post's
    oldest duplicate at or before it.  ``status``: ``unknown`` (no such post),
    ``no_repost`` or ``repost``; then ``id``, ``animated`` and the ``nb_*`` columns."""
    asked = links.select("link").distinct().join(posts.select("id", "link"), "link", "left")
    found = neighbours_before(images, posts, only=asked.filter("id IS NOT NULL").select("id"), **kw)
    status = (F.when(F.col("id").isNull(), "unknown").when(F.col("nb_link").isNull(), "no_repost").otherwise("repost"))
    return asked.join(found, "id", "left").withColumn("status", status)
