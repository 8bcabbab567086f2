"""A stored index of 768-bit vectors for batches of queries (JN15): check, insert, and
insert-and-get, without building the index again.

Vectors come as the twelve words of ``schemas.WORDS``.  Two vectors match when they
differ in at most ``max_total`` bits, so one of ``max_total + 1`` disjoint 32-bit bands
is equal: a query probes that many buckets and misses nothing (random hyperplanes
would).  The rows of a crowded bucket are split by a second band, as in
``pairs.total_distance_pairs``.

State under ``store``: ``bands/part=b<n>/slot=<s>`` holds the band rows of the vectors
that batch ``n`` brought first (equal vectors are one class, stored once), with the slot a
hash of the band, so that a batch reads only its slots; ``members/batch_id=<n>`` names
each image's class.  A batch reads smaller batch numbers only and overwrites its own, so a
replay gives the same answer and the same state.

The reference asks for one image at a time and stores it afterwards; here an image of a
batch sees everything stored before the batch and the images of the batch with smaller ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupstream.operators import pairs as P
from dupstream.operators.skew import join_back
from dupstream.schemas import WORDS
from dupstream.session import prepare, stored
from dupstream.streaming.index_stream import band_parts

SLOTS = 16             # fixed when the store is created
MOST = 20              # default of the rows that a query gets
BANDS = T.StructType([T.StructField("band_no", T.IntegerType()), T.StructField("band", T.LongType()),
                      T.StructField("r_id", T.LongType()), *[T.StructField(w, T.LongType()) for w in WORDS],
                      T.StructField("slot", T.IntegerType())])
MEMBERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("batch_id", T.LongType())])


def _banded(vectors: DataFrame, max_total: int, slots: int) -> DataFrame:
    """Band rows of ``id`` and the words."""
    n = max_total + 1
    if n + 1 > 2 * len(WORDS):
        raise ValueError(f"total distance {max_total} needs {n + 1} of {2 * len(WORDS)} bands")
    rows = vectors.select(F.col("id").alias("r_id"), *WORDS, F.posexplode(F.expr(f"array({', '.join(P._halves(WORDS)[:n])})"))
                          .alias("band_no", "band"))
    return rows.withColumn("slot", F.pmod(F.xxhash64("band_no", "band"), F.lit(slots)).cast("int")).select(*BANDS.fieldNames())


def _stored_bands(spark: SparkSession, store: str, before: int, asked: DataFrame) -> DataFrame:
    parts = band_parts(spark, f"{store}/bands", before)
    if not parts:
        return spark.createDataFrame([], BANDS)
    slots = [r["slot"] for r in asked.select("slot").distinct().collect()]          # a fixed few numbers
    return (spark.read.schema(BANDS).option("basePath", f"{store}/bands").parquet(*parts)
            .select(*BANDS.fieldNames()).filter(F.col("slot").isin(slots)))


def _matches(asked: DataFrame, index: DataFrame, max_total: int, split_rows: int | None) -> DataFrame:
    """``l_id, r_id, distance, fresh`` of band rows that share a band, each pair once."""
    n = max_total + 1
    lx, rx, keys = P._leveled(asked.withColumnRenamed("r_id", "l_id").drop("slot"), index.drop("slot"), ["band_no", "band"],
                              P._halves(WORDS)[:n + 1], split_rows, P.DEFAULT_SALT_ROWS, P.DEFAULT_BROADCAST_ROWS, "band_no")
    l, r = lx.alias("l"), rx.alias("r")
    left, right = P._halves(WORDS, "l"), P._halves(WORDS, "r")
    keep = P._first_equal(left[:n], right[:n]) == F.col("l.band_no")
    if "part" in keys:
        second = P._first_equal(left[:n + 1], right[:n + 1], unless="l.band_no")
        keep = keep & ((F.col("l.part") == -1) | (second == F.col("l.part")))
    return (l.join(r, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]).filter(keep)
            .select(F.col("l.l_id").alias("l_id"), F.col("r.r_id").alias("r_id"), P.sum_distance(WORDS).alias("distance"), "r.fresh")
            .filter(F.col("distance") <= max_total))


def _classes(vectors: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(classes with ``id`` the smallest, images with their class)."""
    rows = vectors.select("id", F.struct(*WORDS).alias("fp"))
    sizes = rows.groupBy("fp").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n_rows"))
    classes = stored(sizes.select(F.col("cid").alias("id"), *[F.col(f"fp.{w}").alias(w) for w in WORDS], "n_rows"), what)
    back = classes.select(F.struct(*WORDS).alias("fp"), F.col("id").alias("cid"), "n_rows")
    return classes, join_back(rows, back, "fp", "n_rows").select("id", "cid")


def check(queries: DataFrame, store: str, *, before: int = 1 << 62, max_total: int = P.TOTAL_MAX, slots: int = SLOTS,
          split_rows: int | None = P.TOTAL_SPLIT_ROWS) -> DataFrame:
    """Per query: ``q``, ``best`` (smallest distance to a stored vector, null beyond
    ``max_total``) and ``found``."""
    spark = queries.sparkSession
    prepare(spark)
    classes, members = _classes(queries, "vector-queries")
    asked = _banded(classes, max_total, slots)
    index = _stored_bands(spark, store, before, asked).withColumn("fresh", F.lit(False))
    best = _matches(asked, index, max_total, split_rows).groupBy("l_id").agg(F.min("distance").alias("best"))
    best = classes.select(F.col("id").alias("cid"), "n_rows").join(best.withColumnRenamed("l_id", "cid"), "cid", "left")
    return join_back(members, best, "cid", "n_rows").select(F.col("id").alias("q"), "best", F.col("best").isNotNull().alias("found"))


def insert_and_get(batch: DataFrame, batch_id: int, store: str, *, most: int | None = MOST, max_total: int = P.TOTAL_MAX,
                   slots: int = SLOTS, split_rows: int | None = P.TOTAL_SPLIT_ROWS) -> DataFrame:
    """Store a batch (``id`` and the words) and return, per image, its nearest matches:
    ``q, id, distance, rank`` (by distance, then id; at most ``most``, None gives all)."""
    spark = batch.sparkSession
    prepare(spark)
    classes, members = _classes(batch, "vector-classes")
    own = _banded(classes, max_total, slots)
    index = (_stored_bands(spark, store, batch_id, own).withColumn("fresh", F.lit(False))
             .unionByName(own.withColumn("fresh", F.lit(True))))
    found = stored(_matches(own, index, max_total, split_rows), "vector-matches")
    known = found.filter("NOT fresh AND distance = 0").select(F.col("l_id").alias("cid"), F.col("r_id").alias("scid"))
    sizes = classes.select(F.col("id").alias("cid"), "n_rows").join(known, "cid", "left")
    named = join_back(members, sizes, "cid", "n_rows")
    (named.select("id", F.coalesce("scid", "cid").alias("cid")).write.mode("overwrite").parquet(f"{store}/members/batch_id={batch_id}"))
    new = classes.join(known.select(F.col("cid").alias("id")), "id", "left_anti")
    (_banded(new, max_total, slots).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{store}/bands/part=b{batch_id}"))
    # the ``most`` smallest ids of a class are enough for every query that matches it, of
    # those stored before and of the batch alike
    earlier = spark.read.schema(MEMBERS).parquet(f"{store}/members").filter(F.col("batch_id") < batch_id)
    pool = (earlier.select("id", F.col("cid").alias("r_id"), F.lit(False).alias("fresh"))
            .join(found.filter("NOT fresh").select("r_id").distinct(), "r_id", "left_semi")
            .unionByName(members.select("id", F.col("cid").alias("r_id"), F.lit(True).alias("fresh"))))
    if most is not None:
        first = Window.partitionBy("r_id", "fresh").orderBy("id")
        pool = pool.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place")
    pairs = found.join(pool, ["r_id", "fresh"]).select("l_id", "id", "distance", "fresh")
    askers = members.select(F.col("id").alias("q"), F.col("cid").alias("l_id"))
    hits = askers.join(pairs, "l_id").filter(~F.col("fresh") | (F.col("id") < F.col("q"))).select("q", "id", "distance")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)
