"""Incremental near-duplicate index with Structured Streaming (ST1).

Arriving images are processed per micro-batch in ``foreachBatch``.  The result does
not depend on the order of arrival: a fingerprint *class* is stored under the id that
brought it (``cid``), and its root, the smallest id of all its images, is elected when
the pairs are read, so an older image that arrives late takes the root over.

State under ``store``:

* ``bands/part=b<n>/slot=<s>``: band rows of the classes that batch ``n`` brought.  The
  slot is a hash of the band key; a batch reads only the slots that its own band keys
  fall into, and only the two hashed levels of a key's rows meet
  (``pairs.match_bands``).  Every ``compact_every`` batches the parts so far are
  rewritten as one, ``bands/part=c<n>``, so a batch opens a bounded number of parts;
* ``facts/batch_id=<n>``: copies ``(id, cid)`` and edges ``(cid, cid, distances)``.

A micro-batch groups its images into classes, matches them in one join against the
stored rows and its own, and appends.  A class at distance 0 of a stored one joins it; the
others are new.  All output of a batch is written with overwrite under its number and a
batch reads only smaller numbers, so a replay replaces exactly its own rows.  Parts are
read only when their write has finished (``_SUCCESS``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupstream.operators import pairs as P
from dupstream.operators.skew import join_back
from dupstream.schemas import WORDS
from dupstream.session import path_of, prepare, stored

EDGE_COLS = ["a", "b", "diff_a", "diff_d"]
SLOTS = 16             # slots of the stored bands, fixed when the store is created
COMPACT_EVERY = 16     # batches between two rewrites of the stored bands
COPY, EDGE = 0, 1
FACTS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                      T.StructField("diff_a", T.IntegerType()), T.StructField("diff_d", T.IntegerType())])


def _slot(slots: int):
    return F.pmod(F.xxhash64("band_no", "band"), F.lit(slots)).cast("int")


def _band_schema(bits_col: str) -> T.StructType:
    return T.StructType([T.StructField("band_no", T.IntegerType()), T.StructField("band", T.LongType()),
                         T.StructField("bkt", T.IntegerType()), T.StructField("r_id", T.LongType()),
                         *[T.StructField(w, T.LongType()) for w in WORDS], T.StructField(bits_col, T.IntegerType()),
                         T.StructField("slot", T.IntegerType())])


def _folder(th: P.Thresholds, bits_col: str, slots: int) -> str:
    width = "none" if th.max_delta is None else str(th.max_delta + 1)
    return f"bands_a{th.max_a}_w{width}_{bits_col}_s{slots}"


def open_store(spark: SparkSession, store: str, th: P.Thresholds, bits_col: str, slots: int) -> str:
    """Folder of the stored bands.  Bands, buckets and slots are part of its name; a store
    that holds another one is refused, since its rows would be missed."""
    folder = _folder(th, bits_col, slots)
    fs, path = path_of(spark, store)
    others = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    others = [n for n in others if n.startswith("bands_") and n != folder]
    if others:
        raise ValueError(f"{store} was created as {others[0]}, not as {folder}")
    return f"{store}/{folder}"


def band_parts(spark: SparkSession, bands: str, before: int) -> list[str]:
    """Finished parts with the rows of all batches before ``before``: the newest
    compaction and the batches after it."""
    fs, path = path_of(spark, bands)
    if not fs.exists(path):
        return []
    found = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part=") and fs.exists(path_of(spark, f"{bands}/{name}/_SUCCESS")[1]):
            found[name[5], int(name[6:])] = f"{bands}/{name}"
    base = max((n for kind, n in found if kind == "c" and n < before), default=-1)
    return [p for (kind, n), p in sorted(found.items()) if n < before and (n > base if kind == "b" else n == base)]


def read_bands(spark: SparkSession, bands: str, parts: list[str], bits_col: str, slots: list[int] | None = None) -> DataFrame:
    schema = _band_schema(bits_col)
    if not parts:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", bands).parquet(*parts).select(*schema.fieldNames())
    return df if slots is None else df.filter(F.col("slot").isin(slots))


def _write_bands(rows: DataFrame, path: str) -> None:
    rows.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(path)


def compact(spark: SparkSession, bands: str, upto: int, bits_col: str = "bits") -> None:
    """Rewrite the rows of all batches up to ``upto`` as one part."""
    parts = band_parts(spark, bands, upto + 1)
    if len(parts) > 1:
        _write_bands(read_bands(spark, bands, parts, bits_col), f"{bands}/part=c{upto}")


def process_batch(batch: DataFrame, batch_id: int, store: str, th: P.Thresholds = P.STORE,
                  bits_col: str = "bits", slots: int = SLOTS, compact_every: int = COMPACT_EVERY) -> None:
    spark = batch.sparkSession
    prepare(spark)
    bands = open_store(spark, store, th, bits_col, slots)
    if batch_id and batch_id % compact_every == 0:
        compact(spark, bands, batch_id - 1, bits_col)
    still = P.still_images(batch).withColumn("fp", F.struct(*WORDS))
    classes = stored(still.groupBy("fp").agg(F.min("id").alias("id"), F.min(bits_col).alias(bits_col), F.count(F.lit(1)).alias("n_rows"))
                     .select("id", *[F.col(f"fp.{w}").alias(w) for w in WORDS], bits_col, "n_rows"), "batch-classes")
    own = P.band_rows(classes, th, bits_col=bits_col).withColumn("slot", _slot(slots))
    parts = band_parts(spark, bands, batch_id)
    if parts:
        asked = [r["slot"] for r in own.select("slot").distinct().collect()]       # at most ``slots`` numbers
        earlier = read_bands(spark, bands, parts, bits_col, asked)
        index = earlier.withColumn("fresh", F.lit(False)).unionByName(own.withColumn("fresh", F.lit(True)))
        found = P.match_bands(classes, index, th, bits_col=bits_col, extra=("fresh",))
    else:                                        # both sides are the same rows: one exchange serves both
        found = P.match_bands(classes, own, th, bits_col=bits_col).withColumn("fresh", F.lit(True))
    found = stored(found.filter(~F.col("fresh") | (F.col("l_id") < F.col("r_id"))), "batch-matches")
    equal = ~F.col("fresh") & (F.col("diff_a") + F.col("diff_dh") + F.col("diff_dv") == 0)
    known = found.filter(equal).select(F.col("l_id").alias("id"), F.col("r_id").alias("cid"))
    named = classes.join(known, "id", "left").withColumn("cid", F.coalesce("cid", "id"))
    members = still.select(F.col("id").alias("image"), "fp")
    if parts:
        per_class = named.select(F.struct(*WORDS).alias("fp"), "cid", "n_rows")
    else:
        per_class = classes.select(F.struct(*WORDS).alias("fp"), F.col("id").alias("cid"), "n_rows")
    copies = (join_back(members, per_class, "fp", "n_rows").filter("image != cid")
              .select(F.lit(COPY).alias("kind"), F.col("image").alias("a"), F.col("cid").alias("b"),
                      F.lit(0).alias("diff_a"), F.lit(0).alias("diff_d")))
    links, new = found, classes
    if parts:                                    # a copy of a stored class has that class's edges
        dropped = known.select(F.col("id").alias("k"))
        links = links.join(dropped, F.col("l_id") == F.col("k"), "left_anti")
        links = links.filter(~F.col("fresh")).unionByName(
            links.filter("fresh").join(dropped, F.col("r_id") == F.col("k"), "left_anti"))
        new = classes.join(known.select("id"), "id", "left_anti")
    edges = links.select(F.lit(EDGE).alias("kind"), F.col("l_id").alias("a"), F.col("r_id").alias("b"), "diff_a",
                         (F.col("diff_dh") + F.col("diff_dv")).alias("diff_d"))
    facts = copies.unionByName(edges)
    rows = P.band_rows(new, th, bits_col=bits_col).withColumn("slot", _slot(slots))
    with ThreadPoolExecutor(2) as both:          # two independent jobs of one batch
        writes = [both.submit(inheritable_thread_target(spark)(lambda: facts.write.mode("overwrite").parquet(f"{store}/facts/batch_id={batch_id}"))),
                  both.submit(inheritable_thread_target(spark)(lambda: _write_bands(rows, f"{bands}/part=b{batch_id}")))]
        for w in writes:
            w.result()


def run_index_stream(spark: SparkSession, source_dir: str, schema, store: str, checkpoint: str,
                     files_per_batch: int = 1, bits_col: str = "bits", slots: int = SLOTS) -> None:
    """Process every file under ``source_dir`` (then stop) into ``store``."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_dir))
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: process_batch(df, bid, store, bits_col=bits_col, slots=slots))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_pairs(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The edge table of all batches (or of those before ``before``), ``a < b``: classes
    are named by their smallest image, whatever order they arrived in."""
    facts = spark.read.schema(T.StructType([*FACTS.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{store}/facts")
    if before is not None:
        facts = facts.filter(F.col("batch_id") < before)
    copies = facts.filter(F.col("kind") == COPY).select(F.col("a").alias("id"), F.col("b").alias("cid"))
    roots = (copies.groupBy("cid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
             .select("cid", F.least("cid", "least").alias("root"), "n_rows"))
    moved = roots.filter("root != cid").select("cid", "root")          # classes whose first image was not the smallest
    edges = facts.filter(F.col("kind") == EDGE).select(*EDGE_COLS)
    for side in ("a", "b"):
        names = moved.select(F.col("cid").alias(side), "root")
        edges = edges.join(names, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "diff_a", "diff_d")
    held = join_back(copies, roots, "cid", "n_rows").filter("id != root").select("root", "id")
    held = held.unionByName(moved.select("root", F.col("cid").alias("id")))
    return edges.unionByName(held.select(F.col("root").alias("a"), F.col("id").alias("b"),
                                         F.lit(0).alias("diff_a"), F.lit(0).alias("diff_d")))


def read_classes(spark: SparkSession, store: str, images: DataFrame, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, root_edges)`` as ``pairs.near_index`` gives them, with classes named
    by the image that brought them; ``images`` are the stored ones."""
    facts = spark.read.schema(T.StructType([*FACTS.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{store}/facts")
    if before is not None:
        facts = facts.filter(F.col("batch_id") < before)
    copies = facts.filter(F.col("kind") == COPY).select(F.col("a").alias("id"), F.col("b").alias("cid"))
    members = P.still_images(images).select("id").join(copies, "id", "left").select("id", F.coalesce("cid", "id").alias("root"))
    return members, facts.filter(F.col("kind") == EDGE).select(*EDGE_COLS)


ROWS_PER_FILE = 1_000_000   # bound on the rows one writer task handles


def write_arrivals(images: DataFrame, folder: str, chunks: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write images as files by id range in one job, for ``chunks`` micro-batches.
    Returns the files per micro-batch: more when a file would pass ``rows_per_file``."""
    files = max(1, -(-images.count() // (chunks * rows_per_file)))
    images.repartitionByRange(chunks * files, "id").write.mode("append").parquet(folder)
    return files
