"""Captured pages: ranges, restarts, live counters (SRC3, AGG11)."""

from pyspark.sql import functions as F

from dupstream.schemas import IMAGES, POSTS
from dupstream.sources.pages import PAGES_PER_CHUNK, PageSource, capture
from dupstream.streaming import page_stream as PS

DECISION = "link string, decision boolean"


def _pages(spark, numbers):
    body = F.concat(F.lit('{"success": true, "status": 200, "data": [{"id": "'), F.col("page").cast("string"),
                    F.lit('", "ups": 90, "downs": 1, "is_album": false}, 17]}'))
    return spark.createDataFrame([(n,) for n in numbers], "page bigint").withColumn("body", body)


def _load(spark, folder, **options):
    spark.dataSource.register(PageSource)
    return sorted(r["page"] for r in spark.read.format("captured_pages").options(path=folder, **options).load().collect())


def test_ranges_cross_chunks(spark, tmp_path):
    folder = str(tmp_path / "in")
    assert _load(spark, folder) == []
    numbers = [0, 3, PAGES_PER_CHUNK - 1, PAGES_PER_CHUNK, 2 * PAGES_PER_CHUNK + 5]
    capture(_pages(spark, numbers), folder)
    assert _load(spark, folder) == numbers
    assert _load(spark, folder, **{"from": 3, "upto": PAGES_PER_CHUNK}) == numbers[1:3]
    assert _load(spark, f"file://{folder}", **{"from": PAGES_PER_CHUNK}) == numbers[3:]


def test_a_restart_takes_only_new_pages(spark, tmp_path):
    base = str(tmp_path)
    posts, images = spark.createDataFrame([], POSTS), spark.createDataFrame([], IMAGES)
    none = spark.createDataFrame([], DECISION)
    images = spark.range(5).select(F.col("id"), F.col("id").alias("post_id"), F.lit(9).cast("bigint").alias("size"))

    def run():
        PS.run_page_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", posts, images, none)
        return PS.counters(spark, f"{base}/out").first().asDict()
    capture(_pages(spark, [0, 1]), f"{base}/in")
    assert run() == {"updates": 2, "known": 0, "skipped": 0, "errors": 2, "albums": 0}
    assert run()["updates"] == 2                                       # nothing new
    capture(_pages(spark, [2, 7]), f"{base}/in")                       # post 7 has no image
    assert run() == {"updates": 3, "known": 0, "skipped": 0, "errors": 5, "albums": 0}
    rows = spark.read.parquet(f"{base}/out/outcomes").select("page", "outcome").collect()
    assert sorted(map(tuple, rows)) == [(0, "new"), (1, "new"), (2, "new"), (7, "error")]


def test_a_replayed_batch_counts_once(spark, tmp_path):
    base = str(tmp_path)
    posts = spark.createDataFrame([(1, None, "1", 0, "t", 5)], POSTS)
    images = spark.range(5).select(F.col("id"), F.col("id").alias("post_id"), F.lit(9).cast("bigint").alias("size"))
    refused = spark.createDataFrame([("2", False), ("3", True)], DECISION)
    pages = _pages(spark, [1, 2, 3]).unionByName(_pages(spark, [9]).withColumn("body", F.lit('{"success": true, "data": [5]}')))
    for _ in range(2):
        PS.take_pages(pages, 0, base, posts, images, refused)
    assert PS.counters(spark, base).first().asDict() == {"updates": 2, "known": 1, "skipped": 1, "errors": 4, "albums": 0}
