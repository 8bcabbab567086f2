"""The versioned store: a batch is seen whole or not at all, refreshes rewrite only the
slots they touch, and an ingest ends in messages and a log."""

import pytest
from pyspark.sql import functions as F

from dupstream.operators import pairs as P
from dupstream.operators import store as SO
from dupstream.sources.tables import api_records, images_fx, posts_fx
from tests.conftest import SF0001

TABLES = ("posts", "images", "near_pairs", "exact_pairs", "messages", "report_log", "page_counts")


@pytest.fixture(scope="module")
def halves(spark):
    rec, im, po = api_records(spark, SF0001), images_fx(spark, SF0001), posts_fx(spark, SF0001)
    row = po.agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi")).first()
    split = (row["lo"] + row["hi"]) // 2
    first = (rec.filter(F.col("datetime") < split), im.filter(F.col("datetime") < split))
    one = rec.filter(F.col("datetime") < split).filter(~F.col("is_album")).join(
        im.filter("size > 0").select(F.col("id").cast("string").alias("id")), "id", "left_semi").orderBy("datetime").limit(1)
    again = rec.filter(F.col("datetime") >= split).unionByName(one.withColumn("account_id", F.lit(77).cast("bigint")))
    return first, (again, im.filter(F.col("datetime") >= split)), one.first()["id"], row["hi"] + 86400


def rows(spark, store, name):
    df = SO.read_table(spark, store, name)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def ingest(spark, store, halves, upto=2):
    SO.create_store(spark, store)
    for n, (rec, im) in enumerate(halves[:2][:upto]):
        SO.ingest_batch(spark, store, rec, im, n, now=halves[3])


def test_a_batch_that_breaks_off_is_not_seen_and_can_be_run_again(spark, tmp_path, halves, monkeypatch):
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    ingest(spark, whole, halves)
    ingest(spark, broken, halves, upto=1)
    before = {t: rows(spark, broken, t) for t in TABLES}
    commit = SO._commit

    def fails(*a):
        raise RuntimeError("lost")
    monkeypatch.setattr(SO, "_commit", fails)
    with pytest.raises(RuntimeError, match="lost"):
        SO.ingest_batch(spark, broken, *halves[1], 1, now=halves[3])
    assert {t: rows(spark, broken, t) for t in TABLES} == before
    monkeypatch.setattr(SO, "_commit", commit)
    for _ in range(2):                               # run again, then replayed after it was finished
        SO.ingest_batch(spark, broken, *halves[1], 1, now=halves[3])
        assert {t: rows(spark, broken, t) for t in TABLES} == {t: rows(spark, whole, t) for t in TABLES}
    assert SO.read_table(spark, whole, "posts", before=1).count() == len(before["posts"]) < len(rows(spark, whole, "posts"))


def test_a_refresh_rewrites_only_its_slot(spark, tmp_path, halves):
    store = str(tmp_path)
    ingest(spark, store, halves)
    first, second = (SO._snapshot(spark, store, "ingest", n) for n in (1, 2))
    link = halves[2]
    slot = SO.read_table(spark, store, "posts").filter(F.col("link") == link).select(SO.slot_of("posts").alias("s")).first()["s"]
    for name in SO.SLOT_KEY:
        kept = {s for n, s, f in first if n == name and (n, s, f) in second}
        assert kept == {s for n, s, _ in first if n == name} - {slot}
    assert SO.read_table(spark, store, "posts").filter(F.col("link") == link).first()["userid"] == 77
    im = SO.read_table(spark, store, "images")
    assert [str(r["post_id"]) for r in im.filter("last_checked IS NOT NULL").collect()] == [link]
    assert im.count() == im.select("id").distinct().count()


def test_the_ingest_ends_in_pairs_messages_log_and_counts(spark, tmp_path, halves):
    store = str(tmp_path)
    ingest(spark, store, halves)
    im = images_fx(spark, SF0001).join(SO.read_table(spark, store, "images").select("id"), "id", "left_semi")
    got, want = SO.read_table(spark, store, "near_pairs"), P.near_pairs(im)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    texts, log = SO.read_table(spark, store, "messages"), SO.read_table(spark, store, "report_log")
    assert texts.count() == log.count() > 0
    assert {r["post_id"] for r in texts.collect()} == {r["post_id"] for r in log.collect()}
    sums = SO.read_table(spark, store, "page_counts").agg(*[F.sum(c).alias(c) for c in ("updates", "known", "skipped", "errors", "albums")]).first()
    assert sums["updates"] == SO.read_table(spark, store, "posts").count() and sums["known"] == 1 and sums["albums"] > 0


def test_always_post_reports_every_repeat(spark, tmp_path, halves):
    store = str(tmp_path)
    ingest(spark, store, halves, upto=1)
    few = SO.read_table(spark, store, "messages").count()
    SO.ingest_batch(spark, store, *halves[1], 1, now=halves[3], always_post=True)
    every = SO.read_table(spark, store, "messages").count()
    other = str(tmp_path / "rules")
    ingest(spark, other, halves)
    assert every - few > SO.read_table(spark, other, "messages").count() - few


def test_tables_of_a_new_store_are_empty(spark, tmp_path):
    SO.create_store(spark, str(tmp_path))
    for name, schema in SO.TABLES.items():
        df = SO.read_table(spark, str(tmp_path), name)
        assert df.count() == 0 and set(df.columns) == set(schema.fieldNames())
