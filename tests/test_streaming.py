"""Structured Streaming: incremental index equals the batch index, whatever
the micro-batch sizes; the stateful limiter equals the batch limiter."""

import pytest
from pyspark.sql import functions as F

from dupstream.operators import limits as LM
from dupstream.operators import pairs as P
from dupstream.sources.tables import images_fx, miss_events
from dupstream.streaming import index_stream as S
from dupstream.streaming import miss_stream as M
from tests.conftest import SF0001


@pytest.mark.parametrize("chunks", [1, 3])
def test_stream_index_equals_batch(spark, tmp_path, chunks):
    im = images_fx(spark, SF0001)
    base = str(tmp_path)
    S.write_arrivals(im, f"{base}/in", chunks)
    S.run_index_stream(spark, f"{base}/in", im.schema, f"{base}/store", f"{base}/ckpt")
    got = S.read_pairs(spark, f"{base}/store")
    want = P.near_pairs(im)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_copy_in_a_later_batch_links_to_the_stored_root(spark, tmp_path):
    from dupstream.operators.pairs import still_images
    im = images_fx(spark, SF0001)
    base = str(tmp_path)
    first = im.filter("id < 100")
    later = im.filter("id >= 100")
    S.process_batch(first, 0, f"{base}/store", slots=4)
    # a copy of image 0 (same words, new id) arrives two batches later
    copy = still_images(im).filter("id = 0").withColumn("id", F.lit(10 ** 6).cast("bigint"))
    S.process_batch(later, 1, f"{base}/store", slots=4)
    S.process_batch(copy, 2, f"{base}/store", slots=4)
    got = S.read_pairs(spark, f"{base}/store").filter("b = 1000000").collect()
    assert [(r["a"], r["diff_a"], r["diff_d"]) for r in got] == [(0, 0, 0)]


def test_stream_replay_is_idempotent(spark, tmp_path):
    im = images_fx(spark, SF0001)
    base = str(tmp_path)
    halves = [im.filter("id >= 100"), im.filter("id < 100")]
    for n, batch in enumerate(halves):
        S.process_batch(batch, n, f"{base}/store")
    first = sorted(S.read_pairs(spark, f"{base}/store").collect())
    # re-running a batch rewrites its rows instead of appending
    for n in (1, 0):
        S.process_batch(halves[n], n, f"{base}/store")
        assert sorted(S.read_pairs(spark, f"{base}/store").collect()) == first


@pytest.mark.parametrize("by_time", [True, False])
def test_stream_miss_limit_equals_batch(spark, tmp_path, by_time):
    ev = miss_events(spark, SF0001)
    # a user with a burst over the turn of an hour, twice in some seconds, and a null user
    burst = spark.createDataFrame([(10 ** 6, 3500 + 5 * (i // 2)) for i in range(80)] + [(None, 3600), (None, 3590)],
                                  "userid bigint, ts bigint")
    ev = ev.filter("ts >= 0").select("userid", (F.col("ts") - ev.agg(F.min("ts")).first()[0] + 1).alias("ts")).unionByName(burst)
    base = str(tmp_path)
    M.write_arrivals(ev, f"{base}/in", 3, by_time)
    span = ev.agg(F.max("ts") - F.min("ts")).first()[0]
    M.run_miss_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", late=span + 1)
    got = M.read_counts(spark, f"{base}/out")
    want = LM.miss_counts(ev).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("blocked").count() > 0
    # what is written again does not change what is read
    spark.read.parquet(f"{base}/out").write.mode("append").parquet(f"{base}/twice")
    spark.read.parquet(f"{base}/out").write.mode("append").parquet(f"{base}/twice")
    assert M.read_counts(spark, f"{base}/twice").count() == got.count()


def test_the_limiter_has_a_group_per_shard_and_hour(spark, tmp_path):
    """Many users of one hour share a few groups, and each keeps counts of its own."""
    ev = spark.range(4000).selectExpr("nullif(id % 800, 0) AS userid", "id DIV 800 * 100 + 10000 AS ts")
    base = str(tmp_path)
    M.write_arrivals(ev, f"{base}/in", 2, by_time=False)
    M.run_miss_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", state_partitions=2, late=10_000, shards=4)
    got, want = M.read_counts(spark, f"{base}/out"), LM.miss_counts(ev)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    states = spark.read.format("statestore").load(f"{base}/ckpt")
    assert 0 < states.count() <= 5                     # four shards and the null user's


def test_the_limiter_drops_state_the_watermark_has_passed(spark, tmp_path):
    base = str(tmp_path)
    for n, ts in enumerate([100, 50_000, 50_000 + 7_300, 60]):     # the last one is later than ``late`` allows
        spark.createDataFrame([(1, ts)], "userid bigint, ts bigint").coalesce(1).write.mode("append").parquet(f"{base}/in")
        M.run_miss_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", state_partitions=1)
    got = sorted((r["ts"], r["recent"]) for r in M.read_counts(spark, f"{base}/out").collect())
    assert got == [(100, 1), (50_000, 1), (57_300, 1)]


def test_a_batch_reads_only_the_slots_of_its_bands(spark, tmp_path):
    im = P.still_images(images_fx(spark, SF0001))
    store = str(tmp_path)
    S.process_batch(im, 0, store, slots=32)
    bands = S.open_store(spark, store, P.STORE, "bits", 32)
    parts = S.band_parts(spark, bands, 1)
    assert parts == [f"{bands}/part=b0"]
    one = P.band_rows(im.filter("id = 0")).withColumn("slot", S._slot(32))
    asked = [r["slot"] for r in one.select("slot").distinct().collect()]
    assert 0 < len(asked) <= 6
    files = S.read_bands(spark, bands, parts, "bits", asked).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("slot=")[1].split("/")[0]) for r in files} == set(asked)


@pytest.mark.parametrize("order", ["ascending", "descending", "mixed"])
def test_the_pairs_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    im = images_fx(spark, SF0001)
    copies = P.still_images(im).filter("id % 7 = 0").withColumn("id", F.col("id") - 10 ** 6)     # older ids
    im = im.unionByName(copies)
    chunk = {"ascending": F.expr("id < 60"), "descending": F.expr("id >= 60"), "mixed": F.expr("id % 2 = 0")}[order]
    store = str(tmp_path)
    S.process_batch(im.filter(chunk & (F.col("id") >= 0)), 0, store, slots=4)
    S.process_batch(im.filter(~chunk & (F.col("id") >= 0)), 1, store, slots=4)
    S.process_batch(im.filter(F.col("id") < 0), 2, store, slots=4)
    got, want = S.read_pairs(spark, store), P.near_pairs(im)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert S.read_pairs(spark, store, before=1).count() < got.count()


def test_compaction_keeps_the_rows_in_one_part(spark, tmp_path):
    im = images_fx(spark, SF0001)
    store = str(tmp_path)
    for n in range(4):
        S.process_batch(im.filter(F.col("id") % 4 == n), n, store, slots=2, compact_every=2)
    bands = S.open_store(spark, store, P.STORE, "bits", 2)
    assert [p.rsplit("=", 1)[1] for p in S.band_parts(spark, bands, 4)] == ["b2", "b3", "c1"]
    S.compact(spark, bands, 3)
    assert [p.rsplit("=", 1)[1] for p in S.band_parts(spark, bands, 4)] == ["c3"]
    S.process_batch(im.limit(0), 4, store, slots=2)
    assert sorted(map(tuple, S.read_pairs(spark, store).collect())) == sorted(map(tuple, P.near_pairs(im).collect()))


def test_a_store_of_other_bands_is_refused(spark, tmp_path):
    S.process_batch(images_fx(spark, SF0001).limit(5), 0, str(tmp_path), slots=2)
    with pytest.raises(ValueError, match="was created as"):
        S.process_batch(images_fx(spark, SF0001).limit(5), 1, str(tmp_path), slots=4)


def test_stream_restart_processes_only_new_files(spark, tmp_path):
    """A restarted query (same checkpoint) picks up where it stopped: the
    new arrivals are indexed against everything stored before."""
    from pyspark.sql import functions as F
    from dupstream.operators.pairs import still_images
    im = images_fx(spark, SF0001)
    base = str(tmp_path)
    S.write_arrivals(im, f"{base}/in", 2)
    S.run_index_stream(spark, f"{base}/in", im.schema, f"{base}/store", f"{base}/ckpt", slots=4)
    first = S.read_pairs(spark, f"{base}/store").count()
    extra = still_images(im).filter("id < 3").withColumn("id", F.col("id") + 10 ** 6)
    extra.coalesce(1).write.mode("append").parquet(f"{base}/in")
    S.run_index_stream(spark, f"{base}/in", im.schema, f"{base}/store", f"{base}/ckpt", slots=4)
    got = S.read_pairs(spark, f"{base}/store")
    batches = spark.read.parquet(f"{base}/store/facts").select("batch_id").distinct().count()
    want = P.near_pairs(im.unionByName(extra))
    assert batches == 3 and got.count() > first
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
