"""Summons: every status, both sinks, and replays that add nothing."""

import pytest
from pyspark.sql import functions as F

from dupstream.functions import text as X
from dupstream.operators import history as H
from dupstream.operators import report as R
from dupstream.operators import store as SO
from dupstream.sources.tables import api_records, images_fx, posts_fx
from dupstream.streaming import summon_stream as SU
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("summons"))
    rec, im = api_records(spark, SF0001), images_fx(spark, SF0001)
    row = posts_fx(spark, SF0001).agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi")).first()
    split, now = (row["lo"] + row["hi"]) // 2, row["hi"] + 86400
    SO.create_store(spark, store)
    SO.ingest_batch(spark, store, rec.filter(F.col("datetime") < split), im.filter(F.col("datetime") < split), 0, now=now)
    links = rec.filter(~F.col("is_album")).join(im.filter("size > 0").select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    known = [r["id"] for r in links.filter(F.col("datetime") < split).orderBy("id").collect()]
    later = [r["id"] for r in links.filter(F.col("datetime") >= split).orderBy("id").collect()]
    asked = known + known[:3] + later[:15] + ["nowhere"]
    body = "someone mentioned you in a comment: glory at " + X.GALLERY_URL + "{}/comment/1/"
    notes = [(i, 1, i, "48", body.format(k)) for i, k in enumerate(asked)]
    notes += [(500, 1, 500, "48", "mentioned you in a comment: hello"), (501, 1, 501, "7", body.format(known[0])), (502, 1, 502, "48", "hi")]
    notes = spark.createDataFrame(notes, "notif_id long, conv long, seq long, with_account string, body string")
    SU.answer_summons(spark, store, notes, rec.filter(F.col("datetime") >= split), im, 0, 1, now)
    return store, notes, rec.filter(F.col("datetime") >= split), im, now, known, later


def rows(spark, store, name):
    df = SO.read_table(spark, store, name)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_each_summons_has_its_status(spark, world):
    store, notes, _, _, _, known, later = world
    got = {r["notif_id"]: r["status"] for r in SO.read_table(spark, store, "summons").collect()}
    n = len(known)
    assert got[500] == "unparsable" and 501 not in got and 502 not in got
    assert {got[i] for i in range(n + 3, n + 18)} == {"ingested"} and got[n + 18] == "not_found"
    log0 = {r["post_id"] for r in SO.read_table(spark, store, "report_log", before=1, writer_before=("summons", 0)).collect()}
    po, im = (SO.read_table(spark, store, t, before=1) for t in ("posts", "images"))
    nb = {r["id"] for r in H.neighbours_before(im, po).collect()}
    for i, link in enumerate(known):
        want = "already_reported" if link in log0 else "repost" if int(link) in nb else "no_repost"
        assert got[i] == want
    assert [got[n + i] for i in range(3)] == [got[i] for i in range(3)]
    assert {"repost", "no_repost"} <= set(got.values())


def test_one_message_and_log_line_per_answered_post(spark, world):
    store = world[0]
    texts = [r["post_id"] for r in SO.read_table(spark, store, "messages").collect()]
    assert len(texts) == len(set(texts)) and sorted(texts) == sorted(r["post_id"] for r in SO.read_table(spark, store, "report_log").collect())
    reposts = {r["post_link"] for r in SO.read_table(spark, store, "summons").filter("status = 'repost'").collect()}
    assert reposts <= set(texts)
    assert SO.read_table(spark, store, "posts").filter(F.col("link").isin(world[6][:15])).count() == 15


def test_a_replay_adds_nothing(spark, world, monkeypatch):
    store, notes, rec, im, now = world[:5]
    tables = ("summons", "messages", "report_log", "posts", "images", "near_pairs")
    before = {t: rows(spark, store, t) for t in tables}
    SU.answer_summons(spark, store, notes, rec, im, 0, 1, now)
    # broken off between the ingest and the answers: the same classes again
    done = SO.is_done
    monkeypatch.setattr(SO, "is_done", lambda s, st, w, n: False if w == "summons" else done(s, st, w, n))
    SU.answer_summons(spark, store, notes, rec, im, 0, 1, now)
    assert {t: rows(spark, store, t) for t in tables} == before


def test_lookup_by_link_tells_unknown_links(spark):
    im, po = images_fx(spark, SF0001), posts_fx(spark, SF0001)
    links = po.select("link").unionByName(spark.createDataFrame([("nowhere",), ("nowhere",)], "link string"))
    got = H.reposts_by_link(links, im, po)
    want = H.neighbours_before(im, po)
    assert sorted(map(str, got.filter("status = 'repost'").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.filter("status = 'unknown'").select("link").collect() == [("nowhere",)]
    assert got.count() == po.count() + 1


def test_always_post_passes_over_the_rules(spark):
    im, po = images_fx(spark, SF0001), posts_fx(spark, SF0001)
    summary = H.duplicate_summary(im, po)
    none = spark.createDataFrame([], "userid bigint")
    every = R.report_decision(summary, po, none, 0, always_post=True)
    assert every.filter("post_it").count() == summary.count() > R.report_decision(summary, po, none, 0).filter("post_it").count()
