"""Hash groups and running repeats (AGG10, WIN4), pages from files (SRC3/SRC4)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dupstream.operators import stats as ST
from dupstream.schemas import WORDS
from dupstream.sources import envelope as EV


def _images(spark):
    # ids 1..40; the aHash repeats every 3 ids, dHashes every 5 and 7
    rows = []
    for i in range(1, 41):
        a = [i % 3, 1, 2, 3]
        dh = [i % 5, 4, 5, 6]
        dv = [i % 7, 7, 8, 9]
        rows.append((i, *a, *dh, *dv))
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{w} bigint" for w in WORDS))


def test_hash_groups(spark):
    g = {(r["kind"], r["h1"]): (r["n"], r["first_id"], r["last_id"]) for r in ST.hash_groups(_images(spark)).collect()}
    assert g[("a", 0)] == (13, 3, 39)
    assert g[("dv", 6)] == (5, 6, 34)
    assert len(g) == 3 + 5 + 7


def test_hash_running_two_levels_match_one_window(spark):
    im = _images(spark)
    s = ST.stacked_hashes(im)
    w = Window.partitionBy("kind", "h1", "h2", "h3", "h4").orderBy("id")
    naive = (s.select("id", "kind", (F.row_number().over(w) - 1).cast("int").alias("n_before"),
                      F.min("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first_id"),
                      F.lag("id").over(w).alias("prev_id"))
             .filter("n_before > 0"))
    for width in (1, 4, 10 ** 9):
        got = ST.hash_running(im, id_slice=width)
        assert got.count() == naive.count() == 40 * 3 - 15
        assert got.exceptAll(naive).count() == 0, width


def test_envelopes_from_files(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "page_0001.json").write_text('{"success": true, "status": 200, "data": [{"id": "a1", "ups": 50, "downs": 3}, 7]}\n')
    (d / "page_0002.json").write_text('{"success": false, "status": 403, "data": {"error": {"message": "nope"}}}\n')
    (d / "page_0003.json").write_text('{"success": true, "data": [{"id": \n')
    (d / "page_0004.json").write_text('\n')
    (d / "page_0005.json").write_text('{"success": false, "data": []}\n')
    summ = {r["page"]: r for r in EV.page_summary(EV.split_envelopes(EV.read_envelopes(spark, str(d)))).collect()}
    assert (summ[1]["outcome"], summ[1]["n_posts"], summ[1]["n_bad"]) == ("ok", 1, 1)
    assert (summ[2]["outcome"], summ[2]["error_message"]) == ("error", "nope")
    assert summ[3]["outcome"] == "corrupt"
    assert (summ[4]["outcome"], summ[4]["error_message"]) == ("error", "empty response")
    assert (summ[5]["outcome"], summ[5]["error_message"]) == ("error", "empty return")


def test_post_json_lines(spark, tmp_path):
    p = tmp_path / "posts.json"
    p.write_text('{"id": "x", "is_album": false, "ups": 3, "downs": 1}\n{broken\n')
    rows = EV.read_posts_json(spark, str(p)).collect()
    assert rows[0]["id"] == "x" and rows[0]["_corrupt_record"] is None
    assert rows[1]["_corrupt_record"] == "{broken"


def test_pair_counts_are_those_of_the_expanded_pairs(spark):
    from dupstream.operators.stats import pair_counts
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)], "id long, root long")
    edges = spark.createDataFrame([(1, 4), (1, 5)], "a long, b long")
    images = spark.createDataFrame([(7, True, "x"), (8, True, "x"), (9, True, "x"), (10, True, "y"), (11, False, "x")],
                                   "id long, animated boolean, crc string")
    got = {r.metric: r.value for r in pair_counts(images, members, edges).collect()}
    # near: 3 + 1 inside classes, 3 * 1 + 3 * 2 across; exact: 3
    assert got == {"near_pairs": 13.0, "exact_pairs": 3.0, "reposts": 16.0}


def test_lookup_caps_are_a_parameter(spark):
    from dupstream.operators.lookup import digest_lookup
    from dupstream.sources.tables import images_fx, posts_fx
    im, po = images_fx(spark, "/root/testdata/sf0.001"), posts_fx(spark, "/root/testdata/sf0.001")
    every = digest_lookup(im, im, po, most=None)["all"].count()
    assert digest_lookup(im, im, po, most=1)["all"].count() == im.join(po, im.post_id == po.id).select(im.id).count() <= every
