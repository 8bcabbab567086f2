"""Banded similarity join: edge rows of the bounds and windows, band
placement, copies, salting; history ordering."""

import pytest
from pyspark.sql import functions as F

from dupstream.functions.bits import exact_bits, reference_bits
from dupstream.operators import history as H
from dupstream.operators import lookup as L
from dupstream.operators import pairs as P
from dupstream.schemas import WORDS
from tests.conftest import SF0001

MIN = -(2 ** 63)
BASE = [0x0F0F0F0F0F0F0F0F, 0x1234567812345678, 0x0123456789ABCDEF, 0x7F00FF00FF00FF00,
        0x00000000FFFF0000, 0, 0x0000FFFF00000000, 0x1111111111111111,
        0x2222222222222222, 0x3333333333333333, 0x4444444444444444, 0x5555555555555555]


def images(spark, rows):
    """rows: (id, words dict overrides, animated)"""
    data = []
    for rid, over, anim in rows:
        w = list(BASE)
        for k, v in over.items():
            w[WORDS.index(k)] = v
        data.append((rid, rid, anim, *w, f"crc{rid}", rid * 10))
    schema = "id bigint, post_id bigint, animated boolean, " + ", ".join(f"{w} bigint" for w in WORDS) + \
             ", crc string, datetime bigint"
    df = spark.createDataFrame(data, schema)
    return df.select("*", reference_bits().alias("bits"), exact_bits().alias("tbits"))


def pairs_of(df):
    return {(r["a"], r["b"]) for r in df.collect()}


def test_sign_bit_window_reference_vs_exact(spark):
    im = images(spark, [(1, {"ahash_1": 1, "ahash_2": 0, "ahash_3": 0, "ahash_4": 0}, False),
                        (2, {"ahash_1": MIN + 1, "ahash_2": 0, "ahash_3": 0, "ahash_4": 0}, False)])
    assert pairs_of(P.near_pairs(im)) == set()
    assert pairs_of(P.near_pairs(im, bits_col="tbits")) == {(1, 2)}


def test_ingest_window_inclusive_22_and_23(spark):
    w = 2 ** 21 - 1
    im = images(spark, [(1, {"dhash_h_1": w}, False),
                        (2, {"dhash_h_1": w ^ MIN}, False),                    # bits +22
                        (3, {"dhash_h_1": w ^ MIN, "dhash_h_2": BASE[5] | 32}, False)])  # +23
    bits = {r["id"]: r["bits"] for r in im.collect()}
    assert bits[2] - bits[1] == 22 and bits[3] - bits[1] == 23
    got = pairs_of(P.near_pairs(im))
    assert (1, 2) in got and (1, 3) not in got and (2, 3) in got


def test_lookup_window_exclusive_19_and_20(spark):
    w = 2 ** 22 - 1
    index = images(spark, [(1, {"dhash_h_1": w}, False)])
    q20 = images(spark, [(10, {"dhash_h_1": w ^ MIN}, False)])                         # +20
    q19 = images(spark, [(11, {"dhash_h_1": (2 ** 23 - 1) ^ MIN}, False)])
    posts = spark.createDataFrame([(1, None, "1", 10, "t", 5)],
                                  "id bigint, userurl string, link string, datetime bigint, title string, userid bigint")
    b = {r["id"]: r["bits"] for r in index.unionByName(q20).unionByName(q19).collect()}
    assert b[10] - b[1] == 20 and abs(b[11] - b[1]) == 19
    n20 = L.similar_lookup(q20, index, posts)["count"].first()["n"]
    n19 = L.similar_lookup(q19, index, posts)["count"].first()["n"]
    assert (n20, n19) == (0, 1)


def test_stored_thresholds(spark):
    a5 = {"ahash_1": BASE[0] ^ 0b11111}          # diff_a 5
    a6 = {"ahash_1": BASE[0] ^ 0b111111}         # diff_a 6
    dh8 = {"dhash_h_3": BASE[6] ^ 0xFF}         # diff_dh 8
    dh9 = {"dhash_h_3": BASE[6] ^ 0x1FF}
    im = images(spark, [(1, {}, False), (2, a5, False), (3, a6, False), (4, dh8, False), (5, dh9, False)])
    got = {p for p in pairs_of(P.near_pairs(im)) if 1 in p}
    assert got == {(1, 2), (1, 4)}


def test_five_differences_in_five_bands(spark):
    # one differing bit in each of bands 0-4 (high halves of ahash_1..4, low half of ahash_1)
    over = {"ahash_1": BASE[0] ^ (1 << 40) ^ 1, "ahash_2": BASE[1] ^ (1 << 40),
            "ahash_3": BASE[2] ^ (1 << 40), "ahash_4": BASE[3] ^ (1 << 40)}
    im = images(spark, [(1, {}, False), (2, over, False)])
    rows = P.near_pairs(im).collect()
    assert [(r["a"], r["b"], r["diff_a"]) for r in rows] == [(1, 2, 5)]


def test_copies_collapse_to_root(spark):
    im = images(spark, [(5, {}, False), (7, {}, False), (9, {}, False),
                        (11, {"dhash_v_1": BASE[8] ^ 1}, False)])
    rows = {(r["a"], r["b"], r["diff_a"], r["diff_d"]) for r in P.near_pairs(im).collect()}
    assert rows == {(5, 7, 0, 0), (5, 9, 0, 0), (5, 11, 0, 1)}


def test_zero_sum_rejection(spark):
    from dupstream.functions.bits import signed_sum_is_zero
    df = spark.createDataFrame([(1, -1) + (0,) * 10], ", ".join(f"{w} bigint" for w in WORDS))
    assert df.select(signed_sum_is_zero().alias("z")).first()["z"]


def test_salted_equals_unsalted(spark):
    from dupstream.sources.tables import images_fx
    im = images_fx(spark, SF0001)
    plain = P.near_pairs(im, salt_rows=None)
    salted = P.near_pairs(im, salt_rows=5)
    assert plain.count() > 0
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_second_level_keys_change_no_pair(spark):
    from dupstream.sources.tables import images_fx
    im = images_fx(spark, SF0001)
    for pairs in (lambda **k: P.near_pairs(im, **k), lambda **k: P.near_pairs(im, bits_col="tbits", **k),
                  lambda **k: P.total_distance_pairs(im, **k)):
        want = sorted(map(tuple, pairs(split_rows=None).collect()))
        assert want
        for split in (1, 3):
            assert sorted(map(tuple, pairs(split_rows=split).collect())) == want
        assert sorted(map(tuple, pairs(split_rows=1, salt_rows=2).collect())) == want
    for th in (P.LOOKUP, P.COMBINED):
        found = [sorted(map(tuple, P.similarity_join(im, im, th, split_rows=s).collect())) for s in (None, 1)]
        assert found[0] and found[0] == found[1]


def test_word_parts_cover_the_words_once(spark):
    for n in (4, 6, 9, 11):
        parts = P.word_parts(["x", "y", "z", "w"], n)
        assert len(parts) == n
        df = spark.range(1).select(*[F.lit(-1).cast("bigint").alias(c) for c in "xyzw"])
        assert sum(df.selectExpr(*[f"bit_count({p})" for p in parts]).first()) == 256


def test_candidates_of_a_hot_band_stay_flat(spark):
    """Rows that share one aHash band but not their dHash: with the second level the
    candidates grow with the rows, without it with their square."""
    def candidates(n, split):
        rows = spark.range(n).select("id", F.lit(7).cast("bigint").alias("ahash_1"),
                                     *[F.xxhash64(F.col("id"), F.lit(w)).alias(w) for w in WORDS[1:]], F.lit(100).alias("bits"))
        lx = P._explode_bands(rows.withColumnRenamed("id", "l_id"), 6, "bits", 23, (0, 1))
        rx = P._explode_bands(rows.withColumnRenamed("id", "r_id"), 6, "bits", 23, (0,)).drop("bkt_off")
        lx, rx, keys = P._leveled(lx, rx, ["band_no", "band", "bkt"], P.word_parts(P.DHASH_H, 9), split, None, 1000)
        return lx.groupBy(*keys).count().withColumnRenamed("count", "n").join(rx.groupBy(*keys).count(), keys).selectExpr(
            "sum(n * count)").first()[0]
    assert candidates(2000, None) > 5 * candidates(800, None)
    small, large = candidates(800, 64), candidates(2000, 64)
    assert large < 2.6 * small and large < candidates(2000, None) / 20


def test_equal_datetime_strict_vs_at_or_before(spark):
    # two copies posted at the same second: neither is "earlier" (strict),
    # each is the other's neighbour at or before.
    im = images(spark, [(1, {}, False), (2, {}, False)]).withColumn("datetime", F.lit(100).cast("bigint"))
    posts = spark.createDataFrame([(1, "u1", "1", 100, "a", 1), (2, "u2", "2", 100, "b", 2)],
                                  "id bigint, userurl string, link string, datetime bigint, title string, userid bigint")
    assert H.duplicate_summary(im, posts).count() == 0
    nb = {r["id"]: r["nb_link"] for r in H.neighbours_before(im, posts).collect()}
    assert nb == {1: "2", 2: "1"}


def test_null_first_post_order(spark):
    im = images(spark, [(1, {}, False), (2, {}, False), (3, {}, False)])
    posts = spark.createDataFrame([(1, None, "1", 50, "a", 1), (2, "u2", "2", 50, "b", 2),
                                   (3, "u3", "3", 90, "c", 3)],
                                  "id bigint, userurl string, link string, datetime bigint, title string, userid bigint")
    s = H.duplicate_summary(im, posts).filter("id = 3").first()
    assert (s["seen"], s["first_link"], s["last_link"], s["trip"]) == (2, "1", "2", True)


def test_titles_decide_last_and_are_looked_up(spark):
    """Posts that agree in all but the title are told apart by it, null first, though the
    history plans carry no title."""
    im = images(spark, [(i, {}, False) for i in (1, 2, 3, 4)])
    posts = spark.createDataFrame([(1, None, "1", 50, "x", 1), (2, None, "1", 50, "b", 1), (2, None, "1", 50, None, 1),
                                   (3, "u3", "3", 90, "c", 3), (3, "u3", "3", 90, "c", 3), (4, "u4", "4", 95, "d", None)],
                                  "id bigint, userurl string, link string, datetime bigint, title string, userid bigint")
    got = H.duplicate_summary(im, posts)
    s = got.filter("id = 3").first()
    assert (s["seen"], s["first_title"], s["last_title"]) == (6, None, "x")       # the post comes twice and is asked twice
    assert got.filter("id = 4").first()["last_title"] == "c"
    nodes, _ = H.class_graph(im, posts)
    assert "title" not in nodes.schema["s"].dataType.fieldNames()
    bare = H.duplicate_summary(im, posts, titles=())
    assert set(got.columns) - set(bare.columns) == {"first_title", "last_title"}
    assert sorted(map(str, bare.collect())) == sorted(map(str, got.select(*bare.columns).collect()))


def test_total_distance_pairs_bound(spark):
    over = {"dhash_v_4": BASE[11] ^ 0xFFFFF}       # 20 bits
    over21 = {"dhash_v_4": BASE[11] ^ 0x1FFFFF}    # 21 bits
    im = images(spark, [(1, {}, False), (2, over, False), (3, over21, False)])
    got = {(r["a"], r["b"], r["distance"]) for r in P.total_distance_pairs(im).collect()}
    assert (1, 2, 20) in got and not any(p[:2] == (1, 3) for p in got)


def test_earlier_summary_independent_of_slice_width(spark):
    from dupstream.sources.tables import images_fx, posts_fx
    nodes, adj = H.class_graph(images_fx(spark, SF0001), posts_fx(spark, SF0001))
    fine = H.earlier_summary(nodes, adj, slice_seconds=7)
    coarse = H.earlier_summary(nodes, adj, slice_seconds=10 ** 9)
    assert fine.count() == coarse.count() > 0
    assert fine.exceptAll(coarse).count() == 0


def test_third_of_rows_are_copies(spark):
    """A group of copies holding a third of all rows stays linear in the pair
    table, and every copy's history still counts all its older copies."""
    rows = []
    for i in range(1, 61):                      # 60 copies of one image
        rows.append((i, {}, False))
    for i in range(61, 181):                    # 120 unrelated images
        rows.append((i, {"ahash_1": BASE[0] ^ (i * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF),
                         "ahash_2": BASE[1] ^ (i * 0x632BE59BD9B4E019 & 0x7FFFFFFFFFFFFFFF),
                         "ahash_3": i, "ahash_4": -i}, False))
    im = images(spark, rows)
    pairs = P.near_pairs(im, salt_rows=10)
    copies = {(r["a"], r["b"]) for r in pairs.collect() if r["a"] == 1}
    assert copies == {(1, b) for b in range(2, 61)}
    assert pairs.count() < 60 + 120                      # not 60*59/2 pairs
    posts = im.select("id", F.lit(None).cast("string").alias("userurl"), F.col("id").cast("string").alias("link"),
                      F.col("datetime"), F.lit("t").alias("title"), F.col("id").alias("userid"))
    s = {r["id"]: (r["seen"], r["first_link"], r["last_link"]) for r in H.duplicate_summary(im, posts).collect()}
    for x in range(2, 61):                               # datetime = id * 10
        assert s[x] == (x - 1, "1", str(x - 1))


def test_survey_fixture_counts(spark):
    """With fingerprints from the document id alone (the survey's derived
    table) the near-pair counts are the published ones: 879 stored, 666
    reported (reference bits), 982 / 707 with true popcounts."""
    from dupstream.sources.tables import _images_fx
    im = _images_fx(spark, SF0001, copies_share_fingerprint=False).cache()
    ref, exact = P.near_pairs(im), P.near_pairs(im, bits_col="tbits")
    assert (ref.count(), P.returned(ref).count()) == (879, 666)
    assert (exact.count(), P.returned(exact).count()) == (982, 707)
    im.unpersist()


def test_copies_in_derived_table(spark):
    """Documents with identical text share one fingerprint: their images form
    one class, linked by copy edges to the smallest id."""
    from dupstream.sources.tables import images_fx
    im = images_fx(spark, SF0001)
    still = im.filter(~F.col("animated"))
    groups = still.groupBy("crc").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("root")).filter("n > 1")
    expected = {(r["root"], i) for r in groups.collect()
                for i in [x["id"] for x in still.filter(F.col("crc") == r["crc"]).collect()] if i != r["root"]}
    edges = {(r["a"], r["b"]) for r in P.near_pairs(im).filter("diff_a = 0 AND diff_d = 0").collect()}
    assert expected and expected <= edges


def test_sampled_hot_key_detection_salts_a_hot_band(spark):
    """A band key far above the threshold is found on the sample and salted;
    the pairs are the same as without salting."""
    from dupstream.operators.pairs import _explode_bands, _salted
    rows = [(i, {"ahash_1": BASE[0] ^ (i << 40), "ahash_2": 0, "ahash_3": 0, "ahash_4": 0}, False)
            for i in range(1, 3001)]
    im = images(spark, rows)
    lx = _explode_bands(im.select(F.col("id").alias("l_id"), *WORDS, "bits"), 6, "bits", 23, (0, 1))
    rx = _explode_bands(im.select(F.col("id").alias("r_id"), *WORDS, "bits"), 6, "bits", 23, (0,)).drop("bkt_off")
    _, salted_r, keys = _salted(lx, rx, ["band_no", "band", "bkt"], 1000, 1000, "r_id")
    assert keys[-1] == "salt"
    assert salted_r.select("salt").distinct().count() > 1
    a = P.near_pairs(im, salt_rows=None)
    b = P.near_pairs(im, salt_rows=1000)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_hot_classes_join_by_broadcast_with_equal_results(spark):
    from dupstream.operators import stats
    from dupstream.sources.tables import images_fx
    im = images_fx(spark, "/root/testdata/sf0.001").cache()
    hot = im.filter("not animated").limit(1).crossJoin(spark.range(300).withColumnRenamed("id", "k"))
    im = im.unionByName(hot.withColumn("id", hot.k + 10_000).select(*im.columns)).cache()
    for fn in (lambda h: P.fingerprint_classes(im, hot_rows=h)[1], lambda h: P.exact_classes(im, hot_rows=h),
               lambda h: stats.hash_running(im, hot_rows=h)):
        assert sorted(map(tuple, fn(100).collect())) == sorted(map(tuple, fn(10**9).collect()))


def test_no_task_takes_a_whole_hot_class(spark):
    from dupstream.operators.skew import join_back
    rows = spark.range(20_000, numPartitions=8).selectExpr("id", "if(id % 10 < 3, -1, id) as k")
    per_key = rows.groupBy("k").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n"))
    got = join_back(rows, per_key, "k", "n", hot_rows=100)
    assert got.count() == 20_000
    hot = got.filter("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in hot) == 6_000 and max(r["count"] for r in hot) <= 6_000 / 8 + 1


def test_rows_cross_the_shuffle_once_per_band(spark):
    """Rows of no hot key: six band rows an image, on one exchange for both sides of a self join."""
    rows = spark.range(400).select("id", *[F.xxhash64(F.col("id"), F.lit(w)).alias(w) for w in WORDS],
                                   F.lit(100).alias("bits"), F.lit(False).alias("animated"))
    _, edges = P.near_index(rows)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    side = P._banded(rows, P._halves(P.AHASH)[:6])
    lx, rx, keys = P._leveled(side.withColumnRenamed("id", "l_id"), side.withColumnRenamed("id", "r_id"), ["band_no", "band"],
                              P.word_parts(P.DHASH_H, 9), 64, 1000, 1000, bucket=P._buckets("bits", 22, True))
    assert keys == ["band_no", "band"] and lx.count() == rx.count() == 6 * 400


@pytest.mark.parametrize("self_join", [True, False])
def test_buckets_of_hot_keys_lose_no_pair(spark, monkeypatch, self_join):
    """Blank images, which share every band, with and without the bits bucket: the same
    pairs, each once; images of far apart bits are not compared."""
    rows = spark.range(60).select("id", *[F.lit(0).cast("bigint").alias(w) for w in WORDS[:-1]],
                                  F.expr("shiftleft(1L, cast(id % 6 as int))").alias(WORDS[-1]),
                                  (F.col("id") * 7).cast("int").alias("bits"))
    def pairs():
        got = P.similarity_join(rows, rows, self_join=self_join, split_rows=4).collect()
        return sorted((min(r[:2]), max(r[:2]), *r[2:]) if self_join else tuple(r) for r in got)
    plain = pairs()
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    assert pairs() == plain
    wanted = [(a, b) for a in range(60) for b in range(60) if abs(a - b) * 7 <= 22 and (a < b or not self_join)]
    assert [p[:2] for p in plain] == sorted(wanted)


def test_titles_are_ranked_only_where_posts_agree(spark):
    schema = "id bigint, userurl string, link string, datetime bigint, title string, userid bigint"
    rows = [(1, None, "1", 5, "b", 1), (2, "u", "2", 5, "a", 1)]
    alone = H.placed(spark.createDataFrame(rows, schema))
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["id"], r["place"], r["first"]) for r in alone.orderBy("id").collect()] == [(1, 1, True), (2, 1, True)]
    agreeing = [(3, None, "1", 5, "a", 1), (4, None, "1", 5, "b", 1)]
    got = {r["id"]: (r["place"], r["first"]) for r in H.placed(spark.createDataFrame(rows + agreeing, schema)).collect()}
    assert got[3] == (1, True) and got[2] == (1, True) and {got[1], got[4]} == {(2, True), (2, False)}


def test_hot_bands_are_left_out_where_others_do(spark):
    """Images that share both halves of one aHash word: the six other halves serve, and no
    row is multiplied; the pairs are those of a comparison of all with all."""
    rows = spark.range(300).select("id", F.lit(0).cast("bigint").alias("ahash_1"),
                                   *[F.xxhash64((F.col("id") / 2).cast("int"), F.lit(w)).alias(w) for w in WORDS[1:]],
                                   F.lit(100).alias("bits"), F.lit(False).alias("animated"))
    rows = rows.withColumn("ahash_2", F.expr("ahash_2 ^ (id % 2)"))
    assert P._coolest_bands(rows, 6, 64) == [1, 2, 3, 5, 6, 7]
    got = {(r["a"], r["b"], r["diff_a"]) for r in P.near_index(rows)[1].collect()}
    assert got == {(i, i + 1, 1) for i in range(0, 300, 2)}


def test_edges_meet_the_texts_of_both_ends(spark):
    """As a join by each id, with ids that repeat, are missing or have no text, however
    neighbourhoods are cut into places."""
    from collections import Counter
    pairs = [(1, k) for k in range(2, 12)] + [(a, b) for a in range(20, 28) for b in range(a + 1, 28)] + [(2, 30), (2, 30), (30, 99), (40, 41)]
    docs = [(i, bytearray(b"t%d" % i)) for i in range(42)] + [(3, bytearray(b"again")), (21, bytearray(b"t21")), (None, bytearray(b"x"))]
    docs = [(i, None if i == 40 else t) for i, t in docs]
    edges, texts = spark.createDataFrame(pairs, "a bigint, b bigint"), spark.createDataFrame(docs, "doc bigint, t binary")
    want = Counter((a, b, x and bytes(x), y and bytes(y)) for a, b in pairs for i, x in docs if i == a for k, y in docs if k == b)
    for place_edges in (1024, 3, 1):
        got = P.with_texts(edges, texts, "doc", "t", place_edges).collect()
        assert Counter((r["a"], r["b"], r["ta"] and bytes(r["ta"]), r["tb"] and bytes(r["tb"])) for r in got) == want, place_edges


def test_neighbourhoods_share_a_place_until_they_are_large(spark):
    group = lambda lo, n: [(a, b) for a in range(lo, lo + n) for b in range(a + 1, lo + n)]
    edges = spark.createDataFrame(group(0, 5) + group(100, 40), "a bigint, b bigint")
    of = {(r["a"], r["b"]): r["place"] for r in P.places(edges, place_edges=100).collect()}
    small, large = [p for e, p in of.items() if e[0] < 100], [p for e, p in of.items() if e[0] >= 100]
    assert len(of) == 10 + 780 and len(set(small)) == 1
    assert len(set(large)) > 20 and max(large.count(p) for p in set(large)) < 100
