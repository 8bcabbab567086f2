"""The stored 768-bit index against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dupstream.operators import vector_index as V
from dupstream.schemas import WORDS


def vectors(seed=1):
    """id -> twelve signed words: families of near vectors, copies and far ones."""
    rnd = random.Random(seed)
    out, base = {}, rnd.getrandbits(768)
    for i in range(120):
        if i % 40 == 0:
            base = rnd.getrandbits(768)
        v = base if i % 3 == 0 else base ^ sum(1 << rnd.randrange(768) for _ in range(rnd.randrange(1, 14)))
        out[i] = v if i % 10 else rnd.getrandbits(768)
    return out


def frame(spark, rows):
    def words(v):
        return [(v >> 64 * k & (2**64 - 1)) - (2**64 if v >> 64 * k + 63 & 1 else 0) for k in range(12)]
    return spark.createDataFrame([(i, *words(v), "x") for i, v in rows], ", ".join(["id long", *[f"{w} long" for w in WORDS], "cid string"]))


def brute(vs, batches, most):
    out = []
    for n, batch in enumerate(batches):
        before = [i for b in batches[:n] for i in b]
        for q in batch:
            hits = sorted((d, i) for i in before + [i for i in batch if i < q]
                          for d in [(vs[q] ^ vs[i]).bit_count()] if d <= 20)
            out += [(q, i, d, r + 1) for r, (d, i) in enumerate(hits[:most])]
    return sorted(out)


@pytest.mark.parametrize("most,split", [(3, 1), (None, 2048)])
def test_three_batches_and_a_replay(spark, tmp_path, most, split):
    vs, store = vectors(), str(tmp_path)
    batches = [[i for i in vs if i % 4 == 3], [i for i in vs if i % 4 in (0, 1)], [i for i in vs if i % 4 == 2]]
    got, last = [], None
    for n, batch in enumerate(batches):
        df = frame(spark, [(i, vs[i]) for i in batch])
        last = [tuple(r) for r in V.insert_and_get(df, n, store, most=most, split_rows=split, slots=4).collect()]
        got += last
    assert sorted(got) == brute(vs, batches, most)
    again = V.insert_and_get(frame(spark, [(i, vs[i]) for i in batches[2]]), 2, store, most=most, split_rows=split, slots=4)
    assert sorted(map(tuple, again.collect())) == sorted(last)
    assert spark.read.parquet(f"{store}/members").count() == len(vs)
    distinct = len({vs[i] for b in batches for i in b})
    assert spark.read.parquet(f"{store}/bands").select("r_id").distinct().count() == distinct


def test_check_asks_without_storing(spark, tmp_path):
    vs, store = vectors(), str(tmp_path)
    old, new = [i for i in vs if i < 70], [i for i in vs if i >= 70]
    assert {r["found"] for r in V.check(frame(spark, [(1, vs[1])]), store).collect()} == {False}
    V.insert_and_get(frame(spark, [(i, vs[i]) for i in old]), 0, store)
    files = spark.read.parquet(f"{store}/bands").count()
    got = {r["q"]: (r["best"], r["found"]) for r in V.check(frame(spark, [(i, vs[i]) for i in new]), store).collect()}
    for q in new:
        best = min((vs[q] ^ vs[i]).bit_count() for i in old)
        assert got[q] == ((best, True) if best <= 20 else (None, False))
    assert spark.read.parquet(f"{store}/bands").count() == files
    assert V.check(frame(spark, []), store).count() == 0


def test_many_copies_give_at_most_the_asked_rows(spark, tmp_path):
    rnd = random.Random(2)
    v = rnd.getrandbits(768)
    rows = [(i, v) for i in range(400)] + [(1000 + i, v ^ (1 << i)) for i in range(5)]
    got = V.insert_and_get(frame(spark, rows), 0, str(tmp_path), most=4)
    assert got.groupBy("q").count().agg(F.max("count")).first()[0] == 4
    found = sorted((r["id"], r["distance"]) for r in got.filter("q = 1004").collect())
    assert found == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(r["id"] for r in got.filter("q = 2").collect()) == [0, 1]
