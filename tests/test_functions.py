"""Golden vectors of the scalar functions (FN1-FN19)."""

from pyspark.sql import functions as F

from dupstream.functions import bits as B
from dupstream.functions import text as X

MIN = -(2 ** 63)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit64(x):
    return F.lit(x).cast("bigint")


def test_hamming(spark):
    assert one(spark, B.hamming(lit64(5), lit64(3))) == 2
    assert one(spark, B.hamming(lit64(-1), lit64(0))) == 64
    assert one(spark, B.hamming(lit64(MIN), lit64(0))) == 1
    assert one(spark, B.hamming(F.lit(None).cast("bigint"), lit64(7))) == 3


def test_popcount32(spark):
    assert one(spark, B.popcount32(lit64(2 ** 32))) == 0
    assert one(spark, B.popcount32(lit64(2 ** 31))) == 33
    assert one(spark, B.popcount32(lit64(-1))) == 64


def test_popcount_sign_magnitude(spark):
    assert one(spark, B.popcount_sm(lit64(1))) == 1
    assert one(spark, B.popcount_sm(lit64(MIN + 1))) == 63
    assert one(spark, B.popcount_sm(lit64(MIN))) == 1
    assert one(spark, B.popcount_sm(lit64(-1))) == 1
    assert one(spark, B.popcount_sm(lit64(-5))) == 2


def test_signed_words(spark):
    assert one(spark, B.signed_word(F.lit("1" * 64), 0)) == -1
    assert one(spark, B.signed_word(F.lit("1" + "0" * 63), 0)) == MIN
    assert one(spark, B.signed_word(F.lit("10" * 32), 0)) == -6148914691236517206


def test_md5(spark):
    assert one(spark, F.md5(F.lit("abc"))) == "900150983cd24fb0d6963f7d28e17f72"
    assert one(spark, F.md5(F.lit(""))) == "d41d8cd98f00b204e9800998ecf8427e"


def test_positional_mismatch(spark):
    assert one(spark, X.positional_mismatch(F.lit("abc"), F.lit("abd"))) == 1
    assert one(spark, X.positional_mismatch(F.lit("abc"), F.lit("ab"))) == 0
    assert one(spark, X.positional_mismatch(F.lit(""), F.lit("abc"))) == 0
    assert one(spark, X.python_bin(lit64(-5))) == "-0b101"
    assert one(spark, X.python_bin(lit64(MIN))) == "-0b1" + "0" * 63


def test_levenshtein(spark):
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, F.levenshtein(F.lit("flaw"), F.lit("lawn"))) == 2
    assert one(spark, F.levenshtein(F.lit("cat"), F.lit(""))) == 3
    assert one(spark, F.levenshtein(F.lit("héllo"), F.lit("hello"))) == 1
    assert one(spark, X.levenshtein_n(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, X.levenshtein_n(F.lit(""), F.lit("abc"))) == 1.0
    assert one(spark, X.levenshtein_n(F.lit("kitten"), F.lit("sitting"))) == 0.42857142857142855


def test_duration_text(spark):
    cases = {-5: "-5.0 seconds", 59: "59.0 seconds", 60: "1.0 minutes", 69: "1.1 minutes",
             75: "1.2 minutes", 87: "1.4 minutes", 3599: "60.0 minutes", 86399: "24.0 hours",
             604800: "1.0 weeks", 3024000: "5.0 weeks", 30758400: "1.0 years"}
    df = spark.createDataFrame([(k,) for k in cases], "v bigint")
    got = {r["v"]: r["t"] for r in df.select("v", X.duration_text(F.col("v")).alias("t")).collect()}
    assert got == cases


def test_star_bar(spark):
    cases = {0.0: "★★★★★", 0.1: "★★★★★", 3 / 7: "★★★☆☆", 0.5: "★★★☆☆", 0.7: "★★☆☆☆",
             0.9: "☆☆☆☆☆", 1.0: "☆☆☆☆☆"}
    for dist, bar in cases.items():
        assert one(spark, X.star_bar(F.lit(1.0) - F.lit(dist))) == bar, dist


def test_summon_id(spark):
    assert one(spark, X.summon_id(F.lit("glory at http://imgur.com/gallery/AbC1/comment/99/"))) == "AbC1"
    assert one(spark, X.summon_id(F.lit("other text"))) == ""


def test_title_rules(spark):
    assert one(spark, X.title_tokens_hit(F.lit("MRW x")))
    assert not one(spark, X.title_tokens_hit(F.lit("mrw,x")))
    assert not one(spark, X.title_starts_with(F.lit(" when x")))
    assert one(spark, X.title_starts_with(F.lit("When x")))
    assert one(spark, X.normalize_title(F.lit("  Ab C\t\n"))) == "ab c"


def test_cap_text(spark):
    assert one(spark, F.length(X.cap_text(F.lit("x" * 300)))) == 140


def test_sql_registration(spark):
    from dupstream.functions.sql import register_sql
    register_sql(spark)
    r = spark.sql("SELECT hamming3(5, 3) AS h, hamming1(NULL, 7) AS n, popcount(4294967296) AS p, "
                  "xor(6, 3) AS x").first()
    assert (r["h"], r["n"], r["p"], r["x"]) == (2, 3, 0, 5)


def test_bit_parallel_edit_distance(spark):
    rows = [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("cat", "", 3), ("héllo", "hello", 1),
            ("", "", 0), (None, "x", None), ("a" * 70 + "b", "a" * 71, 1), ("x" * 200, "y" * 130, 200)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    got = df.select("want", X.edit_distance("a", "b").alias("got"), F.levenshtein("a", "b").alias("jvm")).collect()
    assert all(r["got"] == r["want"] == r["jvm"] for r in got)


def test_distance_below_takes_a_known_distance(spark):
    rows = [("kitten", "sitting"), ("flaw", "lawn"), ("", ""), ("abc", "abd"), (None, "x"), ("x", None), ("", "ab")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", X.edit_distance("a", "b"))
    for share in (0.3, 0.4, 1.0):
        got = df.select(X.distance_below("a", "b", share).alias("x"), X.distance_below("a", "b", share, known="d").alias("y"))
        assert all(r["x"] == r["y"] for r in got.collect())


def test_text_distance_measures_each_pair_once(spark):
    """Whole texts meet in one bit-parallel distance, not in the built-in's cells."""
    from dupstream.plans.queries import REGISTRY
    from tests.conftest import SF0001
    plan = REGISTRY["text_distance"](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edit_distance(") == 1 and "levenshtein" not in plan


def test_bit_parallel_matches_dynamic_programming():
    import random
    from dupstream.functions.text import _myers

    def dp(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]
    rnd = random.Random(7)
    for _ in range(500):
        a = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 90)))
        b = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 90)))
        assert _myers(a, b) == dp(a, b)


def test_positional_mismatch_of_odd_and_long_texts(spark):
    rows = [("", "", 0), ("héllo", "hello", 1), ("a😀c", "a😀d", 1), ("ab", None, None), ("x" * 60_000, "x" * 59_999 + "yz", 1)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    for r in df.select("want", X.positional_mismatch("a", "b").alias("got")).collect():
        assert r["got"] == r["want"]


def test_bounded_distance_loses_nothing(spark):
    import random
    rnd = random.Random(3)
    rows = [("", ""), ("", "abc"), ("abc", None), ("ünï", "uni"), ("e" * 40, "a" * 40), (" 1x", "x1 ")]
    for _ in range(300):
        a = "".join(rnd.choice("ae t1é") for _ in range(rnd.randint(0, 30)))
        b = "".join(rnd.choice([c, c, c, "", "a", "zz"]) for c in a) if rnd.random() < 0.7 else a[::-1]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").select(
        F.levenshtein("a", "b").alias("d"), X.levenshtein_n("a", "b", bit_parallel=False).alias("n"),
        X.distance_bound("a", "b").alias("least"), *[X.bounded_distance("a", "b", k).alias(f"upto{k}") for k in (0, 3, 12)],
        *[X.distance_below("a", "b", s).alias(f"below{i}") for i, s in enumerate((0.1, 0.4, 1.0))])
    for r in df.collect():
        if r["d"] is None:
            assert r["below1"] is None and r["upto3"] is None
            continue
        assert r["least"] <= r["d"]
        for k in (0, 3, 12):
            assert r[f"upto{k}"] == (r["d"] if r["d"] <= k else None)
        for i, s in enumerate((0.1, 0.4, 1.0)):
            assert r[f"below{i}"] == (r["n"] < s)


def _edited(rnd, text: bytes, every: int) -> bytes:
    out = bytearray()
    for ch in text:
        kind = rnd.randrange(3 * every)
        out += b"" if kind == 0 else bytes([rnd.randrange(256)]) if kind == 1 else bytes([ch, 46]) if kind == 2 else bytes([ch])
    return bytes(out)


def test_byte_distance_matches_the_long_integers(spark):
    """Lengths around the words, passes and parts it works in; copies, edits, shifts and strangers."""
    import random
    from dupstream.functions import whole_text as WT
    from dupstream.functions.text import _myers
    rnd = random.Random(11)
    some = lambda n, k: bytes(rnd.randrange(k) * 9 % 256 for _ in range(n))
    pairs = [(b"", b""), (b"", b"ab"), (b"ab", b""), (b"kitten", b"sitting"), ("héllo".encode(), b"hello"), (b"x" * 3000, b"x" * 2000)]
    for n in (1, 63, 64, 65, 127, 128, 129, 255, 512, 513, 700, 1500, 4000):
        a = some(n, rnd.choice((2, 5, 30, 256)))
        pairs += [(a, a), (a, _edited(rnd, a, 5)), (_edited(rnd, a, 60), a), (a, some(200, 30) + a), (a[n // 3:], a[:n // 2]),
                  (a, some(n, 30)), (a, some(3 * n, 5)), (some(n // 9, 2), a), (some(9, 30) + a[9:-9] + some(9, 30), a)]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    got = {r["i"]: (r["d"], r["m"]) for r in df.select(
        "i", WT.byte_distance("a", "b").alias("d"), WT.byte_mismatch("a", "b").alias("m")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (_myers(a.decode("latin-1"), b.decode("latin-1")), sum(x != y for x, y in zip(a, b))), (i, len(a), len(b))


def test_byte_functions_of_null(spark):
    from dupstream.functions import whole_text as WT
    df = spark.createDataFrame([(None, bytearray(b"x")), (bytearray(b"x"), None), (None, None)], "a binary, b binary")
    assert all(r["d"] is None and r["m"] is None for r in df.select(
        WT.byte_distance("a", "b").alias("d"), WT.byte_mismatch("a", "b").alias("m")).collect())


def test_text_distance_leaves_no_text_to_python(spark):
    """The distances run in the JVM, and texts cross the shuffle of their own join and one more."""
    from dupstream.plans.queries import REGISTRY
    from tests.conftest import SF0001
    plan = REGISTRY["text_distance"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "edit_distance(" in plan
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") <= 5
