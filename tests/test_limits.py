"""Miss limiter windows and block list parsing (AGG8, SRC5, SET1)."""

from dupstream.operators import limits as LM


def test_miss_window_edges(spark):
    # user 1: 11 misses within 179 s -> the 11th is blocked (> 10)
    # user 2: 10 misses, then the 11th exactly 180 s after the first -> blocked (window includes 180 s)
    # user 3: 11th at 181 s -> the first has expired, 10 remain -> allowed
    rows = [(1, t) for t in range(0, 11 * 16, 16)]
    rows += [(2, t) for t in range(0, 180, 18)] + [(2, 180)]
    rows += [(3, t) for t in range(0, 180, 18)] + [(3, 181)]
    df = spark.createDataFrame(rows, "userid bigint, ts bigint")
    out = {(r["userid"], r["ts"]): (r["recent"], r["blocked"]) for r in LM.miss_counts(df).collect()}
    assert out[(1, 160)] == (11, True)
    assert out[(2, 180)] == (11, True)
    assert out[(3, 181)] == (10, False)


def test_miss_window_across_hour_slices(spark):
    # a burst straddling an hour boundary is counted across the two slices
    rows = [(7, 3600 - 100 + i * 10) for i in range(20)]
    df = spark.createDataFrame(rows, "userid bigint, ts bigint")
    out = {r["ts"]: r["recent"] for r in LM.miss_counts(df).collect()}
    assert out[3600 + 90] == 19   # 3510..3690 inclusive
    assert max(out.values()) == 19


def test_blocklist_lines(spark):
    add = spark.createDataFrame([(" 12 ",), ("x",), ("",), ("12",), ("+5",), ("-3",), ("7",),
                                 ("99999999999999999999",)], "line string")
    remove = spark.createDataFrame([("7",), ("junk",)], "line string")
    empty = spark.createDataFrame([], "userid bigint")
    got = sorted(r["userid"] for r in LM.update_blocklist(empty, add, remove).collect())
    assert got == [-3, 5, 12]


def test_read_id_lines(spark, tmp_path):
    p = tmp_path / "blocked.txt"
    p.write_text(" 12 \nx\n\n12\n")
    got = [r["userid"] for r in LM.parse_id_lines(LM.read_id_lines(spark, str(p))).distinct().collect()]
    assert got == [12]


def test_id_lines_lose_all_white_space(spark):
    from dupstream.operators.limits import parse_id_lines
    lines = spark.createDataFrame([("\t12",), (" 13\u3000",), ("\xa014\r",), ("x15",), (None,)], "line string")
    assert sorted(r.userid for r in parse_id_lines(lines).collect()) == [12, 13, 14]


def test_posts_json_reads_twice(spark, tmp_path):
    from dupstream.sources.envelope import read_posts_json
    (tmp_path / "posts.json").write_text('{"id": "a"}\nnot json\n')
    first = read_posts_json(spark, str(tmp_path))
    again = read_posts_json(spark, str(tmp_path))
    assert first.columns == again.columns
    assert sorted(str(r.id) for r in again.collect()) == ["None", "a"]
