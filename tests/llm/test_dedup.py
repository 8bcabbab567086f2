"""Substring, exact and near deduplication against brute force."""

import pytest

from dupstream.llm import components, exact, jaccard, substring
from tests.llm.helpers import exact as brute_exact
from tests.llm.helpers import frame, near_components, odd_rows, repeats

ROWS = odd_rows()


@pytest.mark.parametrize("group_bytes", [2_000, 1 << 30])
def test_repeated_words_as_brute_force(spark, group_bytes):
    got = substring.remove_repeats(frame(spark, ROWS), group_bytes=group_bytes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == repeats(ROWS)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeats_leave_out_null_ids_and_take_empty_tables(spark):
    assert substring.remove_repeats(frame(spark, [])).collect() == []
    got = substring.remove_repeats(frame(spark, [(None, "a b c"), (3, "a b c")])).collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(3, 3, 0)]


def test_short_windows_and_overlapping_passages(spark):
    rows = [(9, "a b c d e f"), (4, "x a b c y"), (7, "c d e a b c d e"), (2, "b c d")]
    got = substring.remove_repeats(frame(spark, rows), width=3, anchor=2, group_bytes=8).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == repeats(rows, 3)


def test_near_components_as_brute_force(spark):
    got = jaccard.near_duplicates(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(ROWS)


def test_near_components_without_broadcast_or_frequent_list(spark):
    got = jaccard.near_duplicates(frame(spark, ROWS), small_ids=0, heavy=1, partners=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(ROWS)


def test_boilerplate_that_all_documents_share_links_nothing(spark):
    line = "this work may be copied by everyone under the terms given in the notice of the owner"
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(30)) + " " + line) for i in range(60)]
    rows += [(100 + i, line) for i in range(3)]
    got = jaccard.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(rows)


def test_near_duplicates_take_empty_tables_and_null_ids(spark):
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []
    got = jaccard.near_duplicates(frame(spark, [(None, "a b"), (5, "a b"), (6, "a B")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (6, 5)]


def test_rows_without_near_copies_keep_their_columns(spark):
    docs = frame(spark, ROWS + [(None, "x")])
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns
    stay = {d for d, _, c in near_components(ROWS) if d == c}
    assert {r.doc_id for r in kept.collect()} == stay | {None}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 700), (700, 600)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 500, 700: 500}


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_groups_as_brute_force(spark, keep, best):
    rows = ROWS + [(None, "one"), (None, None), (None, "only here")]
    got = [tuple(r) for r in exact.exact_groups(frame(spark, rows), keep=keep).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    def order(r): return tuple(str(x) for x in r)
    want = brute_exact(rows, best)
    # of several null ids one is kept where no other id is there
    got_known = sorted((r for r in got if r[0] is not None), key=order)
    assert got_known == sorted((r for r in want if r[0] is not None), key=order)
    assert sorted((r[2], r[4]) for r in got if r[0] is None) == sorted((r[2], r[4]) for r in want if r[0] is None)


def test_exact_groups_over_many_ranges(spark):
    rows = [(i, "hot text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact.exact_groups(frame(spark, rows, clash=False).repartition(7), keep="largest").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(brute_exact(rows, max))


def test_distinct_rows_keep_one_row_with_all_columns(spark):
    docs = frame(spark, ROWS)
    kept = exact.distinct_rows(docs, keep="largest")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute_exact(ROWS, max) if r[3])
    assert exact.distinct_rows(frame(spark, []), keep="largest").collect() == []
