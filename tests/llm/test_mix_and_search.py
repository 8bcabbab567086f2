"""Raking, nearest neighbours and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from dupstream.llm import mixing, nearest, quality
from dupstream.llm.common import stored, table
from tests.conftest import SF0001
from tests.llm.helpers import frame, odd_rows

ROWS = [(i, "word " * (1 + i % 7)) for i in range(600)]


def test_sampled_shares_meet_the_targets(spark):
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.2, "de": 0.3, "": 0.5}}
    rows = mixing.mix(frame(spark, ROWS), targets, rounds=8).collect()
    assert len(rows) == len(ROWS)
    mass = sum(r.n_tokens * r.probability for r in rows)
    for m, shares in targets.items():
        for value, share in shares.items():
            got = sum(r.n_tokens * r.probability for r in rows if r[m] == value) / mass
            assert got == pytest.approx(share, abs=1e-4)
    assert max(r.probability for r in rows) == 1.0
    kept = [r for r in rows if r.kept]
    assert len(kept) == pytest.approx(sum(r.probability for r in rows), abs=60)


def test_draws_are_repeatable_and_follow_the_seed(spark):
    docs = frame(spark, ROWS)
    a, b, c = ([r.doc_id for r in mixing.sampled(docs, rounds=1, seed=s).orderBy("doc_id").collect()] for s in (1, 1, 2))
    assert a == b != c
    assert mixing.sampled(docs, rounds=1).columns == docs.columns


def test_mixing_takes_odd_rows_values_without_target_and_empty_tables(spark):
    rows = odd_rows() + [(None, "x y"), (None, None)]
    assert len(mixing.mix(frame(spark, rows), rounds=2).collect()) == len(rows)
    only = mixing.mix(frame(spark, ROWS), {"source": {"a": 1.0, "not there": 5.0}}, rounds=2).collect()
    assert {r.probability for r in only if r.source == "b"} == {0.0}
    assert mixing.mix(frame(spark, []), rounds=2).collect() == []
    blank = mixing.mix(frame(spark, [(1, None), (2, "")]), rounds=2).collect()
    assert {r.n_tokens for r in blank} == {0}


def test_sampled_shares_meet_the_targets_closely_after_thirty_rounds(spark):
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.2, "de": 0.3, "": 0.5}}
    rows = mixing.mix(frame(spark, ROWS), targets, rounds=30).collect()
    mass = sum(r.n_tokens * r.probability for r in rows)
    for m, shares in targets.items():
        for value, share in shares.items():
            got = sum(r.n_tokens * r.probability for r in rows if r[m] == value) / mass
            assert got == pytest.approx(share, abs=1e-6)


BOUND = [("web", "en", 9_000_000), ("web", "de", 1_000), ("news", "de", 1_000_000), ("news", "en", 1_000),
         ("code", "en", 500_000), ("code", "fr", 2_000)]


def raked_shares(spark, cells, targets):
    """Raked shares of the margins' values at production defaults, and the residual."""
    df = spark.createDataFrame([(s, g, "plain", n) for s, g, n in cells], "source string, lang string, topic string, mass long")
    aims = {m: spark.createDataFrame(list(v.items()), "value string, share double") for m, v in targets.items()}
    raked, left = mixing.rake(df, aims)
    rows = raked.collect()
    whole = sum(r.raked for r in rows)
    return {m: {v: sum(r.raked for r in rows if r[m] == v) / whole for v in targets[m]} for m in targets}, left


@pytest.mark.parametrize("source,lang", [((0.4, 0.4, 0.2), (0.5, 0.4, 0.1)), ((0.4, 0.3, 0.3), (0.5, 0.45, 0.05))])
def test_targets_are_met_where_sources_and_languages_are_nearly_bound(spark, source, lang):
    targets = {"source": dict(zip(("web", "news", "code"), source)), "lang": dict(zip(("en", "de", "fr"), lang)),
               "topic": {"plain": 1.0}}
    got, left = raked_shares(spark, BOUND, targets)
    assert left <= mixing.TOLERANCE
    for m in targets:
        assert got[m] == pytest.approx(targets[m], abs=1.01 * mixing.TOLERANCE)


def test_large_cell_tables_are_raked_as_far(spark, monkeypatch):
    cells = [("web", "en", 9_000), ("web", "de", 900), ("news", "de", 4_000), ("news", "en", 300)]
    targets = {"source": {"web": 0.3, "news": 0.7}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"plain": 1.0}}
    here, _ = raked_shares(spark, cells, targets)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    got, left = raked_shares(spark, cells, targets)
    assert left <= mixing.TOLERANCE
    for m in targets:
        assert got[m] == pytest.approx(targets[m], abs=1.01 * mixing.TOLERANCE)
        assert got[m] == pytest.approx(here[m], abs=1e-9)


def test_targets_that_cannot_be_met_are_told(spark):
    docs = frame(spark, ROWS).filter("(source = 'a') = (lang = 'en')")      # each language has one source
    with pytest.warns(RuntimeWarning, match="from its target"):
        mixing.chances(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}})


def test_mixing_at_production_rounds_takes_odd_rows_and_follows_the_seed(spark):
    docs = frame(spark, ROWS)
    a, b, c = ([r.doc_id for r in mixing.sampled(docs, seed=s).orderBy("doc_id").collect()] for s in (1, 1, 2))
    assert a == b != c
    rows = odd_rows() + [(None, "x y"), (None, None)]
    assert len(mixing.mix(frame(spark, rows)).collect()) == len(rows)
    only = mixing.mix(frame(spark, ROWS), {"source": {"a": 1.0, "not there": 5.0}}).collect()
    assert {r.probability for r in only if r.source == "b"} == {0.0}
    assert mixing.mix(frame(spark, [])).collect() == []


def brute_nearest(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for i in good:
        if i % every == 0:
            s = sorted(((-float((good[j] * good[i]).sum()), j) for j in good if j != i))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def vectors(n=900, d=16):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(d) * rng.uniform(0.5, 2)).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(60)]                      # one vector many times
    rows += [(5000, None), (None, rows[0][1]), (5020, [0.0] * d), (5040, [float("nan")] * d), (5060, [None] * d),
             (5080, [float("inf")] + [1.0] * (d - 1)), (5100, [1.0])]
    return rows


def test_nearest_recall_scores_and_order(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cell string, rank int")
    got = {}
    for r in nearest.nearest(df, k=10, cell_points=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest([r for r in rows if r[0] != 5100], 10, 20)
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    truth = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 5000}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and q not in [j for _, j, _ in found]
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        for _, j, s in found:
            assert s == pytest.approx(float((truth[j] * truth[q]).sum()), rel=1e-12)


def test_recall_on_clustered_vectors_at_production_parameters(spark):
    assert nearest.CONFIDENCE == 0.99
    rng = np.random.default_rng(3)
    centres, basis = 2 * rng.standard_normal((50, 4)), rng.standard_normal((4, 16))
    v = (centres[rng.integers(0, 50, 9000)] + 0.3 * rng.standard_normal((9000, 4))) @ basis
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in nearest.nearest(df).collect()}
    queries = np.arange(0, 9000, nearest.QUERY_EVERY)
    scores = v[queries] @ v.T
    scores[np.arange(len(queries)), queries] = -9
    want = {(int(q), int(j)) for q, row in zip(queries, np.argsort(-scores, axis=1)[:, :nearest.K]) for j in row}
    assert len(got & want) / len(want) >= 0.99


def test_nearest_with_few_or_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, -1.0])], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert nearest.nearest(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    assert nearest.nearest(spark.createDataFrame([], schema)).collect() == []


def test_the_chi_square_point():
    assert nearest.chi_square_point(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert nearest.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-2)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF0001, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(spark, stage(spark, docs, SF0001), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5] > 0


def test_pipeline_stages_take_odd_rows(spark):
    docs = frame(spark, odd_rows() + [(None, "no id"), (None, None)], clash=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(spark, stage(spark, docs, SF0001), name)
    assert docs.count() > 0


def test_clean_rated_documents_pass_the_quality_stage(spark):
    docs = table(spark, SF0001, "documents")
    labels = table(spark, SF0001, "labels")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF0001).select("doc_id").collect()}
    clean = {r.doc_id for r in quality.graded_labels(labels).filter("grade = 2").collect()}
    assert len(clean & kept) / len(clean) > 0.95
