"""Every stage of the pipeline against a plain version on that stage's own input."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as CP
from dupstream.llm import mixing, quality
from dupstream.llm.common import stored, string_buffers, table
from tests.conftest import SF0001
from tests.llm.helpers import exact, frame, lower, near_components, odd_rows


@pytest.fixture(scope="module", params=["documents", "odd"])
def inputs(spark, request):
    """The input of every stage, stored, by stage name; the odd rows come with columns
    whose names the operators use inside."""
    docs = table(spark, SF0001, "documents")
    if request.param == "odd":
        docs = frame(spark, odd_rows() + [(None, "no id here"), (None, None)])
    out = {}
    for name, stage in CP.STAGES:
        out[name] = docs = stored(spark, docs, "in")
        docs = stage(spark, docs, SF0001)
        out["after_" + name] = docs = stored(spark, docs, "out")
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay_until_the_last_stage(inputs):
    for name, _ in CP.STAGES[:-1]:
        assert inputs["after_" + name].schema == inputs[name].schema


def test_quality_keeps_what_the_fitted_scores_keep(spark, inputs):
    ratings = quality.graded_labels(table(spark, SF0001, "labels"))
    docs = inputs["quality"]
    model = quality.fit_sample(quality.rated_sample(docs, ratings))
    want = []
    import pyarrow as pa
    for d, t in pairs(docs):                                  # one document at a time, by the model's definition
        if model is not None:
            data, offsets = string_buffers(pa.array([t], pa.string()))
            score = model.scores(data, offsets)[0]
            if 1 / (1 + np.exp(-(score - model.thresholds[-1]))) < quality.KEEP_TAIL:
                continue
        want.append((d, t))
    assert Counter(pairs(inputs["after_quality"])) == Counter(want) and want


def test_exact_dedup_keeps_the_largest_id_of_equal_texts(inputs):
    rows = pairs(inputs["exact_dedup"])
    largest = {}
    for d, t in rows:
        if d is not None:
            largest[lower(t)] = max(d, largest.get(lower(t), d))
    got = pairs(inputs["after_exact_dedup"])
    assert Counter((d, lower(t)) for d, t in got if d is not None) == Counter((d, t) for t, d in largest.items())
    alone = {lower(t) for d, t in rows if d is None} - set(largest)
    assert sorted(lower(t) for d, t in got if d is None) == sorted(alone)
    assert len(got) == len({row[4] for row in exact(rows, max)})


def test_near_dedup_keeps_the_smallest_id_of_a_component(inputs):
    rows = pairs(inputs["near_dedup"])
    keep = {d for d, _, c in near_components([r for r in rows if r[0] is not None]) if d == c}
    got = pairs(inputs["after_near_dedup"])
    assert Counter(got) == Counter((d, t) for d, t in rows if d is None or d in keep)
    assert len(got) < len(rows)


def test_mixing_draws_by_its_probabilities(inputs):
    docs = inputs["mixing"]
    chance = {}
    for r in mixing.mix(docs).collect():
        chance.setdefault(r.doc_id, set()).add(r.probability)
    drawn = Counter(d for d, _ in pairs(inputs["after_mixing"]))
    for d, n in Counter(d for d, _ in pairs(docs)).items():
        place = int(hashlib.sha256(f"{'null' if d is None else d}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / (1 << 52)
        if len(chance[d]) == 1:
            assert drawn[d] == (n if place < next(iter(chance[d])) else 0)


def test_tokens_are_those_of_the_library(inputs):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for d, t in pairs(inputs["tokens"]):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[d, np.asarray(ids, "<u4").tobytes(), len(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in inputs["after_tokens"].collect()) == want


def test_empty_tables_pass_every_stage(spark):
    docs = frame(spark, [])
    for name, stage in CP.STAGES:
        docs = stored(spark, stage(spark, docs, SF0001), name)
        assert docs.count() == 0
