"""Token ids and counts against the libraries."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from dupstream.llm import common, pieces, token_counts
from tests.llm.helpers import frame, odd_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = odd_rows() + [(None, "no id"), (70, "  two  spaces \n\nand\r\nlines\t"), (71, "<0x0A> a_b x².y _{z} '"), (72, "it's we'll 'S 12 3")]


def test_ids_and_decoded_text_as_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_decode(frame(spark, ROWS), PIECES).collect()
    want = sorted((str(d), lib.encode(t or "", add_bos=True, add_eos=True)) for d, t in ROWS)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((d, lib.decode(i)) for d, i in want)


def test_a_worker_drops_the_caches_of_the_operator_it_left(monkeypatch):
    monkeypatch.setattr(common, "_worker", {"at": None, "drops": []})
    left = []
    common.enter("a")
    common.keep_until_left(left.append)
    monkeypatch.setitem(common._worker, "drops", [lambda: left.append("a")])
    common.enter("a")
    assert left == []
    assert list(common.tidy("b", lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3]
    assert left == ["a"] and common._worker == {"at": "b", "drops": []}


def test_the_agenda_alone_agrees_with_the_library():
    m = pieces.Model(PIECES)
    found = {w for _, t in ROWS if t and len(t) < 50_000 for w in m.split(t)}
    words = sorted(found)
    assert [m.agenda(w) for w in words] == m.by_library(words)


def test_a_full_cache_turns_over(spark):
    cache = common.WordCache(most=20, longest=8, blank=0)
    texts = [[f"w{i}" for i in range(k, k + 15)] + ["a-long-word"] for k in range(0, 100, 5)]
    got = [cache.totals([t], sum, lambda ws: [len(w) for w in ws])[0] for t in texts]
    assert got == [sum(map(len, t)) for t in texts]
    assert len(cache) + len(cache.older) < 60 and "a-long-word" not in cache


def test_counts_as_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(frame(spark, ROWS), BYTES).collect()
    want = sorted((str(d), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def test_empty_tables(spark):
    assert token_counts.token_counts(frame(spark, []), BYTES).collect() == []
    assert pieces.encode_decode(frame(spark, []), PIECES).collect() == []


def test_packed_ids_are_little_endian(spark):
    row = pieces.encode_decode(frame(spark, [(1, "hello world")]), PIECES).first()
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert np.frombuffer(row.ids, "<u4").tolist() == lib.encode("hello world", add_bos=True, add_eos=True)


@pytest.mark.parametrize("text", ["", "a", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "x\x85y\x1cz", "͸  "])
def test_special_strings_and_rare_characters(text):
    s = token_counts.Splitter(BYTES)
    found, special = s.split(text)
    assert special + sum(s.lengths(found)) == len(s.tokenizer.encode(text, add_special_tokens=False).ids)
