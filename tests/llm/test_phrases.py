"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from dupstream.llm import phrases
from tests.llm.helpers import frame, lower, odd_rows


def brute(rows, support, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\n-\r]", lower(text)):
            w = [x.decode() for x in re.split(rb"[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, 5):
                f.update((lang, tuple(w[i:i + size])) for i in range(len(w) - size + 1))
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= support}
    out = {}
    for (lang, w), a in candidates.items():
        if any(o == lang and len(v) > len(w) and 100 * c >= 80 * a and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
               for (o, v), c in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts():
    rng = np.random.default_rng(6)
    stock = ["new york city", "New York", "in the middle of", "middle of", "as soon as possible", "a.b", "Été  à", "x\ty\vz w", "end"]
    rows = [(i, " ".join(rng.choice(stock, rng.integers(1, 12))) + rng.choice([".", "", "!\n", ", "]) + str(rng.choice(stock)))
            for i in range(150)]
    return rows + odd_rows() + [(900 + i, "same words here") for i in range(40)] + [(None, "in the middle of"), (None, None)]


@pytest.mark.parametrize("support,shards,top", [(8, 4, 2000), (3, 10, 2000), (30, 10, 5)])
def test_phrases_as_plain_counting(spark, support, shards, top):
    docs = frame(spark, texts())
    want = brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()], support, top)
    assert want and got(phrases.collocations(docs, support=support, shards=shards, top=top)) == want


def test_long_texts_are_cut_between_words_without_loss(spark, monkeypatch):
    rows = [("one two three four five " * 60 + "q" * 300 + " one two. three", "en"), ("a b " * 200, None), ("", "en")]
    data = "".join(t for t, _ in rows).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t, _ in rows])])

    def all_runs(most):
        out = Counter()
        for first, words in phrases.word_runs(np.frombuffer(data, np.uint8), offsets, most=most):
            ids = [words.vocabulary[int(i)].as_py() for i in words.ids]
            for n in range(1, 5):
                out.update((first + int(words.text[a]), tuple(ids[a:a + n])) for a in words.runs(n).tolist())
        return out
    whole = all_runs(1 << 20)
    assert sum(whole.values()) > 1000
    for most in (10, 64, 333):
        assert all_runs(most) == whole


def test_phrases_of_an_empty_table_and_of_words_alone(spark):
    assert got(phrases.collocations(frame(spark, []))) == []
    assert got(phrases.collocations(frame(spark, [(i, "one. two, three") for i in range(50)]))) == []


def test_bit_table_holds_every_hash(spark):
    values = np.random.default_rng(5).integers(-2**63, 2**63, 5000)
    table = phrases.bit_table(spark.createDataFrame([(int(v),) for v in values], "h long"))
    assert table.held(values.view(np.uint64)).all()
    other = np.random.default_rng(6).integers(-2**63, 2**63, 5000).view(np.uint64)
    assert table.held(other).mean() < 0.1


def test_a_crowded_bit_table_changes_no_result(spark, monkeypatch):
    docs = frame(spark, texts())
    want = got(phrases.collocations(docs, support=8, shards=4))
    monkeypatch.setattr(phrases, "LEAST_BITS", 3)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "CHUNK_BITS", 3)
    monkeypatch.setattr(phrases, "HELD", 20)
    monkeypatch.setattr(phrases, "BLOCK", 200)
    assert got(phrases.collocations(docs, support=8, shards=4)) == want
