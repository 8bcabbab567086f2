"""SimHash fingerprints and their groups."""

import random

import numpy as np
import pytest
import xxhash

from dupstream.llm import simhash
from dupstream.llm.common import table
from dupstream.llm.queries import REGISTRY
from tests.conftest import SF0001
from tests.llm.helpers import frame, lower, odd_rows, words


def brute_print(text):
    w = words(lower(text).decode())
    runs = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Component of every (id, fingerprint) by comparing all pairs."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d, f"{f:016x}", least[find(f)]) for d, f in prints)


def got(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_every_syndrome_has_its_error_pattern():
    remainder, pattern = simhash._golay()
    assert len(set(pattern.tolist())) == 2048
    messages = np.arange(4096)
    codewords = messages << 11 | remainder
    assert min(int(c).bit_count() for c in codewords[1:]) == 7
    rng = np.random.default_rng(1)
    for _ in range(3):
        noise = np.bitwise_xor.reduce(1 << rng.permuted(np.tile(np.arange(23), (4096, 1)), axis=1)[:, :3], axis=1)
        assert (simhash.codeword_index(codewords ^ noise) == messages).all()


def test_near_words_share_a_codeword_index():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 23, 2000)
    row, index = simhash.codeword_indices(base, 23)
    assert set(np.bincount(row)) == {1, 6}
    held = [set(index[row == i].tolist()) for i in range(200)]
    for i in range(200):
        for a in range(23):
            near = np.array([base[i] ^ (1 << a) ^ (1 << b) for b in range(23)])
            r, x = simhash.codeword_indices(near, 23)
            assert all(held[i] & set(x[r == k].tolist()) for k in range(23))


def test_every_pair_within_two_bits_shares_a_key():
    rnd = random.Random(3)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        row, key = simhash.search_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_fingerprints_of_odd_and_long_texts(monkeypatch):
    texts = [t for _, t in odd_rows()] + ["A b\tC\n\x0bd", "Ää B"]
    want = [brute_print(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "word_blocks", lambda text, size=37, f=simhash.word_blocks: f(text, 37))
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("busy", [1, simhash.BUSY])
def test_groups_of_odd_rows_as_all_pairs(spark, busy):
    rows = odd_rows()
    rows += [(100 + i, rows[20][1] + f" tail{i}") for i in range(40)]
    want = brute_groups([(d, brute_print(t)) for d, t in rows])
    assert got(simhash.simhash_groups(frame(spark, rows + [(None, "gone"), (None, None)]), busy=busy)) == want


@pytest.mark.parametrize("busy", [3, 1000])
def test_links_of_crowded_fingerprints_as_all_pairs(spark, busy):
    """A ball of near fingerprints around one word, chains, and far ones."""
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base} | {base ^ (1 << i) for i in range(0, 64, 2)} | {base ^ (3 << i) for i in range(0, 60, 3)}
    at = rnd.getrandbits(64)
    for i in range(40):
        fps.add(at)
        at ^= 3 << rnd.randrange(63)
    fps |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {r.node: r.component for r in simhash.components(simhash.links(df, busy)).collect()}
    mine, want = {}, {}
    for f, s in zip(fps, signed):
        mine.setdefault(labels.get(s, s), set()).add(f)
    for f, _, c in brute_groups([(f, f) for f in fps]):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert got(simhash.simhash_groups(frame(spark, []))) == []


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, brute_print(r.text)) for r in table(spark, SF0001, "documents").collect()]
    assert got(REGISTRY["op13_simhash"](spark, SF0001)) == brute_groups(rows)
