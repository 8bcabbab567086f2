"""Substring deduplication with repeated-phrase automata.

A window is ``width`` consecutive words of one document.  A word goes when some
window covering it also occurs in a document with a smaller id.

1. *Confirm.*  Documents are dealt by id hash into groups of bounded text size.
   Every window has one anchor: the smallest hash among its ``anchor``-word
   runs.  Equal windows have equal anchors, so a window can only recur in
   another group if its anchor does; groups exchange their distinct anchors,
   then the hashes of windows on recurring anchors with the group's smallest
   document id.  Each group learns which of its windows some other group holds
   under a smaller id.  What travels is one entry per group and distinct
   window, however many copies a group holds.
2. *Compile.*  Runs of confirmed windows are the recurring passages.  Each group
   compiles one Aho-Corasick automaton (``pyahocorasick``, keys are sequences of
   word numbers) over the passages its documents contain.
3. *Stream.*  Every document with a passage is streamed through the automaton
   of its group; every occurrence of a passage whose windows all belong to a
   smaller id is marked.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows with a null id are left out; rows that repeat an id are
judged one by one against smaller ids only; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C

WIDTH = 13
ANCHOR = 5
GROUP_BYTES = 8 << 20          # text bytes a document group holds on average
SHARD_BYTES = 256 << 20        # text bytes whose hashes one exchange shard holds
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


class _Group:
    """Hash view of one document group, rows ordered by (id, text)."""

    def __init__(self, table):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.texts = table.column("text")
        self.ids = table.column("doc_id").to_numpy()
        data, offsets = C.string_buffers(self.texts)
        self.words, self.first = C.word_hashes(data, offsets)

    def windows(self, width: int):
        """(start word, row) of every window."""
        counts = np.diff(self.first)
        row_of_word = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(max(0, len(self.words) - width + 1))
        ok = row_of_word[starts] == row_of_word[starts + width - 1] if len(starts) else np.zeros(0, bool)
        starts = starts[ok]
        return starts, row_of_word[starts] if len(starts) else starts

    def anchors(self, starts, width: int, anchor: int):
        """Anchor hash of the windows at ``starts``."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        run = C.grams(self.words, anchor)
        m = len(self.words) - width + 1
        low = run[:m].copy()
        for j in range(1, width - anchor + 1):
            np.minimum(low, run[j:j + m], out=low)
        return C.mix(low[starts])          # minima are small numbers: spread them again


def _by_shard(keys: np.ndarray, shards: int):
    """Order of ``keys`` by shard and the slice of each shard that has any."""
    shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return order, [(s, cut[s], cut[s + 1]) for s in range(shards) if cut[s] < cut[s + 1]]


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR,
                   group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, the removed ``spans``
    (word numbers, end exclusive) and ``kept_text`` (kept words joined by one
    space)."""
    size = C.text_bytes(docs)
    groups = max(1, -(-size // group_bytes))
    shards = max(16, -(-size // shard_bytes))
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
             .filter(F.col("doc_id").isNotNull())
             .withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")))

    def anchors_of(key, table):
        import pyarrow as pa
        group = _Group(table)
        starts, _ = group.windows(width)
        keys = np.unique(group.anchors(starts, width, anchor))
        order, parts = _by_shard(keys, shards)
        low = keys[order].astype(np.uint32)
        return pa.table({"shard": pa.array([s for s, _, _ in parts], pa.int32()),
                         "g": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "n": pa.array([b - a for _, a, b in parts], pa.int32()),
                         "keys": pa.array([low[a:b].tobytes() for _, a, b in parts], pa.binary())})

    def recurring_anchors(key, table):
        import pyarrow as pa
        parts = [np.unique(np.frombuffer(b, np.uint32)) for b in table.column("keys").to_pylist()]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        again = values[counts > 1]
        kept = [p[np.isin(p, again, assume_unique=True)] for p in parts]
        rows = [i for i, p in enumerate(kept) if len(p)]
        return pa.table({"g": table.column("g").take(pa.array(rows, pa.int64())),
                         "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         "keys": pa.array([kept[i].tobytes() for i in rows], pa.binary())})

    def windows_of(key, left, right):
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "g": pa.array([], pa.int32()),
                             "n": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()),
                             "owners": pa.array([], pa.binary())})
        again = np.sort(np.concatenate([
            np.frombuffer(b, np.uint32).astype(np.uint64) | (np.uint64(s) << np.uint64(32))
            for s, b in zip(right.column("shard").to_pylist(), right.column("keys").to_pylist())]))
        group = _Group(left)
        starts, rows = group.windows(width)
        a = group.anchors(starts, width, anchor)
        a = (a & np.uint64(0xFFFFFFFF)) | (((a >> np.uint64(40)) % np.uint64(shards)) << np.uint64(32))
        at = np.minimum(np.searchsorted(again, a), len(again) - 1)
        hit = again[at] == a
        keys, first = np.unique(C.grams(group.words, width)[starts[hit]], return_index=True)
        owners = group.ids[rows[hit][first]]         # rows are in id order: the first is the smallest
        order, parts = _by_shard(keys, shards)
        keys, owners = keys[order], owners[order]
        return pa.table({"shard": pa.array([s for s, _, _ in parts], pa.int32()),
                         "g": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "n": pa.array([y - x for _, x, y in parts], pa.int32()),
                         "keys": pa.array([keys[x:y].tobytes() for _, x, y in parts], pa.binary()),
                         "owners": pa.array([C.pack(owners[x:y]) for _, x, y in parts], pa.binary())})

    def smaller_owners(key, table):
        import pyarrow as pa
        ns = table.column("n").to_pylist()
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()])
        owners = np.concatenate([C.unpack(b, n, np.int64) for b, n in zip(table.column("owners").to_pylist(), ns)])
        part = np.repeat(np.arange(len(ns)), ns)
        order = np.lexsort((owners, keys))
        sk, so = keys[order], owners[order]
        head = np.flatnonzero(np.concatenate([[True], sk[1:] != sk[:-1]]))
        best = np.repeat(so[head], np.diff(np.append(head, len(sk))))
        told = best < so
        sk, best, to = sk[told], best[told], part[order][told]
        back = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[back], np.arange(len(ns) + 1))
        rows = [i for i in range(len(ns)) if cut[i] < cut[i + 1]]
        pick = [back[cut[i]:cut[i + 1]] for i in rows]
        return pa.table({"g": table.column("g").take(pa.array(rows, pa.int64())),
                         "n": pa.array([len(p) for p in pick], pa.int32()),
                         "keys": pa.array([sk[p].tobytes() for p in pick], pa.binary()),
                         "owners": pa.array([C.pack(best[p]) for p in pick], pa.binary())})

    def locate(key, left, right):
        return _stream(_Group(left), right, width)

    grouped = dealt.groupBy("g")
    sent = grouped.applyInArrow(anchors_of, "shard int, g int, n int, keys binary")
    again = sent.groupBy("shard").applyInArrow(recurring_anchors, "g int, shard int, keys binary")
    held = grouped.cogroup(again.groupBy("g")).applyInArrow(
        windows_of, "shard int, g int, n int, keys binary, owners binary")
    told = held.groupBy("shard").applyInArrow(smaller_owners, "g int, n int, keys binary, owners binary")
    return grouped.cogroup(told.groupBy("g")).applyInArrow(locate, RESULT)


def _passages(group: _Group, told, width: int):
    """Confirmed passages of the group's rows: {row: [(first word, end word,
    largest owner)]}, word numbers within the row."""
    starts, rows = group.windows(width)
    keys, first, inverse = np.unique(C.grams(group.words, width)[starts], return_index=True, return_inverse=True)
    owners = group.ids[rows[first]] if len(keys) else np.zeros(0, np.int64)
    if told.num_rows and len(keys):
        far = np.concatenate([np.frombuffer(b, np.uint64) for b in told.column("keys").to_pylist()])
        owner = np.concatenate([C.unpack(b, n, np.int64) for b, n in
                                zip(told.column("owners").to_pylist(), told.column("n").to_pylist())])
        at = np.searchsorted(keys, far)
        owners = owners.copy()
        np.minimum.at(owners, at, owner)
    owner = owners[inverse] if len(keys) else owners
    mark = np.flatnonzero(owner < group.ids[rows]) if len(keys) else np.zeros(0, np.int64)
    found: dict[int, list] = {}
    if len(mark):
        cut = np.flatnonzero((np.diff(starts[mark]) != 1) | (np.diff(rows[mark]) != 0)) + 1
        heads = np.concatenate([[0], cut])
        tails = np.append(cut, len(mark)) - 1
        largest = np.maximum.reduceat(owner[mark], heads)
        for h, t, top in zip(mark[heads], mark[tails], largest):
            row = int(rows[h])
            base = int(group.first[row])
            found.setdefault(row, []).append((int(starts[h]) - base, int(starts[t]) - base + width, int(top)))
    return found


def _stream(group: _Group, told, width: int):
    import ahocorasick
    import pyarrow as pa
    from collections import defaultdict
    from itertools import count
    found = _passages(group, told, width)
    number = defaultdict(count(1).__next__)
    sequences, phrases = {}, {}
    for row, runs in found.items():
        words = group.texts[row].as_py().encode().split()
        sequences[row] = ids = tuple(map(number.__getitem__, words))
        for a, b, top in runs:
            phrase = ids[a:b]
            phrases[phrase] = min(top, phrases.get(phrase, top))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, top in phrases.items():
        automaton.add_word(phrase, (len(phrase), top))
    if phrases:
        automaton.make_automaton()
    n_removed, all_spans, kept_text = [], [], []
    for row, text in enumerate(group.texts):
        words = (text.as_py() or "").encode().split()
        spans = []
        if row in sequences:
            doc = int(group.ids[row])
            mask = bytearray(b"\x01") * len(words)
            hits = sorted((end + 1 - size, end + 1) for end, (size, top) in automaton.iter(sequences[row]) if top < doc)
            for a, b in hits:
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(b, spans[-1]["end"])
                else:
                    spans.append({"start": a, "end": b})
            for s in spans:
                mask[s["start"]:s["end"]] = bytes(s["end"] - s["start"])
            words = [w for w, keep in zip(words, mask) if keep]
        n_removed.append(sum(s["end"] - s["start"] for s in spans))
        all_spans.append(spans)
        kept_text.append(b" ".join(words).decode())
    return pa.table({
        "doc_id": pa.array(group.ids, pa.int64()),
        "n_words": pa.array(np.diff(group.first), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "spans": pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        "kept_text": pa.array(kept_text, pa.string())})
