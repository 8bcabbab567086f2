"""Small fixtures and brute-force versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

CLASHING = ("kept", "n_words", "g", "shard", "component_id", "probability", "doc", "token", "kind", "score", "text_sha256")


def words(text):
    return (text or "").encode().split()


def lower(text: str) -> bytes:
    return (text or "").encode().lower()


def odd_rows():
    """(doc_id, text) with nulls, blanks, long words and texts, ties and repeats."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "a.b", "LOUD!!", "x" * 70]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two three"), (7, "one TWO three")]
    for i in range(8, 30):
        rows.append((i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 120)))))
    base = rnd.choices(vocabulary, k=80)
    for i in range(30, 42):                            # near copies in a chain
        base = list(base)
        base[rnd.randrange(80)] = f"new{i}"
        rows.append((i, " ".join(base)))
    for i in range(42, 50):                            # a shared passage between own words
        rows.append((i, " ".join(rnd.choices(vocabulary, k=30)) + "\n" + passage + "\t" + " ".join(rnd.choices(vocabulary, k=30))))
    rows += [(i, rows[12][1]) for i in range(50, 56)]  # exact copies
    rows += [(56, rows[12][1].upper()), (57, "end " * 5000), (58, "y" * 200_000), (59, "same " * 12), (59, "same " * 12),
             (60, "\x1c\x85 weird ▁ <|endoftext|> 漢字 😀 <s>")]
    return rows


def frame(spark, rows, clash=True):
    """Documents with every column of the table and, if asked for, more whose names
    operators use inside."""
    extra = [f"{c} string" for c in CLASHING] if clash else []
    data = [(d, t, ["en", "de", None][(d or 0) % 3], ["a", "b"][(d or 0) % 2], len(t or ""), *(["?"] * len(extra)))
            for d, t in rows]
    return spark.createDataFrame(data, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *extra]))


def repeats(rows, width=13):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            owner[k] = min(d, owner.get(k, d))
    out = []
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if owner[tuple(w[i:i + width])] < d:
                keep[i:i + width] = [False] * width
        out.append((d, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out)


def shingles(text, n=5):
    w = words(lower(text).decode())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(rows, n=5, percent=75):
    sets = [(d, shingles(t, n)) for d, t in rows]
    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(i)
    common = Counter((a, b) for at in held.values() for a in at for b in at if a < b)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def exact(rows, best):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        digest = hashlib.sha256(text).hexdigest()
        left = 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and bool(left), digest))
            left -= i == keep
    return out
