"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade > k) = sigmoid(s - threshold_k)`` with one score ``s`` for all ordered
thresholds.  ``s`` is linear in hashed text features: the share that each word, each
word's first bytes and each pair of word-end classes has among a document's words,
and bins of length, of distinct words and of words that repeat their predecessor.

The model is fitted in one task on a bounded sample of rated documents (``SAMPLE`` of each
grade in id-hash order, a documented parameter), whole texts of every length; very long
ones are cut into features a few megabytes of documents at a time.  Every document is then scored whole, map-side, with the
weights broadcast (``FEATURES`` + a few hundred 4-byte numbers, a fixed size).

Defined results: null and empty texts score as documents without words; every row is
returned, repeated ones too; ids may be null; ratings that are null, or of documents
that are not there, are not used; without ratings of at least two grades every
document gets the expected grade of a uniform choice and is kept; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupstream.llm import common as C

FEATURES = 1 << 18
SAMPLE = 2_500                 # rated documents of each grade that the fit may use
GRADES = 3
STEPS = 100
KEEP_TAIL = 0.4
PREFIXES = (4, 5)              # first bytes of a word that are features of their own
ENDS = 4.0                     # scale of the shares of word-end classes
MIN_SHARE = 200                # a hashed feature needs one sample document in so many
CHUNK_BYTES = 8 << 20
_BINS = 64                     # bins of the document-level features, after the hashed ones
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[128:] = 1, 1
_CLASS[65:91], _CLASS[48:58] = 2, 3
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = _c


def features(data: np.ndarray, offsets: np.ndarray):
    """Families of hashed features as (document, bucket, scale of each document),
    and the bins of each document."""
    words, first = C.word_hashes(data, offsets, fold_case=True)
    counts = np.diff(first)
    n = len(counts)
    doc = np.repeat(np.arange(n, dtype=np.int32), counts)
    size = np.maximum(counts, 1)
    families, distinct, again = [], np.zeros(n, np.int64), np.zeros(n)
    if len(words):
        seg = data[offsets[0]:offsets[-1]]
        starts, ends = _bounds(seg, offsets - offsets[0])
        own = np.sort(np.unique((doc.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)), return_index=True)[1])
        own_doc, s, e = doc[own], starts[own], ends[own]
        distinct = np.bincount(own_doc, minlength=n)
        evenly = 1 / np.sqrt(np.maximum(distinct, 1))
        low = np.where((seg >= 65) & (seg <= 90), seg + 32, seg).astype(np.uint64)
        h = np.full(len(own), 7, np.uint64)
        for k in range(PREFIXES[-1]):                     # first bytes of every distinct word
            at = s + k
            h = h * np.uint64(257) + np.where(at < e, low[np.minimum(at, len(seg) - 1)], 0)
            if k + 1 in PREFIXES:
                families.append((own_doc, _bucket(C.mix(h)), evenly))
        families.append((own_doc, _bucket(words[own]), evenly))
        last = _CLASS[seg[ends - 1]]
        before = np.where(ends - 2 >= starts, _CLASS[seg[np.maximum(ends - 2, 0)]], 0)
        families.append((doc, _bucket(C.mix(np.uint64(1 << 40) + last * np.uint64(256) + before)), ENDS / size))
        same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:], weights=same, minlength=n)
    bins = np.stack([np.minimum(19, (20 * distinct / size).astype(int)),
                     20 + np.minimum(15, np.ceil(np.log2(counts + 1)).astype(int)),
                     40 + np.minimum(19, np.ceil(20 * again / size).astype(int))], axis=1)
    return families, FEATURES + bins


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(FEATURES)).astype(np.int32)


def _linear(weights, families, bins) -> np.ndarray:
    out = weights[bins].sum(axis=1).astype(np.float64)
    for doc, bucket, scale in families:
        out += np.bincount(doc, weights=weights[bucket], minlength=len(bins)) * scale
    return out


def _bounds(seg: np.ndarray, offsets: np.ndarray):
    black = ~((seg == 32) | ((seg >= 9) & (seg <= 13)))
    edge = np.zeros(len(seg) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], black[:-1]])
    after = np.concatenate([black[1:], [False]])
    return np.flatnonzero(black & (~before | edge[:-1])), np.flatnonzero(black & (~after | edge[1:])) + 1


class Model:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def scores(self, data, offsets) -> np.ndarray:
        return _linear(self.weights, *features(data, offsets))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) of every score, by k."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds[None, :])))


def sample_features(data: np.ndarray, offsets: np.ndarray):
    """``features`` of all documents, made for ``CHUNK_BYTES`` of text at a time."""
    parts = [(i, *features(data, offsets[i:j + 1])) for i, j in C.spans(offsets, CHUNK_BYTES)]
    bins = np.concatenate([own for _, _, own in parts])
    parts = [p for p in parts if p[1]]                    # a part without words has no families
    families = []
    for k in range(len(parts[0][1]) if parts else 0):
        scale = np.zeros(len(bins))
        for i, some, own in parts:
            scale[i:i + len(own)] = some[k][2]
        families.append((np.concatenate([some[k][0] + np.int32(i) for i, some, _ in parts]),
                         np.concatenate([some[k][1] for _, some, _ in parts]), scale))
    return families, bins


def fit(data: np.ndarray, offsets: np.ndarray, grades: np.ndarray, levels: int = GRADES,
        steps: int = STEPS, penalty: float = 3e-5, rate: float = 0.3, min_share: int = MIN_SHARE) -> Model:
    """Maximum likelihood with an L2 penalty; Adam on the full sample.  Hashed
    features that fewer than one in ``min_share`` documents (two at least) have keep weight 0."""
    families, bins = sample_features(data, offsets)
    n = len(grades)
    min_docs = max(2, n // min_share)
    used = np.zeros(FEATURES + _BINS)
    used[FEATURES:] = 1
    for doc, bucket, _ in families:
        pairs = np.unique(doc.astype(np.int64) * FEATURES + bucket) % FEATURES
        used[:FEATURES] += np.bincount(pairs, minlength=FEATURES) >= min_docs
    used = np.minimum(used, 1)
    families = [(d[k], b[k], s) for d, b, s in families for k in [np.flatnonzero(used[b])]]
    present = np.bincount(grades, minlength=levels)
    share = (n / (np.count_nonzero(present) * np.maximum(present, 1)))[grades] / n
    w = np.zeros(FEATURES + _BINS)
    below = np.cumsum(present)[:-1] / n
    cut = np.log(np.clip(below, 0.01, 0.99) / np.clip(1 - below, 0.01, 0.99))
    gaps = np.log(np.maximum(np.diff(cut), 0.1))           # thresholds: first value and log gaps, so always ordered
    theta = np.concatenate([cut[:1], gaps])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    for t in range(1, steps + 1):
        s = _linear(w, families, bins)
        points = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
        edges = np.concatenate([[-np.inf], points, [np.inf]])
        hi, lo = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        g_s = share * (d_hi - d_lo) / p                    # gradient of -log p by the score
        g_w = penalty * w
        for doc, bucket, scale in families:
            g_w += np.bincount(bucket, weights=(g_s * scale)[doc], minlength=len(w))
        for k in range(bins.shape[1]):
            g_w += np.bincount(bins[:, k], weights=g_s, minlength=len(w))
        g_point = np.array([(-(share * d_hi / p)[grades == k].sum() + (share * d_lo / p)[grades == k + 1].sum())
                            for k in range(levels - 1)])
        g_t = np.concatenate([[g_point.sum()], [np.exp(theta[k]) * g_point[k:].sum() for k in range(1, len(theta))]])
        for x, g, m, v in ((w, g_w, state[0], state[1]), (theta, g_t, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
    points = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])
    return Model(w.astype(np.float32), points)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def rated_sample(docs: DataFrame, ratings: DataFrame, per_grade: int = SAMPLE, levels: int = GRADES) -> DataFrame:
    """``text``, ``grade`` of at most ``per_grade`` documents of each grade, in hash order of
    their ids.  Grades outside 0 .. ``levels`` - 1 count as the nearest one; a rating given twice
    counts once; of documents that repeat an id the smallest text is taken."""
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select(
        "doc_id", F.greatest(F.lit(0), F.least(F.lit(levels - 1), "grade")).alias("grade")).distinct()
    drawn = reduce(DataFrame.unionAll, [known.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
                                        for g in range(levels)])
    # at most ``levels`` times ``per_grade`` short rows
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
            .groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade"))


def fit_sample(sample: DataFrame, levels: int = GRADES) -> Model | None:
    """Fit in one task on the bounded sample; None without two grades."""
    def run(table):
        import pyarrow as pa
        C.enter("quality")
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        grades = np.clip(table.column("grade").to_numpy().astype(np.int64), 0, levels - 1)
        if len(np.unique(grades)) < 2:
            return pa.table({"weights": pa.array([], pa.binary()), "thresholds": pa.array([], pa.list_(pa.float64()))})
        data, offsets = C.string_buffers(table.column("text"))
        model = fit(data, offsets, grades, levels)
        C.give_back()
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()),
                         "thresholds": pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))})
    rows = (sample.withColumn("one", F.lit(0)).groupBy("one")
            .applyInArrow(run, "weights binary, thresholds array<double>").collect())
    return Model(np.frombuffer(rows[0]["weights"], np.float32), np.array(rows[0]["thresholds"])) if rows else None


RESULTS = ("expected_grade", "tail", "kept")


def grade(docs: DataFrame, ratings: DataFrame, levels: int = GRADES, keep_tail: float = KEEP_TAIL,
          carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = RESULTS) -> DataFrame:
    """Per row: the columns ``carry`` and, under ``names``, the expected grade, the
    tail (probability of the top grade) and whether it is at least ``keep_tail``.
    ``ratings`` has ``doc_id`` and ``grade`` 0 .. ``levels`` - 1."""
    spark = docs.sparkSession
    model = fit_sample(rated_sample(docs, ratings, levels=levels), levels)
    if model is None:
        return docs.select(*carry, F.lit((levels - 1) / 2).alias(names[0]), F.lit(1 / levels).alias(names[1]),
                           F.lit(True).alias(names[2]))
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*carry, *(["text"] if "text" not in carry else []))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = C.string_buffers(batch.column("text"))
            tails = [shared.value.tails(shared.value.scores(data, offsets[i:j + 1]))
                     for i, j in C.spans(offsets, CHUNK_BYTES)]
            t = np.concatenate(tails) if tails else np.zeros((0, levels - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(t.sum(axis=1)), pa.array(t[:, -1]),
                 pa.array(t[:, -1] >= keep_tail)], names=[*carry, *names])

    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField(names[0], T.DoubleType()),
                           T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return rows.mapInArrow(C.tidy("quality", run), schema)


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades from two binary labels: 0 low quality, 1 toxic, 2 neither."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2).alias("grade"))
