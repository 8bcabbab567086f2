"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner products become smallest distances by one added coordinate: with ``M``
the largest norm, ``x`` becomes ``(x, sqrt(M^2 - |x|^2))`` and a query ``q`` becomes
``(q * M / |q|, 0)``.  ``PROJECTIONS`` Gaussian (2-stable) projections map a distance
``d`` to one whose square is ``d^2`` times a chi-square variable.  Points are indexed
by kd-tree in the projected space and met in order of projected distance; each is
verified with its original vector, and a query stops when the next projected distance
``p`` satisfies ``chi2cdf(p^2 / d_k^2) >= CONFIDENCE`` with ``d_k`` the k-th best
distance so far: a nearer point beyond would be a rare one.

Spark deals the index out by the top of the tree, whose planes are fitted on at most
``SAMPLE`` points (every point is indexed).  A query first searches its own cell, then
visits only those cells whose box the test cannot rule out, in blocks of ``BLOCK``
queries.  Equal vectors are one point with their ``k + 1`` smallest ids, so a vector
that a third of all rows share is searched once.

Defined results: rows with a null id, a null or zero vector, or null or non-finite
components take no part, nor do vectors of another length than the most frequent one;
rows that repeat an id and vector are one; fewer candidates than ``k`` are all returned;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstream.llm import common as C

PROJECTIONS = 8
CONFIDENCE = 0.99
K = 20
QUERY_EVERY = 20
CELL_POINTS = 8_192
MOST_CELLS = 4_096              # cells on the driver: a fixed bound; beyond it cells grow
SAMPLE = 20_000
LEAF = 64
BLOCK = 8_192


def chi_square_point(p: float, m: int) -> float:
    """The x with chi2cdf(x, m) = p for even ``m``, by bisection of the closed
    form 1 - exp(-x/2) * sum((x/2)^i / i!)."""
    def cdf(x):
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec`` of the rows that take part, and two hashes that tell
    vectors apart."""
    v = F.col("vec")
    fine = (F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(fine)
    sizes = out.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    out = out.filter(F.size("vec") == (sizes["d"] if sizes else 0))
    return out.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64("vec", F.lit(1)))


class Index:
    """Projection, the planes of the top of the tree, and M."""

    def __init__(self, dim: int, largest: float, m: int = PROJECTIONS):
        self.largest = largest
        self.axes = np.random.default_rng(8).standard_normal((dim + 1, m))
        self.planes: list[tuple[int, float]] = []
        self.depth = 0

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest ** 2 - (vectors ** 2).sum(axis=1), 0))
        return np.column_stack([vectors, rest]) @ self.axes

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        scale = self.largest / np.sqrt((vectors ** 2).sum(axis=1))
        return (vectors * scale[:, None]) @ self.axes[:-1]

    def plant(self, sample: np.ndarray, depth: int) -> None:
        """Median planes of a balanced top of the tree, in heap order."""
        self.depth, level = depth, [sample]
        for _ in range(depth):
            below = []
            for part in level:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
                at = float(np.median(part[:, axis])) if len(part) else 0.0
                self.planes.append((axis, at))
                left = part[:, axis] <= at
                below += [part[left], part[~left]]
            level = below

    def cells(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        if self.planes:
            axis = np.array([a for a, _ in self.planes])
            at = np.array([x for _, x in self.planes])
            for _ in range(self.depth):
                right = projected[np.arange(len(node)), axis[node]] > at[node]
                node = 2 * node + 1 + right
        return (node - ((1 << self.depth) - 1)).astype(np.int32)


def _matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of every query to every box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


class Tree:
    """kd-tree of one cell: leaves as slices of the reordered points, with boxes."""

    def __init__(self, projected: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(projected))
        leaves, stack = [], [(0, len(projected))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                leaves.append((a, b))
                continue
            part = projected[self.order[a:b]]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.leaves = leaves
        parts = [projected[self.order[a:b]] for a, b in leaves]
        self.low = np.array([p.min(axis=0) for p in parts])
        self.high = np.array([p.max(axis=0) for p in parts])


def _search(tree: Tree, vectors: np.ndarray, queries: np.ndarray, flat: np.ndarray, limits: np.ndarray,
            index: Index, point: float, k: int):
    """For each query its best ``k`` points of the cell that lie within the
    query's limit (squared distance): (positions, inner products)."""
    near = _box_distances(flat, tree.low, tree.high)
    order = np.argsort(near, axis=1, kind="stable")
    top = index.largest
    norms = np.sqrt((queries ** 2).sum(axis=1))
    sorted_vectors = vectors[tree.order]
    for i, q in enumerate(queries):
        # squared distance 2 M^2 - 2 M (q . x) / |q|; a larger product is a smaller distance
        floor = (2 * top * top - limits[i]) * norms[i] / (2 * top) if np.isfinite(limits[i]) else -np.inf
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        kth, at, step = limits[i], 0, 1
        ranked, gaps = order[i], near[i][order[i]]
        while at < len(ranked) and gaps[at] < point * kth:
            to = at + step
            take = [leaf for leaf, gap in zip(ranked[at:to].tolist(), gaps[at:to].tolist()) if gap < point * kth]
            rows = np.concatenate([np.arange(*tree.leaves[leaf]) for leaf in take])
            products = sorted_vectors[rows] @ q
            fine = products >= floor - 1e-9 * abs(floor) if np.isfinite(floor) else slice(None)
            best_at, best = np.concatenate([best_at, rows[fine]]), np.concatenate([best, products[fine]])
            if len(best) > k:
                # keep ties at the cut: the id decides between them later
                cut = np.partition(best, len(best) - k)[len(best) - k]
                keep = best >= cut - 1e-12 * max(1.0, abs(cut))
                best_at, best = best_at[keep], best[keep]
            if len(best) >= k:
                kth = min(kth, 2 * top * top - 2 * top * best.min() / norms[i])
            at, step = to, min(2 * step, 16)
        yield tree.order[best_at]


POINTS = "cell int, h1 long, h2 long, vec array<double>, ids array<long>"


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            every: int = QUERY_EVERY, confidence: float = CONFIDENCE, projections: int = PROJECTIONS,
            cell_points: int = CELL_POINTS) -> DataFrame:
    """Per query (row whose id is divisible by ``every``) its ``k`` nearest found:
    ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_col, vec_col).select("id", "vec", "h1", "h2").dropDuplicates(["id", "h1", "h2"])
    by_vector = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = C.stored(spark, valid.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
                        .groupBy("h1", "h2").agg(F.first("vec").cast("array<double>").alias("vec"),
                                                 F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda t, x: t + x * x))).alias("top")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    dim, point = facts["d"], chi_square_point(confidence, projections)
    index = Index(dim, facts["top"] * (1 + 1e-12), projections)
    cells = min(MOST_CELLS, max(1, -(-facts["n"] // cell_points)))
    sample = distinct.select("vec").orderBy("h1", "h2").limit(SAMPLE).toArrow()      # at most SAMPLE vectors
    index.plant(index.points(_matrix(sample.column("vec"), dim)), max(0, int(np.ceil(np.log2(cells)))))
    shared = spark.sparkContext.broadcast(index)                                     # planes and axes: a fixed bound

    def dealt(batches):
        import pyarrow as pa
        for batch in batches:
            cell = shared.value.cells(shared.value.points(_matrix(batch.column("vec"), dim))) if batch.num_rows \
                else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *[batch.column(c) for c in ("h1", "h2", "vec", "ids")]],
                                             names=["cell", "h1", "h2", "vec", "ids"])

    points = C.stored(spark, distinct.mapInArrow(dealt, POINTS), "points")
    boxes = points.select("cell", "vec").groupBy("cell").applyInArrow(
        _boxes(shared, dim), "cell int, low array<double>, high array<double>").toArrow()   # at most MOST_CELLS boxes
    boxes = {c: (lo, hi) for c, lo, hi in zip(*[boxes.column(n).to_pylist() for n in ("cell", "low", "high")])}
    wanted = C.stored(spark, valid.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2"), "queries")
    searched = wanted.select("h1", "h2").distinct().join(distinct, ["h1", "h2"]).select("h1", "h2", "vec")
    blocks = max(1, -(-searched.count() // BLOCK))
    routed = searched.withColumn("block", F.pmod(F.hash("h1"), F.lit(blocks)))
    places = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = "block int, cell int, h1 long, h2 long, vec array<double>, within double"
    home = routed.mapInArrow(_home(shared, dim, boxes), asked)
    hits = "h1 long, h2 long, score double, ids array<long>"
    first = C.stored(spark, home.groupBy("cell", "block").cogroup(places.groupBy("cell", "block"))
                     .applyInArrow(_cell_search(shared, dim, point, k + 1), hits), "home")
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"))
    bound = (first.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k + 1)
             .select("h1", "h2", F.col("score").alias("floor")))
    away = routed.join(bound, ["h1", "h2"], "left").mapInArrow(_away(shared, dim, boxes, point), asked)
    other = away.groupBy("cell", "block").cogroup(places.groupBy("cell", "block")).applyInArrow(
        _cell_search(shared, dim, point, k + 1), hits)
    found = first.unionAll(other).withColumn("vec_id", F.explode("ids")).drop("ids")
    ranked = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
    own = Window.partitionBy("query_id").orderBy("place")
    return (wanted.join(top, ["h1", "h2"]).filter("vec_id != query_id")
            .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _boxes(shared, dim):
    def run(key, table):
        import pyarrow as pa
        p = shared.value.points(_matrix(table.column("vec"), dim))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "low": pa.array([p.min(axis=0).tolist()]),
                         "high": pa.array([p.max(axis=0).tolist()])})
    return run


def _asked(batch, take, cells, within):
    import pyarrow as pa
    at = pa.array(take, pa.int64())
    return pa.RecordBatch.from_arrays([
        batch.column("block").take(at), pa.array(cells, pa.int32()), batch.column("h1").take(at),
        batch.column("h2").take(at), batch.column("vec").take(at), pa.array(within, pa.float64())],
        names=["block", "cell", "h1", "h2", "vec", "within"])


def _home(shared, dim, boxes):
    """Every query with its first cell: the one whose box is nearest."""
    numbers = sorted(boxes)
    low, high = (np.array([boxes[c][s] for c in numbers]) for s in (0, 1))

    def run(batches):
        for batch in batches:
            flat = shared.value.queries(_matrix(batch.column("vec"), dim))
            near = np.argmin(_box_distances(flat, low, high), axis=1)
            yield _asked(batch, np.arange(len(flat)), [numbers[c] for c in near], np.full(len(flat), np.inf))
    return run


def _away(shared, dim, boxes, point):
    """Every query with all further cells that the stopping test cannot rule out."""
    numbers = np.array(sorted(boxes))
    low, high = (np.array([boxes[c][s] for c in numbers]) for s in (0, 1))

    def run(batches):
        for batch in batches:
            index, vectors = shared.value, _matrix(batch.column("vec"), dim)
            near = _box_distances(index.queries(vectors), low, high)
            floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(float)
            norms = np.sqrt((vectors ** 2).sum(axis=1))
            within = np.where(np.isnan(floor), np.inf, 2 * index.largest ** 2 - 2 * index.largest * floor / norms)
            home = np.argmin(near, axis=1)
            go = near < point * np.maximum(within, 0)[:, None]
            go[np.arange(len(home)), home] = False
            take, cell = np.nonzero(go)
            yield _asked(batch, take, numbers[cell], within[take])
    return run


def _cell_search(shared, dim, point, k):
    def run(key, asked, places):
        import pyarrow as pa
        none = {"h1": [], "h2": [], "score": [], "ids": []}
        if asked.num_rows and places.num_rows:
            index = shared.value
            vectors, queries = _matrix(places.column("vec"), dim), _matrix(asked.column("vec"), dim)
            tree = Tree(index.points(vectors))
            ids = places.column("ids").to_pylist()
            hits = _search(tree, vectors, queries, index.queries(queries), asked.column("within").to_numpy(), index, point, k)
            for h1, h2, q, at in zip(asked.column("h1").to_pylist(), asked.column("h2").to_pylist(), queries, hits):
                scores = (vectors[at] * q).sum(axis=1)     # one order of summation for every point
                none["h1"] += [h1] * len(at)
                none["h2"] += [h2] * len(at)
                none["score"] += scores.tolist()
                none["ids"] += [ids[i] for i in at.tolist()]
        return pa.table({"h1": pa.array(none["h1"], pa.int64()), "h2": pa.array(none["h2"], pa.int64()),
                         "score": pa.array(none["score"], pa.float64()), "ids": pa.array(none["ids"], pa.list_(pa.int64()))})
    return run
