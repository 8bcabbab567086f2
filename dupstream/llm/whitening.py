"""Embedding whitening with eigenvectors refined in mixed precision.

Entries become whole numbers, ``x = floor(64 * c) + 1000000``.  The fit list holds each
distinct ``x`` vector once.  Its sums and its covariance are exact: rows are centred by
the mean rounded to whole numbers, tasks multiply blocks of at most ``ROWS`` rows of
20-bit limbs, where float64 products are exact, and Spark adds the tasks' matrices as
whole numbers.  What reaches the driver is one matrix of the vectors' dimension.

Its eigenvectors are first taken in float32 and then corrected by the iterations of Ogita
and Aishima, matrix products in extended precision (numpy's ``longdouble``) that double
the correct digits each round.  Eigenvalues closer than the round's error bound form
clusters, whose vectors a correction by differences cannot tell apart: each cluster's
shifted projection ``X'AX - mu X'X`` is a small eigenproblem of its own, solved apart, and
the next rounds correct the result.

Defined results: vectors that are null, empty, of another length than the most frequent
one (ties: the shorter), or that hold entries that are null, not finite, or past 2**46,
beyond which ``64 * c`` has no exact whole part to add to, give no rows; rows with a null id and
rows that repeat an id or vector give rows like any other; components whose eigenvalue is
zero to double precision (``RANK`` of the largest) are left out, so one vector, or equal
ones, give no rows; a deviation that passes 64 bits is null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C

COMPONENTS = 16
ROWS = 1 << 12                   # rows of one exact product: 2**12 * 2**20 * 2**20 < 2**53
LIMB = 20
RANK = 1e-13
ROUNDS = 16
LARGEST = float(1 << 46)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id`` and ``x`` of the rows that take part."""
    out = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall(
        "vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
    sizes = out.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return out.filter(F.size("vec") == (sizes["d"] if sizes else 0)).select(
        "vec_id", F.transform("vec", lambda c: F.floor(c * 64) + F.lit(1000000).cast("long")).alias("x"))


def _matrix(column, dtype=np.int64) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype)
    return flat.reshape(n, len(flat) // n if n else 0)


def _cells(shift: int, sums: np.ndarray):
    import pyarrow as pa
    i, j = np.triu_indices(len(sums)) if sums.ndim == 2 else (np.arange(len(sums)), np.zeros(len(sums), int))
    values = sums[i, j] if sums.ndim == 2 else sums
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shift, np.int32)), pa.array(i.astype(np.int32)),
                                       pa.array(j.astype(np.int32)), pa.array(values)], names=["shift", "i", "j", "v"])


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """float64 arrays of 20-bit limbs, lowest first, the highest signed."""
    out = []
    while True:
        if not len(y) or (-(1 << LIMB) < y.min() and y.max() < (1 << LIMB)):
            return out + [y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def _sums(batches):
    """Sums of each dimension, as (shift, i, 0, v)."""
    for batch in batches:
        x = _matrix(batch.column(0))
        for at in range(0, len(x), ROWS):
            for k, part in enumerate(limbs(x[at:at + ROWS])):
                yield _cells(LIMB * k, part.sum(axis=0).astype(np.int64))


def _products(middle: np.ndarray):
    """Sums of the products of centred entries, as (shift, i, j, v) with i <= j."""
    def run(batches):
        held, blocks = {}, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                parts = limbs(x[at:at + ROWS] - middle)
                for p, a in enumerate(parts):
                    for q, b in enumerate(parts):
                        held[p + q] = held.get(p + q, 0) + (a.T @ b).astype(np.int64)
                blocks += 1
                if blocks % 128 == 0:                   # far below 64 bits
                    yield from (_cells(LIMB * k, v) for k, v in held.items())
                    held = {}
        yield from (_cells(LIMB * k, v) for k, v in held.items())
    return run


CELL = "shift int, i int, j int, v long"


def _whole(cells: DataFrame) -> dict:
    """{(i, j): exact sum}: as many entries as the vectors' dimension allows."""
    out: dict = {}
    for r in cells.groupBy("shift", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["v"]) << r["shift"])
    return out


def extended(numerator: int, denominator: int) -> np.longdouble:
    """A fraction in extended precision."""
    sign, numerator = (-1 if numerator < 0 else 1), abs(numerator)
    shift = 80 + denominator.bit_length() - numerator.bit_length()
    q = (numerator << shift) // denominator if shift >= 0 else numerator // (denominator << -shift)
    cut = max(0, q.bit_length() - 64)
    return sign * np.ldexp(np.longdouble(np.uint64(q >> cut)), cut - shift)


class Fit:
    """Number, sums, rounded mean and covariance of the fit list."""

    def __init__(self, listed: DataFrame):
        self.n = listed.count()
        if not self.n:
            return
        sums = _whole(listed.mapInArrow(_sums, CELL))
        self.dim = len(sums)
        self.sums = [sums[i, 0] for i in range(self.dim)]
        self.middle = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        products = _whole(listed.mapInArrow(_products(self.middle), CELL))
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        self.rest = np.array([float(extended(t, self.n)) for t in rest])
        self.covariance = np.zeros((self.dim, self.dim), np.longdouble)
        for (i, j), v in products.items():
            self.covariance[i, j] = self.covariance[j, i] = extended(self.n * v - rest[i] * rest[j], self.n * self.n)


def clusters(values: np.ndarray, within: float) -> list[np.ndarray]:
    """Indices of values that are chained by gaps of at most ``within``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > within) + 1
    return np.split(order, cuts)


def eigenvectors(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in
    extended precision."""
    wide = np.longdouble
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a), wide), np.eye(len(a), dtype=wide)
    a = a.astype(wide) / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    whole, tiny = np.sqrt((a * a).sum()), 8 * len(a) * np.finfo(wide).eps
    least = whole * np.sqrt(np.finfo(wide).eps)           # below it rounding alone would turn vectors too far
    for _ in range(rounds):
        rest = np.eye(len(a), dtype=wide) - x.T @ x
        seen = x.T @ (a @ x)
        rest, seen = (rest + rest.T) / 2, (seen + seen.T) / 2      # else small gaps blow up what rounding left
        values = np.diag(seen) / (1 - np.diag(rest))
        off = seen - np.diag(np.diag(seen))
        bound = max(2 * (np.sqrt((off * off).sum()) + whole * np.sqrt((rest * rest).sum())), least)
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > bound
        step = np.where(far, (seen + values[None, :] * rest) / np.where(far, gap, 1), rest / 2)
        x = x + x @ step
        close = [c for c in clusters(values, bound) if len(c) > 1]
        for c in close:                                   # sub-solve: the shift keeps their differences
            part = x[:, c]
            mean = values[c].mean()
            small = part.T @ (a @ part - mean * part)
            small = (small + small.T) / 2
            width = np.abs(small).max()
            if width > tiny:
                turn = np.linalg.eigh((small / width).astype(np.float64))[1].astype(wide)
                x[:, c] = part @ (turn + turn @ (np.eye(len(c), dtype=wide) - turn.T @ turn) / 2)
        if np.abs(step).max() <= tiny and all(np.abs(off[np.ix_(c, c)]).max() <= tiny for c in close):
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)     # same sign in every run
    return values[order] * size, x


class Whitener:
    """What a row needs: centre, axes over the root of their eigenvalue, and sums."""

    def __init__(self, fit: Fit, axes: np.ndarray):
        self.n, self.middle, self.rest, self.axes = fit.n, fit.middle, fit.rest, axes
        self.remainder = [s - fit.n * int(m) for s, m in zip(fit.sums, fit.middle)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle).astype(np.float64) - self.rest) @ self.axes

    def deviation(self, x: np.ndarray):
        import pyarrow as pa
        y = x - self.middle
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if largest * largest * max(1, y.shape[1]) < 1 << 63:
            d = self.n * y - np.array(self.remainder, np.int64)
            return pa.array((d * d).sum(axis=1))
        d = self.n * y.astype(object) - np.array(self.remainder, object)
        return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()], pa.int64())


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error`` of every remaining row and component."""
    spark = rows.sparkSession
    valid = whole_vectors(rows, id_col, vec_col)
    listed = C.stored(spark, valid.select("x").distinct(), "whitening-fit")
    fit = Fit(listed)
    id_type = valid.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, "
                                      "explained double, identity_error double")
    if not fit.n:
        return empty
    values, axes = eigenvectors(fit.covariance)
    kept = min(components, int((values > RANK * max(values[0], 0)).sum()))
    if not kept:
        return empty
    shared = spark.sparkContext.broadcast(Whitener(fit, (axes[:, :kept] / np.sqrt(values[:kept])).astype(np.float64)))
    error = _identity_error(listed, shared, kept, fit.n)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = _matrix(batch.column(1))
            z = shared.value.whitened(x) if len(x) else np.zeros((0, kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), shared.value.deviation(x) if len(x) else pa.array([], pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, z.size + 1, kept, dtype=np.int32), pa.array(z.ravel()))],
                names=["vec_id", "deviation", "z"])

    shares = F.array(*[F.lit(float(v)) for v in values[:kept] / np.trace(fit.covariance)])
    return (valid.mapInArrow(run, f"vec_id {id_type}, deviation long, z array<double>")
            .select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))


def _identity_error(listed: DataFrame, shared, kept: int, n: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros((kept + 1, kept + 1))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                z = np.column_stack([shared.value.whitened(x), np.ones(len(x))])
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    moments = np.zeros((kept + 1, kept + 1))
    for r in listed.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r["i"], r["j"]] = r["v"] / n                     # (kept + 1) ** 2 rows
    mean = moments[:kept, kept]
    return float(np.abs(moments[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
