"""Helpers shared by the text operators: table reading, checkpoint folder,
and word hashing over whole Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes.  A word's 64-bit hash is a
polynomial over random per-byte values (arithmetic modulo 2**64), computed with
prefix sums for a whole block of bytes at a time, so no Python object exists per
word.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 1 << 20                                   # bytes hashed per block
_BASE = 0x9E3779B97F4A7C15 | 3                   # odd, 3 modulo 4
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    from dupstream.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later plans
    start from files that survive the loss of any executor."""
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory of a Python worker to the system: workers are reused by later
    stages."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # another C library
        pass


_worker: dict = {"at": None, "drops": []}


def enter(operator: str) -> None:
    """Called by a task's Python code: a worker that last worked for another operator
    drops that one's caches and gives their memory back first."""
    if _worker["at"] not in (None, operator):
        for drop in _worker["drops"]:
            drop()
        _worker["drops"].clear()
        give_back()
    _worker["at"] = operator


def keep_until_left(drop) -> None:
    """``drop`` empties a cache of the operator entered last."""
    if drop not in _worker["drops"]:
        _worker["drops"].append(drop)


def tidy(operator: str, run):
    """``run``, a function for ``mapInArrow``, between ``enter`` and ``give_back``."""
    def whole(batches):
        enter(operator)
        yield from run(batches)
        give_back()
    return whole


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of all texts (one column-pruned aggregate)."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return int(row["b"] or 0)


@functools.lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(SPAN + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column (Array or ChunkedArray); nulls are
    empty."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):      # several chunks past 2 GB
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and for each text the index
    of its first word (length n + 1)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    seg = data[lo:hi]
    if not len(seg):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    black = ~((seg == 32) | ((seg >= 9) & (seg <= 13)))
    edge = np.zeros(len(seg) + 1, bool)
    edge[offsets - lo] = True                        # a text's first byte; texts never share a word
    before = np.empty_like(black)
    before[0] = False
    before[1:] = black[:-1]
    starts = np.flatnonzero(black & (~before | edge[:-1]))
    after = np.empty_like(black)
    after[-1] = False
    after[:-1] = black[1:]
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets - lo)
    values = _byte_values(fold_case)
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SPAN, "right"))
        if j <= i:                                   # one word longer than a block
            import xxhash
            word = seg[starts[i]:ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(word.lower() if fold_case else word)
            i += 1
            continue
        base = starts[i]
        part = values[seg[base:ends[j - 1]]]
        part *= power[:len(part)]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=prefix[1:])
        s = starts[i:j] - base
        out[i:j] = (prefix[ends[i:j] - base] - prefix[s]) * inverse[s]
        i = j
    return mix(out), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (no regard to texts)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    base = np.uint64(_BASE)
    for j in range(n):
        out *= base
        out += words[j:j + m]
    return mix(out)


def pack(a: np.ndarray) -> bytes:
    import pyarrow as pa
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int, dtype) -> np.ndarray:
    import pyarrow as pa
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(b, decompressed_size=size, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def spans(offsets: np.ndarray, most: int):
    """Index ranges of consecutive texts of at most ``most`` bytes together
    (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class WordCache(dict):
    """Bounded worker cache of two generations.  A word in neither is noted in
    ``late`` and read as ``blank`` until the caller has filled it in."""

    def __init__(self, most: int, longest: int, blank, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.half, self.longest, self.blank, self.fixed = most // 2, longest, blank, fixed or {}
        self.older: dict = {}
        self.late: list = []

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            self.late.append(word)
            return self.blank
        self[word] = value
        return value

    def turn(self, long_words: list) -> None:
        """Between batches: forget over-long words, and the older generation
        when the younger one is full."""
        for word in long_words:
            self.pop(word, None)
        if len(self) - len(self.fixed) > self.half:
            self.older = {k: v for k, v in self.items()}
            self.clear()
            self.update(self.fixed)

    def totals(self, items: list, join, fill) -> list:
        """``join(map(lookup, words))`` of every word list; ``fill`` gives the
        values of the words that are new to the batch, in one call."""
        get = self.__getitem__
        out, again = [], []
        for at, words in enumerate(items):
            before = len(self.late)
            out.append(join(map(get, words)))
            if len(self.late) > before:
                again.append(at)
        if again:
            new = list(set(self.late))
            self.late.clear()
            self.update(zip(new, fill(new)))
            for at in again:
                out[at] = join(map(get, items[at]))
            self.turn([w for w in new if len(w) > self.longest])
        return out
