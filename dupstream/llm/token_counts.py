"""Token counts by a map-side two-tier lookup.

A byte-level BPE vocabulary splits a text by a fixed pattern into pre-tokens whose
lengths in tokens do not depend on their surroundings.  The lengths of frequent
pre-tokens are looked up in a broadcast hash table (at most ``TABLE`` pre-tokens of
at most ``LONGEST`` characters, so at most some megabytes); what it misses goes
through a bounded cache in each worker, filled by encoding the new pre-tokens of an
Arrow batch in one library call.  The texts' pre-tokens are never shuffled; only those of
the table's sample are, each task's ``PER_TASK`` most frequent ones, summed before at
most ``TABLE`` of them are collected.  The table only decides the speed, never a count.

It is drawn from about ``SAMPLE`` documents picked by a hash of id and text, in as many
tasks as the scan has; counts cover every text whole.  Texts with characters outside the plain ranges below, where
regular-expression libraries may class characters differently, are split by the
library's own pre-tokeniser.

Defined results: null texts are empty (0 bytes, 0 tokens); ids, null ones too, pass
unchanged, also for repeated rows; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C

TABLE = 1 << 16
LONGEST = 48
SAMPLE = 2_000
CACHE = 1_000_000
PER_TASK = 20_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

# The byte-level BPE pattern, white space spelled out, and the
# character ranges in which regular-expression libraries agree.
SPACE = r"\t\n\x0b\x0c\r \u0085   -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
           r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")
UNUSUAL = r"[^\t\n\r\x20-\x7e -ɏΑ-ωА-яḀ-ỿ‐-‧€]"


class Splitter:
    def __init__(self, path: str):
        import os

        import regex
        import tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = regex.compile(PATTERN).findall
        self.unusual = regex.compile(UNUSUAL).search
        plain = self.special and all(not (t.single_word or t.lstrip or t.rstrip or t.normalized)
                                     for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.special and not plain:
            raise ValueError("added tokens that take their surroundings along are not supported")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split \
            if self.special else lambda t: [t]

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings between them."""
        parts = self.cut(text)
        out: list[str] = []
        for part in parts:
            if self.unusual(part):
                at = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                out.extend(part[a:b] for _, (a, b) in at)
            else:
                out.extend(self.pieces(part))
        return out, len(parts) - 1

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _frequent(path: str):
    def run(batches):
        import pyarrow as pa
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(p for p in splitter(path).split(text or "")[0] if len(p) <= LONGEST)
        top = counts.most_common(PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])
    return run


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, most: int = TABLE) -> dict[str, int]:
    """Lengths of at most ``most`` pre-tokens frequent in a bounded sample."""
    every = max(1, docs.count() // sample)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    rows = (picked.mapInArrow(C.tidy("token_counts", _frequent(path)), "piece string, n long").groupBy("piece")
            .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most).collect())   # at most ``most`` short strings
    pieces = [row["piece"] for row in rows]
    return dict(zip(pieces, splitter(path).lengths(pieces))) if pieces else {}


_CACHES: dict[str, C.WordCache] = {}


def _counter(path: str, table, slice_rows: int = 512):
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        s = splitter(path)
        if key not in _CACHES:                       # kept while Spark reuses the worker
            _CACHES.clear()
            C.keep_until_left(_CACHES.clear)
            _CACHES[key] = C.WordCache(CACHE, LONGEST, 0, table.value)
        cache = _CACHES[key]
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            totals = []
            for at in range(0, len(column), slice_rows):
                split = [s.split(t) for t in column.slice(at, slice_rows).to_pylist()]
                counts = cache.totals([pieces for pieces, _ in split], sum, s.lengths)
                totals.extend(n + special for n, (_, special) in zip(counts, split))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(totals, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` and ``n_tokens`` of the whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most TABLE strings of at most LONGEST characters
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path))
    return rows.mapInArrow(C.tidy("token_counts", _counter(path, table)), SCHEMA)
