"""SimHash near-duplicates found through Golay codewords.

A document's fingerprint has 64 bits: bit ``i`` is set when it is set in more than half
of the XXH64 values (seed 42) of the text's 3-word shingles.  Two fingerprints link when
they differ in at most two bits.

The search keys are codewords of the perfect binary Golay code (23, 12, 7).  Decoding
takes every 23-bit word to the one codeword within three bits.  Two words that differ in
at most two bits have a word between them, at most one bit from each, so decoding a
word's whole neighbourhood of radius one gives a set of one or six codeword indices, and
the sets of the two words meet.  A fingerprint is cut into segments of 22, 21 and 21
bits.  Two errors cannot touch all three, so some segment is untouched, and the next one
differs in at most two bits: the key (untouched segment, codeword index of the next one)
is shared by every pair that links, in one of three rotations.

Fingerprints that are equal are one node.  Pairs that share a key are joined and
verified where a key has at most ``BUSY`` fingerprints.  The fingerprints of busier keys
are grouped by the words between them instead (itself and its 64 neighbours at one bit):
all members of such a group, at most 65, are within two bits of each other, so linking
each to the smallest loses nothing and makes no pairs.

Defined results: null texts and texts without words have fingerprint zero and link like
any other; one or two words are one shingle; A-Z alone are folded; texts of any length
are hashed in blocks of bounded size; rows with a null id give no row; rows that repeat
an id each give a row with their own fingerprint; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C
from dupstream.llm.components import components
from dupstream.operators.skew import join_back

SHINGLE = 3
SEED = 42
NEAR_BITS = 2
SEGMENTS = (22, 21, 21)          # widths from the top bit down; at most 23 each
BUSY = 24                        # fingerprints of one key that are compared in pairs
BLOCK = 1 << 20                  # bytes of text hashed at a time

# The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the Golay code.
GENERATOR = 0b101011100011


def word_blocks(text: bytes, size: int = BLOCK):
    """Lists of words of consecutive parts of a text of about ``size`` bytes; parts
    end at white space."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
                end += 1
        words = text[at:end].split()
        if words:
            yield words
        at = end


def shingle_hashes(text: bytes, n: int = SHINGLE):
    """XXH64 arrays of the text's shingles, block by block."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    carry: list = []
    whole = True
    for block in word_blocks(text):
        words = carry + block
        if len(words) >= n:
            whole = False
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:len(words) - n + 1].tolist()
            stops = (ends[n - 1:] - 1).tolist()
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
        carry = words[-(n - 1):] if n > 1 else []
    if whole and carry:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit ``i``, for ``i`` from 0 to 63."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return out


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes((text or "").encode().lower()):
        counts += bit_counts(hashes)
        total += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


@functools.lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of ``m * x^11`` for every 12-bit message, and the error pattern of
    every 11-bit syndrome (all patterns of at most three bits, each with its own)."""
    remainder = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        word = 1 << (11 + bit)
        for k in range(11 + bit, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        remainder[1 << bit:2 << bit] = remainder[:1 << bit] ^ word
    ones = np.concatenate([[0], 1 << np.arange(23)])
    errors = np.unique((ones[:, None, None] ^ ones[None, :, None] ^ ones[None, None, :]).ravel())
    pattern = np.zeros(1 << 11, np.int64)
    pattern[remainder[errors >> 11] ^ (errors & 2047)] = errors
    return remainder, pattern


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    remainder, pattern = _golay()
    syndrome = remainder[words >> 11] ^ (words & 2047)
    return (words ^ pattern[syndrome]) >> 11


def codeword_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every distinct codeword index in the radius-one neighbourhood of
    words of ``width`` bits."""
    around = words[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
    found = np.sort(codeword_index(around), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(first)
    return row, found[row, column]


def search_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every search key of unsigned fingerprints."""
    parts, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        parts.append(((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
    rows, keys = [], []
    for i, same in enumerate(parts):
        j = (i + 1) % len(parts)
        row, index = codeword_indices(parts[j], SEGMENTS[j])
        rows.append(row)
        keys.append(i << 40 | same[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row with an id."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(1)
            out = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])
            del batch, texts
        C.give_back()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _keyed(batches):
    """Distinct fingerprints to (fp, key)."""
    import pyarrow as pa
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 1 << 14):
            part = fps[at:at + (1 << 14)]
            row, key = search_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], names=["fp", "key"])


def links(distinct: DataFrame, busy: int = BUSY) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) whose closure is
    that of all pairs within two bits."""
    spark = distinct.sparkSession
    keyed = C.stored(spark, distinct.mapInArrow(_keyed, "fp long, key long"), "golay")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").withColumn("n", F.col("held"))
    shared = C.stored(spark, join_back(keyed, sizes, "key", "n"), "golay-shared")
    quiet = shared.filter(F.col("held") <= busy).select("key", "fp")
    pairs = (quiet.withColumnRenamed("fp", "a").join(quiet.withColumnRenamed("fp", "b"), "key")
             .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR_BITS))
             .select("a", "b"))
    crowd = shared.filter(F.col("held") > busy).select("fp").distinct()
    between = F.transform(F.sequence(F.lit(-1), F.lit(63)),
                          lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = (crowd.withColumn("word", F.explode(between)).groupBy("word")
             .agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a"))          # at most 65 by geometry
             .withColumn("b", F.explode("fps")).filter("a != b").select("a", "b"))
    return pairs.unionAll(stars).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", busy: int = BUSY) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id
    reachable by links, itself included)."""
    spark = docs.sparkSession
    prints = C.stored(spark, fingerprints(docs, id_col, text_col), "simhash")
    distinct = C.stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(links(distinct.select("fp"), busy)).withColumnRenamed("node", "fp")
    nodes = C.stored(spark, distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-nodes")
    heads = nodes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held"))
    owned = join_back(nodes, heads, "component", "held").select("fp", "component_id", "n")
    return join_back(prints, C.stored(spark, owned, "simhash-owned"), "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
