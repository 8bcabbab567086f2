"""Phrase collocations by partitioned mining (SON).

A phrase is a run of two to four words inside one piece of a text; pieces end at
``. , ; : ! ?`` and line breaks, words at blanks and tabs, A-Z are folded.  Everything is
per language (null: ``und``).  A phrase that occurs at least ``support`` times is a
candidate and is scored by its weakest cut, ``floor(2000000 * a / (l + r))``.

The documents are dealt into ``SHARDS`` shards by a hash of their id and text.  If a
phrase occurs fewer than ``ceil(support / SHARDS)`` times in every shard, it occurs fewer
than ``support`` times in all, whatever the shards' sizes; so

1. every shard is mined completely at that lowered support, first for pairs of words,
   then for runs of three and four whose pairs are all frequent in the same shard;
2. the locally frequent phrases of all shards are united;
3. the united phrases, and they alone, are counted exactly over all documents.

A shard is spread over as many tasks as its rows need.  Steps 1 and 2 work on 64-bit
hashes: two phrases with one hash can only let a phrase through, never lose one.  The
frequent hashes reach the next pass as a bit table of at most ``MOST_BITS`` bits, the
bound of what is broadcast; more frequent phrases than it tells apart let further
phrases through to the exact count, which drops them.  Step 3 counts the phrases
themselves, not hashes.  More shards than ``support`` would lower the local support to
one, where nothing is pruned, so their number is fixed.

Defined results: null and empty texts have no words; words and texts of any length are
read in blocks of bounded size that end between words (a longer word is a block of its
own); repeated rows and ids count each time, ids serve only to deal rows; an empty table
and languages without candidates give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstream.llm import common as C

SUPPORT = 30
LONGEST = 4
SHARDS = 3
TOP = 2000
COVERED = 80                     # per cent of a phrase's count that a longer one must reach
SCALE = 2_000_000
BLOCK = 2 << 20                  # bytes of text in work at once
LEAST_BITS, MOST_BITS = 20, 28   # powers of two; 2**28 bits are 32 MB
CHUNK_BITS = 20
HELD = 1 << 17                   # rows of local sums held by a task
SALTS = 64                       # parts in which a language's phrases are ranked first

# Bytes that end a piece, and bytes that end a word inside it.
_CUTS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_BLACK = ~(_CUTS | np.isin(np.arange(256), list(b" \t")))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Words:
    """The words of a run of texts: exact ids, hashes, pieces and texts they are in.
    ``fresh`` is the first word not counted with the block before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fresh_byte: int = 0):
        import pyarrow as pa
        import xxhash
        black = _BLACK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], black[:-1]])
        after = np.concatenate([black[1:], [False]])
        self.starts = np.flatnonzero(black & (~before | edge[:-1]))
        ends = np.flatnonzero(black & (~after | edge[1:])) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        cuts = np.concatenate([[0], np.cumsum(_CUTS[data])])[self.starts]
        new = np.ones(len(self.starts), bool)
        new[1:] = (cuts[1:] != cuts[:-1]) | (self.text[1:] != self.text[:-1])
        self.piece = np.cumsum(new)
        self.fresh = int(np.searchsorted(self.starts, fresh_byte))
        bounds = np.concatenate([[0], np.cumsum(ends - self.starts)])
        letters = _FOLD[data[black]]
        column = pa.Array.from_buffers(pa.large_binary(), len(self.starts),
                                       [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        self.ids = column.indices.to_numpy().astype(np.int64)
        self.vocabulary = column.dictionary
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64,
                                  len(self.vocabulary))[self.ids]

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words of one piece that end in a fresh word."""
        at = np.arange(max(0, self.fresh - n + 1), len(self.ids) - n + 1)
        return at[self.piece[at] == self.piece[at + n - 1]]

    def longer(self, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words that start at ``at``, from those of their
        first ``n - 1`` words (of none: the hash of each run's language)."""
        return C.mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[at + n - 1])

    def pairs(self, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.longer(self.longer(salt, at, 1), at, 2)


def word_runs(data: np.ndarray, offsets: np.ndarray, most: int, carry: int = LONGEST - 1):
    """(first text, Words) of blocks of consecutive texts.  A text above ``most`` bytes
    is cut between words; each later block of it starts ``carry`` words early."""
    for i, j in C.spans(offsets, most):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= most:
            yield i, Words(data[lo:hi], offsets[i:j + 1] - lo)
            continue
        at, fresh = lo, lo
        while fresh < hi:
            end = min(hi, fresh + most)
            while end < hi and _BLACK[data[end]]:
                step = _BLACK[data[end:min(hi, end + most)]]
                end += int(np.argmin(step)) if not step.all() else len(step)
            words = Words(data[at:end], np.array([0, end - at]), fresh - at)
            yield i, words
            kept = words.starts[-carry:] if carry else words.starts[:0]
            at, fresh = (at + int(kept[0]) if len(kept) else end), end


def _languages(column) -> tuple[np.ndarray, np.ndarray, list]:
    """Code and hash of each row's language, and the languages by code."""
    import xxhash
    names = column.to_pylist()
    known = sorted(set(names))
    code = {x: i for i, x in enumerate(known)}
    codes = np.array([code[x] for x in names], np.int64)
    return codes, np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in known], np.uint64)[codes], known


class BitTable:
    """Set of 64-bit hashes as bits at their low ends; may hold more than it was given."""

    def __init__(self, power: int, words: np.ndarray):
        self.mask, self.words = np.uint64((1 << power) - 1), words

    def held(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(hashes: DataFrame) -> BitTable:
    """Bit table of column ``h``, built by chunks on the executors; its size, at most
    ``2 ** MOST_BITS`` bits, bounds what is collected and broadcast."""
    n = hashes.count()
    power = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(32 * max(1, n))))))

    def fill(key, rows):
        import pyarrow as pa
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[rows.column("at").to_numpy() & ((1 << CHUNK_BITS) - 1)] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    places = hashes.select(F.col("h").bitwiseAND(F.lit((1 << power) - 1)).alias("at")).distinct()
    chunks = places.withColumn("chunk", F.expr(f"at >> {CHUNK_BITS}")).groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")
    words = np.zeros(1 << (power - 3), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    table = chunks.toArrow()                       # at most 2**(MOST_BITS - CHUNK_BITS) rows
    for chunk, bits in zip(table.column("chunk").to_pylist(), table.column("bits").to_pylist()):
        words[chunk * size:(chunk + 1) * size] = np.frombuffer(bits, np.uint8)
    return BitTable(power, words)


def _shard_salt(shard: np.ndarray) -> np.ndarray:
    return C.mix(shard.astype(np.uint64) + np.uint64(1))


class _Tally:
    """Counts of (shard, hash) of a task, put out when ``most`` are held."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.size, self.parts = most, 0, []

    def add(self, shard: np.ndarray, h: np.ndarray) -> None:
        self.parts.append((shard, h))
        self.size += len(h)

    def out(self):
        import pyarrow as pa
        shard, h = (np.concatenate(x) for x in zip(*self.parts))
        self.size, self.parts = 0, []
        for s in np.unique(shard):
            held, count = np.unique(h[shard == s], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), s, np.int8)), pa.array(held.view(np.int64)),
                                              pa.array(count.astype(np.int64))], names=["shard", "h", "n"])


def _mining(block: int, inside=None):
    """Local counts of pairs or, with ``inside`` (broadcast bit table), of longer runs
    all of whose pairs are frequent in the shard."""
    def run(batches):
        tally = _Tally()
        for batch in batches:
            data, offsets = C.string_buffers(batch.column(0))
            _, salts, _ = _languages(batch.column(1))
            shards = batch.column(2).to_numpy().astype(np.int8)
            for first, words in word_runs(data, offsets, block):
                where = words.text + first
                if inside is None:
                    at = words.runs(2)
                    tally.add(shards[where[at]], words.pairs(at, salts[where[at]]))
                else:
                    at = np.arange(max(0, len(words.ids) - 1))
                    h = words.pairs(at, salts[where[at]])
                    good = np.zeros(len(words.ids), bool)
                    good[at] = inside.value.held(C.mix(h ^ _shard_salt(shards[where[at]])))
                    for n in range(3, LONGEST + 1):
                        fine = at + n <= len(words.ids)
                        at, h = at[fine], h[fine]
                        fine = good[at] & good[at + n - 2] & (words.piece[at] == words.piece[at + n - 1])
                        at, h = at[fine], words.longer(h[fine], at[fine], n)
                        new = at + n > words.fresh
                        tally.add(shards[where[at[new]]], h[new])
                if tally.size > tally.most:
                    yield from tally.out()
        if tally.parts:
            yield from tally.out()
        C.give_back()
    return run


def _spelled(words: Words, at: np.ndarray, n: int, where: np.ndarray, codes: np.ndarray, known: list):
    """Table of the distinct runs of ``n`` words that start at ``at``, with counts."""
    import pyarrow as pa
    import pyarrow.compute as pc
    key = codes[where[at]]
    for j in range(n):                             # equal keys: same language and same words
        _, some, key = np.unique(key * len(words.vocabulary) + words.ids[at + j], return_index=True, return_inverse=True)
    some = at[some]
    parts = [words.vocabulary.take(pa.array(words.ids[some + j])).cast(pa.large_string()) for j in range(n)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
    lang = pa.array(known, pa.large_string()).take(pa.array(codes[where[some]]))
    return pa.table({"lang": lang.cast(pa.string()), "phrase": phrase.cast(pa.string()), "n": pa.array(np.bincount(key).astype(np.int64))})


def _counting(block: int, inside, most: int):
    """Local counts of words and of the united phrases, spelled out; sums are put out
    when they are still more than ``2 * most`` rows."""
    def run(batches):
        import pyarrow as pa

        def out(tables):
            whole = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            return whole.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

        held, size, floor = [], 0, most
        for batch in batches:
            data, offsets = C.string_buffers(batch.column(0))
            codes, salts, known = _languages(batch.column(1))
            for first, words in word_runs(data, offsets, block):
                where = words.text + first
                at = np.arange(len(words.ids))
                h = words.longer(salts[where[at]], at, 1)
                for n in range(1, LONGEST + 1):
                    if n > 1:
                        fine = at + n <= len(words.ids)
                        at, h = at[fine], h[fine]
                        fine = words.piece[at] == words.piece[at + n - 1]
                        at, h = at[fine], words.longer(h[fine], at[fine], n)
                        found = inside.value.held(h)
                        at, h = at[found], h[found]    # a run is united only if its first words are
                    new = at[at + n > words.fresh]
                    if len(new):
                        held.append(_spelled(words, new, n, where, codes, known))
                        size += held[-1].num_rows
                if size > floor:
                    held = [out(held)]
                    size = held[0].num_rows
                    floor = max(most, 2 * size)
                    if size > 2 * most:
                        yield from held[0].to_batches()
                        held, size, floor = [], 0, most
        if held:
            yield from out(held).to_batches()
        C.give_back()
    return run


def phrase_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``f``: exact counts of all words and of the phrases
    of two to four words that occur at least ``support`` times in their language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(shards)).cast("byte").alias("shard"))
    local = -(-support // shards)

    def frequent(counts: DataFrame, what: str) -> DataFrame:
        return C.stored(spark, counts.groupBy("shard", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= local)
                        .select("shard", "h"), what)

    schema = "shard byte, h long, n long"
    pairs = frequent(rows.mapInArrow(_mining(BLOCK), schema), "phrase-pairs")
    of_shard = spark.sparkContext.broadcast(bit_table(pairs.mapInArrow(_sharded, "h long")))
    longer = frequent(rows.mapInArrow(_mining(BLOCK, of_shard), schema), "phrase-runs")
    united = spark.sparkContext.broadcast(bit_table(pairs.unionAll(longer).select("h").distinct()))
    return (rows.select("text", "lang").mapInArrow(_counting(BLOCK, united, HELD), "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
            .select("lang", F.size(F.split("phrase", " ")).alias("size"), "phrase", "f")
            .filter((F.col("size") == 1) | (F.col("f") >= support)))


def _sharded(batches):
    import pyarrow as pa
    for batch in batches:
        h = C.mix(batch.column(1).to_numpy().view(np.uint64) ^ _shard_salt(batch.column(0).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _joined(words, a, b):
    return F.array_join(F.slice(words, F.lit(a), F.lit(b - a)), " ")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 support: int = SUPPORT, top: int = TOP, covered: int = COVERED, shards: int = SHARDS) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``,
    ``r``, ``n``, ``score``."""
    spark = docs.sparkSession
    counts = C.stored(spark, phrase_counts(docs, id_col, text_col, lang_col, support, shards), "phrase-counts")
    totals = counts.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = counts.filter((F.col("size") < LONGEST) & (F.col("f") >= support)).select("lang", F.col("phrase").alias("part"), "f")
    words = F.split("phrase", " ")
    candidates = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"),
                                                  words.alias("words"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k") + 1).alias("head"),
                     _joined(F.col("words"), F.col("k") + 1, F.col("size") + 1).alias("tail"))
    scored = (cut.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
              .withColumn("score", F.expr(f"CAST((CAST({SCALE} AS DECIMAL(38,0)) * a) DIV (CAST(l AS DECIMAL(38,0)) + r) AS LONG)")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select(
        "lang", "phrase", "a", "m.l", "m.r", "m.score")
    spans = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    within = F.filter(F.array(*[F.when((F.col("size") > n) & (F.col("size") >= i + n - 1), _joined(F.col("words"), i, i + n))
                                for i, n in spans]), lambda x: x.isNotNull())
    covers = (candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(within)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    free = weakest.join(covers, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | F.expr(f"CAST(100 AS DECIMAL(38,0)) * most < CAST({covered} AS DECIMAL(38,0)) * a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    first = (free.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(some))
             .filter(F.col("place") <= top))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
