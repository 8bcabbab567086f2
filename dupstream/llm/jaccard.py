"""N-gram Jaccard self-join by multiple-global-order filtering.

A document's set holds the hashes of its distinct ``n``-word shingles (A-Z folded).
Under any global order of the shingles, two sets ``x`` and ``y`` of Jaccard similarity
``t`` or more share at least ``l`` shingles among the first ``|x| - ceil(t |x|) + l``
and ``|y| - ceil(t |y|) + l`` of each.  Every order used here puts frequent shingles
last (classes from one lossy count over all documents, at most ``HEAVY`` shingles) and
differs in the hash that ranks the rest.

1. Prefixes under the first order are exchanged as packed arrays; what stays are the
   shingles that two documents share.  Packed once more by document, they show which
   documents share at least ``l`` with others at all; only those stay candidates.
   Frequent shingles are known to be shared and are never gathered by shingle.
2. *Stars.*  Candidates that have the same first shingle under one of ``STARS`` orders
   meet; each is paired with the member that shares most with others, or a drawn one
   where that is in its component already, at most ``PARTNERS`` pairs a document and
   round, pairs that agree under half of the orders first, and compared whole.  A group of near copies thus costs links in proportion to its size.
   The links give components; a few rounds draw anew.
3. *The rest, exactly.*  For prefix shingles that still join different components all
   pairs across components become candidates, if the places of the shingle in both
   orders leave room for enough common shingles behind it.  They must also share ``l``
   prefix shingles under every further order; the whole sets are fetched for what is left.
Links inside a component change nothing, so components are those of the full join.

Defined results: null or blank texts have an empty set and link with nothing; texts
of fewer than ``n`` words have their whole sequence as one shingle; rows with a null
id are left out; rows that repeat an id stand for it together (it links if any of
them does) and each is returned with its own set size; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupstream.llm import common as C
from dupstream.llm.components import components, merged

SHINGLE = 5
PERCENT = 75
ORDERS = 3                    # global orders: the first finds candidates, the others filter them
STARS = 12                    # orders whose first shingle draws the star pairs
STAR_ROUNDS = 2
HEAVY = 1 << 18               # frequent shingles with an own place in the orders: 2.25 MB broadcast
PARTNERS = 2
WIDE, NARROW = 15, 2          # percent of a set's size that prefixes are longer than the shortest possible
CHUNK_BYTES = 2 << 20
SHARD_BYTES = 64 << 20
SMALL_IDS = 4_000_000         # candidate ids up to this many (32 MB) are broadcast, more are joined by shuffle
LOST = 2                      # distinct shingles of one set that may share 32 bits
_SEEDS = np.random.default_rng(75).integers(1, 1 << 63, 8 + STARS, dtype=np.uint64)


def prefix_length(size: int, percent: int = PERCENT, share: int = 0) -> int:
    """Shortest prefix in which similar sets share one shingle; with ``share`` in
    percent, the prefix in which they share ``least_shared``."""
    return size + (-percent * size // 100) + 1 + size * share // 100 if size else 0


def least_shared(size, share: int):
    """Shingles that two sets, the smaller of ``size``, share in such prefixes."""
    return 1 + size * share // 100


def _sets(column, n: int):
    """Sorted distinct shingle hashes of every text."""
    data, offsets = C.string_buffers(column)
    for i, j in C.spans(offsets, CHUNK_BYTES):
        words, first = C.word_hashes(data, offsets[i:j + 1], fold_case=True)
        runs = C.grams(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(runs[a:b - n + 1])
            elif b > a:
                yield C.mix(C.grams(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


class Order:
    """Places of shingles: frequency class first, then a hash of the order's own."""

    def __init__(self, heavy: np.ndarray, classes: np.ndarray):
        self.heavy, self.classes = heavy, classes

    def of(self, tokens: np.ndarray):
        if not len(self.heavy):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.heavy, tokens), len(self.heavy) - 1)
        return np.where(self.heavy[at] == tokens, self.classes[at], 0).astype(np.uint64)

    def prefix(self, tokens: np.ndarray, classes: np.ndarray, order: int, length: int) -> np.ndarray:
        """Positions of the first ``length`` tokens; ties go by token, as tokens
        are sorted."""
        place = (classes << np.uint64(56)) | (C.mix(tokens ^ _SEEDS[order]) >> np.uint64(8))
        return np.argsort(place, kind="stable")[:length]


def _heavy(n: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            parts, size = [], 0
            for s in _sets(batch.column("text"), n):
                parts.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield _counted(pa, parts)
                    parts, size = [], 0
            if size:
                yield _counted(pa, parts)

    def _counted(pa, parts):
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        again = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[again].view(np.int64)), pa.array(counts[again], pa.int64())],
                                          names=["token", "n"])
    return run


def heavy_shingles(docs: DataFrame, n: int, most: int = HEAVY) -> Order:
    """The most frequent shingles.  Counts are summed over pieces of the input in
    which a shingle occurs more than once, so rare ones are left out early; they only
    set the orders, never a result."""
    counted = (docs.select("text").mapInArrow(C.tidy("jaccard", _heavy(n)), "token long, n long")
               .groupBy("token").agg(F.sum("n").alias("n")).filter("n > 3")
               .orderBy(F.desc("n"), "token").limit(most))
    rows = counted.toArrow()                               # at most ``most`` pairs of longs
    tokens = rows.column("token").to_numpy().view(np.uint64)
    classes = np.minimum(255, 1 + np.floor(4 * np.log2(rows.column("n").to_numpy().astype(float)))).astype(np.uint8) \
        if len(tokens) else np.zeros(0, np.uint8)
    order = np.argsort(tokens)
    return Order(tokens[order], classes[order])


PACKED, DOCUMENT, COPY = 0, 1, 2
ROWS = "kind int, token long, doc long, n int, shard int, tokens binary, docs binary, sizes binary, places binary"


def _pack_rows(key: int, kind: int, tokens, docs, sizes, places, narrow: bool):
    """One exchange row; a token shard's tokens agree in bits of their own and 32
    more tell them apart (a false match is only a candidate)."""
    return {"shard": key, "kind": kind, "n": len(tokens), "tokens": (tokens.astype(np.uint32) if narrow else tokens).tobytes(),
            "docs": C.pack(docs), "sizes": C.pack(sizes), "places": C.pack(places)}


def _batch(rows, columns):
    import pyarrow as pa
    kinds = {"tokens": pa.binary(), "docs": pa.binary(), "sizes": pa.binary(), "places": pa.binary(),
             "token": pa.int64(), "doc": pa.int64()}
    return {c: pa.array([r.get(c) for r in rows], kinds.get(c, pa.int32())) for c in columns}


def _by(keys: np.ndarray, shards: int):
    """Order by shard, and (shard, from, to) of each shard that has any."""
    shard = ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return order, [(k, x, y) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if x < y]


EXCHANGE = ("shard", "kind", "n", "tokens", "docs", "sizes", "places")


def _prefixes(orders, n: int, percent: int, shards: int):
    """Packed first-order prefixes by shard, and what needs no exchange partner:
    postings of frequent shingles, set sizes, equal sets of a chunk."""
    def run(batches):
        import pyarrow as pa
        order = orders.value
        for batch in batches:
            seen: dict[int, tuple] = {}
            held = _Held()
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), _sets(batch.column("text"), n)):
                held.own.append((doc, len(tokens)))
                if not len(tokens):
                    continue
                whole = tokens.tobytes()
                first = seen.setdefault(hash(whole), (doc, whole))
                if first[0] != doc and first[1] == whole:
                    held.copies.append((first[0], doc))
                    continue
                classes = order.of(tokens)
                take = order.prefix(tokens, classes, 0, prefix_length(len(tokens), percent, WIDE))
                held.tokens.append(tokens[take])
                held.heavy.append(classes[take] > 0)
                # places in 256ths of the set's size, rounded down
                held.places.append((np.arange(len(take)) * 256 // len(tokens)).astype(np.uint8))
                held.docs.append(np.full(len(take), doc))
                held.sizes.append(np.full(len(take), len(tokens), np.int32))
                held.size += len(take)
                if held.size > 500_000:
                    yield pa.RecordBatch.from_pydict(_batch(held.rows(shards), EXCHANGE))
                    held = _Held()
            yield pa.RecordBatch.from_pydict(_batch(held.rows(shards), EXCHANGE))
    return run


class _Held:
    """What a chunk of documents gives out."""

    def __init__(self):
        self.own, self.copies = [], []
        self.tokens, self.heavy, self.places, self.docs, self.sizes, self.size = [], [], [], [], [], 0

    def rows(self, shards: int) -> list[dict]:
        if not self.own:
            return []
        spread = shards + self.own[0][0] % shards          # passed on as it is by one of as many further keys
        def none(rows): return np.zeros(len(rows), np.uint8)
        docs, sizes = (np.array(x, t) for x, t in zip(zip(*self.own), (np.int64, np.int32)))
        out = [_pack_rows(spread, DOCUMENT, np.zeros(len(docs), np.uint64), docs, sizes, none(docs), False)]
        if self.copies:
            of, docs = (np.array(x, np.int64) for x in zip(*self.copies))
            out.append(_pack_rows(spread, COPY, of.view(np.uint64), docs, np.zeros(len(docs), np.int32), none(docs), False))
        if self.tokens:
            t, d, s, h, f = (np.concatenate(x) for x in (self.tokens, self.docs, self.sizes, self.heavy, self.places))
            if h.any():
                out.append(_pack_rows(spread, PACKED, t[h], d[h], s[h], f[h], False))
            t, d, s, f = t[~h], d[~h], s[~h], f[~h]
            by, parts = _by(t, shards)
            t, d, s, f = t[by], d[by], s[by], f[by]
            out += [_pack_rows(k, PACKED, t[x:y], d[x:y], s[x:y], f[x:y], True) for k, x, y in parts]
        return out


def _unpack(table, narrow: bool):
    """Tokens, documents, sizes and places of exchange rows, joined."""
    ns = table.column("n").to_pylist()
    def join(parts, dtype): return np.concatenate([np.zeros(0, dtype), *parts])
    tokens = join([np.frombuffer(b, np.uint32 if narrow else np.uint64).astype(np.uint64)
                   for b in table.column("tokens").to_pylist()], np.uint64)
    docs = join([C.unpack(b, k, np.int64) for b, k in zip(table.column("docs").to_pylist(), ns)], np.int64)
    sizes = join([C.unpack(b, k, np.int32) for b, k in zip(table.column("sizes").to_pylist(), ns)], np.int32)
    places = join([C.unpack(b, k, np.uint8) for b, k in zip(table.column("places").to_pylist(), ns)], np.uint8)
    return tokens, docs, sizes, places


def _shared(shards: int):
    """Of a token shard, the postings of shingles that two documents have, packed
    by document shard; other kinds as plain rows."""
    def run(key, table):
        import pyarrow as pa
        shard = key[0].as_py()
        kinds = table.column("kind").to_numpy()
        out = []
        packed = table.filter(pa.array(kinds == PACKED))
        if packed.num_rows:
            tokens, docs, sizes, first = _unpack(packed, shard < shards)
            if shard < shards:
                order = np.argsort(tokens, kind="stable")
                same = tokens[order][1:] == tokens[order][:-1]
                keep = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
                tokens, docs, sizes, first = tokens[keep], docs[keep], sizes[keep], first[keep]
                tokens = C.mix(tokens ^ (np.uint64(shard + 1) << np.uint64(32)))
            by, parts = _by(C.mix(docs.view(np.uint64)), shards)
            tokens, docs, sizes, first = tokens[by], docs[by], sizes[by], first[by]
            out = [_pack_rows(k, PACKED, tokens[x:y], docs[x:y], sizes[x:y], first[x:y], False) for k, x, y in parts]
        tables = [pa.table(_batch(out, ("kind", "token", "doc", "n", "shard", "tokens", "docs", "sizes", "places")))]
        for kind in (DOCUMENT, COPY):
            rows = table.filter(pa.array(kinds == kind))
            if rows.num_rows:
                tokens, docs, sizes, _ = _unpack(rows, False)
                none = pa.nulls(len(docs), pa.binary())
                tables.append(pa.table([pa.array(np.full(len(docs), kind, np.int32)), pa.array(tokens.view(np.int64)),
                                        pa.array(docs), pa.array(sizes), pa.array(np.zeros(len(docs), np.int32)),
                                        none, none, none, none], names=tables[0].schema.names))
        return pa.concat_tables(tables)
    return run


def _candidates(percent: int):
    """Of a document shard, postings within the shortest prefix of the documents
    that share enough with others to have a similar set at all; ``at`` is a lower bound
    of the shingle's place, ``common`` how much the document shares (per mille)."""
    def run(key, table):
        import pyarrow as pa
        tokens, docs, sizes, places = _unpack(table, False)
        _, one, counts = np.unique(docs, return_inverse=True, return_counts=True)
        n = sizes.astype(np.int64)
        smallest = -(-n * percent // 100)
        at = places.astype(np.int64) * n // 256
        keep = (at <= n - smallest) & (counts[one] >= least_shared(smallest, WIDE))
        return pa.table({"token": pa.array(tokens[keep].view(np.int64)), "doc": pa.array(docs[keep]),
                         "n": pa.array(sizes[keep]), "at": pa.array(at[keep].astype(np.int32)),
                         "common": pa.array((1000 * counts[one] // n)[keep].astype(np.int32))})
    return run


SETS = "doc long, n int, tokens binary, prefixes array<binary>, stars array<long>"


def _whole_sets(orders, n: int, percent: int):
    """Whole sets of candidate documents, with their prefixes under the filtering
    orders and their first shingles under the star orders."""
    def run(batches):
        import pyarrow as pa
        order = orders.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc, tokens in zip(ids, _sets(batch.column("text"), n)):
                if not len(tokens):
                    continue
                classes, length = order.of(tokens), prefix_length(len(tokens), percent, NARROW)
                prefixes = [np.unique(tokens[order.prefix(tokens, classes, k, length)].astype(np.uint32)).tobytes()
                            for k in range(1, ORDERS)]
                # plain hash orders: near copies agree in the first shingle as often as they agree at all
                heads = [tokens[np.argmin(C.mix(tokens ^ _SEEDS[8 + k]))] for k in range(STARS)]
                out.append((doc, len(tokens), tokens.tobytes(), prefixes, np.array(heads).view(np.int64)))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()),
                pa.array(columns[3], pa.list_(pa.binary())), pa.array(columns[4], pa.list_(pa.int64()))],
                names=["doc", "n", "tokens", "prefixes", "stars"])
    return run


def _kept_pairs(test):
    """Pairs (a, b) whose two sides pass ``test``; the sides are read in place."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            xa, xb = batch.column("xa"), batch.column("xb")
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            keep = [test(xa[i], xb[i], *n) for i, n in enumerate(sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _share_prefixes(x, y, n_x: int, n_y: int) -> bool:
    # equal 32-bit values of different shingles can only add to the count, but for those lost within one set
    least = least_shared(min(n_x, n_y), NARROW) - LOST
    return all(_meet(np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(q.as_buffer(), np.uint32)) >= max(1, least)
               for p, q in zip(x, y))


def _passing_pairs(percent: int):
    """Pairs (a, b) that share enough of their prefixes under every further order and
    whose whole sets are similar."""
    similar = _similar(percent)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            xa, xb, pa_, pb_ = (batch.column(c) for c in ("xa", "xb", "pa", "pb"))
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist())
            keep = [_share_prefixes(pa_[i], pb_[i], *n) and similar(xa[i], xb[i], *n) for i, n in enumerate(sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _similar(percent: int):
    def test(x, y, n_x, n_y):
        common = _meet(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
        return 100 * common >= percent * (n_x + n_y - common)
    return test


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, filtered: bool, small_ids: int) -> DataFrame:
    """Links among stored candidate pairs: filtered by every further order if asked
    for, then compared whole.  Only sets that some pair needs are moved."""
    spark = pairs.sparkSession
    needed = C.stored(spark, pairs.select(F.col("a").alias("doc")).unionAll(pairs.select("b")).distinct(), "needed")
    moved = sets.select("doc", "n", "tokens", *(["prefixes"] if filtered else [])).join(
        F.broadcast(needed) if needed.count() <= small_ids else needed, "doc", "left_semi")
    for side in ("a", "b"):
        more = [F.col("prefixes").alias(f"p{side}")] if filtered else []
        pairs = pairs.join(moved.select(F.col("doc").alias(side), F.col("tokens").alias(f"x{side}"),
                                        F.col("n").alias(f"n{side}"), *more), side)
    if filtered:
        return pairs.select("a", "b", "xa", "xb", "na", "nb", "pa", "pb").mapInArrow(
            _passing_pairs(percent), "a long, b long")
    return pairs.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(_kept_pairs(_similar(percent)), "a long, b long")


def _star_pairs(stars: DataFrame, turn: int, percent: int, partners: int) -> DataFrame:
    """At most ``partners`` pairs per document, each with the first or last member
    of a star group, in an order drawn anew each turn, that is in another component.
    Pairs agree under at least half of the star orders (a likely pair; what is left
    out here is met again in the exact step)."""
    spark = stars.sparkSession
    by_order = stars.select("doc", "n", "common", "component", "stars", F.posexplode("stars").alias("k", "token"))
    who = (F.col("component"), F.col("doc"), F.col("n"), F.col("stars"))
    first = F.struct(-F.col("common"), F.xxhash64("doc", F.lit(turn)), *who)
    drawn = F.struct(F.xxhash64("component", F.lit(turn)), F.xxhash64("doc", "token", F.lit(turn)), *who)
    ends = C.stored(spark, by_order.groupBy("k", "token").agg(F.min(first).alias("lo"), F.max(drawn).alias("hi"),
                                                              F.min("component").alias("c0"), F.max("component").alias("c1"))
                    .filter("c0 != c1"), "ends")
    pairs = by_order.join(ends, ["k", "token"])
    met = None
    for end in ("lo", "hi"):
        one = pairs.filter(F.col(f"{end}.component") != F.col("component")).select(
            "doc", "n", "stars", F.col(f"{end}.doc").alias("partner"), F.col(f"{end}.n").alias("m"), F.col(f"{end}.stars").alias("t"))
        met = one if met is None else met.unionAll(one)
    agreed = F.aggregate(F.zip_with("stars", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = (met.filter(_sizes_fit(F.col("n"), F.col("m"), percent)).withColumn("agreed", agreed)
           .filter(F.col("agreed") * 2 >= STARS).select("doc", "partner", "agreed").distinct())
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("agreed"), "partner"))
    return (met.withColumn("rank", rank).filter(F.col("rank") <= partners)
            .select(F.least("doc", "partner").alias("a"), F.greatest("doc", "partner").alias("b")).distinct())


def _sizes_fit(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, heavy: int = HEAVY,
                    partners: int = PARTNERS, small_ids: int = SMALL_IDS) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id
    reachable over links of similarity ``percent`` / 100 or more)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    shards = max(16, -(-C.text_bytes(rows) // SHARD_BYTES))
    # at most ``heavy`` shingles of 9 bytes
    orders = spark.sparkContext.broadcast(heavy_shingles(rows, n, heavy))
    table = C.stored(spark, rows.mapInArrow(
        C.tidy("jaccard", _prefixes(orders, n, percent, shards)),
        "shard int, kind int, n int, tokens binary, docs binary, sizes binary, places binary")
        .groupBy("shard").applyInArrow(_shared(shards), ROWS), "shared")
    own, copies = (table.filter(F.col("kind") == k).select("token", "doc", "n") for k in (DOCUMENT, COPY))
    postings = C.stored(spark, table.filter(F.col("kind") == PACKED)
                        .select("shard", "n", "tokens", "docs", "sizes", "places").groupBy("shard")
                        .applyInArrow(_candidates(percent), "token long, doc long, n int, at int, common int"), "postings")
    candidates = C.stored(spark, postings.groupBy(F.col("doc").alias("doc_id")).agg(F.max("common").alias("common")), "candidates")
    common, candidates = candidates.withColumnRenamed("doc_id", "doc"), candidates.select("doc_id")
    few = candidates.count() <= small_ids
    sets = C.stored(spark, rows.join(F.broadcast(candidates) if few else candidates, "doc_id", "left_semi")
                    .mapInArrow(C.tidy("jaccard", _whole_sets(orders, n, percent)), SETS), "sets")
    links = copies.select(F.col("token").alias("a"), F.col("doc").alias("b"))
    labels = spark.createDataFrame([], "node long, component long")
    # later links join components that are there: those alone are walked again
    for turn in range(STAR_ROUNDS):
        stars = (sets.select("doc", "n", "stars").join(common, "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
                 .withColumn("component", F.coalesce("component", "doc")))
        pairs = C.stored(spark, _star_pairs(stars, turn, percent, partners), "stars")
        if turn and not pairs.limit(1).count():
            break
        found = C.stored(spark, _verified(pairs, sets, percent, False, small_ids), "found")
        labels = merged(labels, found) if turn else components(links.unionAll(found))
    pairs = C.stored(spark, _all_pairs(_across(postings, labels), percent), "pairs")
    if pairs.limit(1).count():
        found = C.stored(spark, _verified(pairs, sets, percent, True, small_ids), "found")
        labels = merged(labels, found)
    return (own.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
            .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, small_ids: int = SMALL_IDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component
    those of the smallest id.  Rows without an id stay."""
    found = near_duplicates(docs, n, percent, small_ids=small_ids)
    gone = C.stored(docs.sparkSession, found.filter("component_id != doc_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= small_ids else gone, "doc_id", "left_anti").select(*docs.columns)


def _across(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of shingles that still join different components."""
    spark = postings.sparkSession
    now = C.stored(spark, postings.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
                   .select("token", "doc", "n", "at", F.coalesce("component", "doc").alias("component")), "listed")
    mixed = C.stored(spark, now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                     .filter("lo != hi").select("token"), "mixed")
    return now.join(mixed, "token", "left_semi")


def _all_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """All pairs across components that share a listed shingle and fit in size."""
    x = listed.select("token", *(F.col(c).alias(f"{c}_a") for c in ("doc", "n", "at", "component")))
    y = listed.select("token", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "at", "component")))
    # similar sets have t / (1 + t) of their sizes' sum in common, and at their first common shingle all of that
    # is still to come; at later ones the test only fails more often
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (100 + percent) \
        >= (F.col("n_a") + F.col("n_b")) * percent
    return (x.join(y, "token").filter((F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b"))
                                      & _sizes_fit(F.col("n_a"), F.col("n_b"), percent) & room)
            .select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct())
