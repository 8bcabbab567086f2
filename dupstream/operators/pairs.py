"""Near- and exact-duplicate pair tables (JN1-JN4, JN13, PRJ3, SET2).

Near duplicates are a theta self-join: bits window + three Hamming bounds.
Written directly it has no equality key and plans as a nested loop.  The
join here is lossless and equi-keyed:

* **Copies collapse first.**  Images with identical fingerprints form one
  class, represented by its smallest id (the *root*).  Only roots enter the
  similarity join, so a group of copies (however large) costs one row, and
  the pair table holds one edge per copy (copy -> root, distance 0) instead
  of every pair inside the group.  A pair (x, y) is near iff
  ``root(x) = root(y)`` or ``(root(x), root(y))`` is a stored root edge.
* **Pigeonhole bands.**  ``diff_a <= k`` over the aHash words means at most
  k of any k+1 disjoint aHash bands differ, so at least one band is equal; of the eight
  halves a join that stores no bands takes the k+1 with the fewest rows in hot keys.
  Both sides are exploded to (band_no, 32-bit band) and equi-joined on it;
  a pair is kept only at the *first* equal band, so no ``distinct`` shuffle
  is needed.
* **Second level.**  A band key with more than ``split_rows`` index rows
  would compare all of them with each other.  Only the rows of such keys
  get a second pigeonhole: ``diff_dh <= k`` means one of ``k+1`` disjoint dHash
  bands is equal too, so the key gains (dHash band, value), and a pair is kept at
  its first equal one.  Rows of a hot key meet only where both hashes agree.
* **Bits bucket.**  ``|bits_a - bits_b| <= w`` implies the buckets
  ``bits div (w+1)`` differ by at most one.  Only the rows of keys that still hold
  more than ``BUCKET_ROWS`` index rows (blank images) get the bucket as a third
  level; there the left side is replicated to its own bucket and its neighbours (in a
  self join the next one, pairs in one bucket being taken once by ``a < b``).  All other
  rows cross the shuffle once per band, and the two sides of a self join are then
  the same rows: one exchange serves both.
* **Salting.**  Band keys still holding more than ``salt_rows`` rows on the
  index side are spread over several tasks: index rows take a salt from a
  hash of their id, query rows are replicated over the key's salts.  A refined
  key holds no more rows than its first-level key, so this step looks for keys
  only where the first level has any.  Hot keys of either level are found on a
  sample; their list is broadcast only below ``broadcast_rows`` entries.  AQE skew-join splitting stays on as a second
  line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupstream.session import prepare, stored
from dupstream.operators.skew import HOT_ROWS, join_back
from dupstream.schemas import AHASH, DHASH_H, DHASH_V, WORDS

# ---- fixed values (thresholds of the reference) --------------------------
STORE_MAX_A, STORE_MAX_DH, STORE_MAX_DV = 5, 8, 8     # pair is stored
RETURN_MAX_A, RETURN_MAX_D = 3, 10                    # pair is reported
INGEST_BITS_WINDOW = 22                               # inclusive
LOOKUP_MAX_A, LOOKUP_MAX_DH, LOOKUP_MAX_DV = 3, 5, 5  # ad-hoc lookup
LOOKUP_BITS_WINDOW = 20                               # exclusive
# --------------------------------------------------------------------------

MAX_BANDS = 8                 # 32-bit halves of the four aHash words
DEFAULT_SALT_ROWS = 200_000   # rows per band key before it is salted
DEFAULT_SPLIT_ROWS = 64       # rows per band key before it is split by a second hash
DEFAULT_BROADCAST_ROWS = 2_000_000
BUCKET_ROWS = 1024            # rows per (refined) band key before the bits bucket joins it


@dataclass(frozen=True)
class Thresholds:
    max_a: int = STORE_MAX_A
    max_dh: int = STORE_MAX_DH
    max_dv: int = STORE_MAX_DV
    window: int | None = INGEST_BITS_WINDOW   # None: no bits prefilter
    inclusive: bool = True
    max_d: int | None = None                  # bound on diff_dh + diff_dv

    @property
    def max_delta(self) -> int | None:
        """Largest |bits difference| the window admits."""
        if self.window is None:
            return None
        return self.window if self.inclusive else self.window - 1


STORE = Thresholds()
LOOKUP = Thresholds(LOOKUP_MAX_A, LOOKUP_MAX_DH, LOOKUP_MAX_DV, LOOKUP_BITS_WINDOW, False)
# aHash <= 3 and combined dHash <= 10, no bits prefilter (FLT8).
COMBINED = Thresholds(RETURN_MAX_A, RETURN_MAX_D, RETURN_MAX_D, None, True, RETURN_MAX_D)


# The wide predicates are written as SQL text: one parsed expression each instead of
# hundreds of Column calls.

def _halves(words, prefix: str = "") -> list[str]:
    """Upper 32-bit halves of the words, then the lower ones."""
    p = f"{prefix}." if prefix else ""
    return [f"shiftrightunsigned({p}{w}, 32)" for w in words] + [f"({p}{w} & 4294967295L)" for w in words]


def _band_array(bands: list[str]) -> Column:
    return F.expr(f"array({', '.join(bands)})")


def _bucket(bits_col: str, width: int) -> Column:
    return F.floor(F.col(bits_col) / F.lit(width)).cast("int")


def _banded(df: DataFrame, bands: list[str]) -> DataFrame:
    """One row per band: band_no, band + payload."""
    return df.select("*", F.posexplode(_band_array(bands)).alias("band_no", "band"))


def _coolest_bands(index: DataFrame, n_bands: int, split_rows: int | None) -> list[int]:
    """Any ``n_bands`` of the aHash halves find every pair: those with the fewest rows of
    ``index`` in hot keys, whose rows the second level would multiply."""
    if not split_rows or n_bands == MAX_BANDS:
        return list(range(n_bands))
    hot, _, _ = _hot_keys(_banded(index.select(*AHASH), _halves(AHASH)), ["band_no", "band"], split_rows)
    heat = {r["band_no"]: r["heat"] for r in hot.groupBy("band_no").agg(F.sum("est").alias("heat")).collect()}
    return sorted(sorted(range(MAX_BANDS), key=lambda b: (heat.get(b, 0), b))[:n_bands])


def _explode_bands(df: DataFrame, n_bands: int, bits_col: str, width: int | None,
                   offsets: tuple[int, ...]) -> DataFrame:
    """One row per (band, bucket offset): band_no, band, bkt + payload."""
    bands = _band_array(_halves(AHASH)[:n_bands])
    out = df.select("*", F.posexplode(bands).alias("band_no", "band"))
    if width is None:
        return out.withColumn("bkt", F.lit(0)).withColumn("bkt_off", F.lit(0))
    bkt = _bucket(bits_col, width)
    if offsets == (0,):
        return out.withColumn("bkt", bkt).withColumn("bkt_off", F.lit(0))
    return (out.withColumn("bkt_off", F.explode(F.array(*[F.lit(o) for o in offsets])))
               .withColumn("bkt", bkt + F.col("bkt_off")))


def _first_equal(left: list[str], right: list[str], unless: str | None = None) -> Column:
    """Index of the first pair of equal expressions (``unless``: a column whose
    value is an index to pass over)."""
    skip = f" AND {unless} != {{k}}" if unless else ""
    cases = " ".join(f"WHEN {x} = {y}{skip.format(k=k)} THEN {k}" for k, (x, y) in enumerate(zip(left, right)))
    return F.expr(f"CASE {cases} END")


def _first_equal_band(bands: list[int]) -> Column:
    left, right = _halves(AHASH, "l"), _halves(AHASH, "r")
    return _first_equal([left[b] for b in bands], [right[b] for b in bands])


def word_parts(words: list[str], n: int, prefix: str = "") -> list[str]:
    """``n`` disjoint bit ranges that cover the 64-bit words, none across two."""
    if n < len(words):
        raise ValueError(f"{len(words)} words cannot be cut into {n} parts")
    out = []
    for i, w in enumerate(words):
        parts = n // len(words) + (i < n % len(words))
        cuts = [64 * k // parts for k in range(parts + 1)]
        col = f"{prefix}.{w}" if prefix else w
        out += [f"(shiftrightunsigned({col}, {lo}) & {(1 << (hi - lo)) - 1}L)" if hi - lo < 64 else col
                for lo, hi in zip(cuts, cuts[1:])]
    return out


LISTED_KEYS = 20_000    # hot keys that may come to the driver as a local list
HOT_SAMPLE_ROWS = 40    # expected sampled rows of a key right at a threshold


def _hot_keys(index: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, int, float]:
    """``(keys and est, their number, largest est)``: keys with more than about
    ``rows`` rows, from a Bernoulli sample in which a key right at the
    threshold is expected ``HOT_SAMPLE_ROWS`` times (all rows when ``rows`` is
    that small).  The list is fixed once, as a local table up to
    ``LISTED_KEYS`` keys and as a reliable checkpoint beyond: both sides must
    see the very same keys, whatever is recomputed.  A key the sample misses
    only costs time, never a pair."""
    spark = index.sparkSession
    frac = min(1.0, HOT_SAMPLE_ROWS / rows)
    sample = index.select(*keys) if frac >= 1.0 else index.select(*keys).sample(withReplacement=False, fraction=frac, seed=17)
    est = F.col("count") / F.lit(frac)
    hot = sample.groupBy(*keys).count().filter(est > rows).select(*keys, est.alias("est"))
    listed = hot.limit(LISTED_KEYS + 1).collect()
    if len(listed) <= LISTED_KEYS:
        return spark.createDataFrame(listed, hot.schema), len(listed), max((r["est"] for r in listed), default=0)
    hot = hot.checkpoint(eager=True)
    found = hot.agg(F.count(F.lit(1)).alias("n"), F.max("est").alias("most")).first()
    return hot, found["n"], found["most"]


def _split(left: DataFrame, right: DataFrame, keys: list[str], second: list[str], split_rows: int,
           broadcast_rows: int, own: str | None = None):
    """Give the rows of hot keys a second-level key: one row per element of
    ``second`` (``part``, its index, and ``value``); other rows keep ``part``
    -1.  ``own`` names a column whose index among ``second`` is left out (it is
    the first-level band itself).  Returns the sides, the keys and the largest
    estimate of a first-level key."""
    hot, n_hot, most = _hot_keys(right, keys, split_rows)
    if not n_hot:
        return left, right, keys, 0
    hot = hot.select(*keys, F.lit(True).alias("is_hot"))
    hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
    numbered = ", ".join(f"named_struct('part', {k}, 'value', CAST({c} AS BIGINT))" for k, c in enumerate(second))
    parts = f"filter(array({numbered}), p -> p.part != {own})" if own else f"array({numbered})"
    exploded = F.expr(f"inline(CASE WHEN is_hot THEN {parts} ELSE array(named_struct('part', -1, 'value', 0L)) END)")

    def refined(df):
        return df.join(hot, keys, "left").select(*df.columns, exploded)
    return refined(left), refined(right), keys + ["part", "value"], most


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salt_rows: int,
            broadcast_rows: int, right_id: str):
    """Spread keys with more than ``salt_rows`` index rows over salts (results
    never depend on salting, only the spread of work does)."""
    hot, n_hot, _ = _hot_keys(right, keys, salt_rows)
    if n_hot == 0:
        return left, right, keys
    hot = hot.select(*keys, F.ceil(F.col("est") / salt_rows).cast("int").alias("n_salt"))
    hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
    right = (right.join(hot, keys, "left")
             .withColumn("salt", F.pmod(F.xxhash64(F.col(right_id)),
                                        F.coalesce(F.col("n_salt"), F.lit(1))).cast("int"))
             .drop("n_salt"))
    left = (left.join(hot, keys, "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salt"), F.lit(1)) - 1)))
            .drop("n_salt"))
    return left, right, keys + ["salt"]


def similarity_join(left: DataFrame, right: DataFrame, th: Thresholds = STORE, *,
                    bits_col: str = "bits", self_join: bool = False,
                    left_id: str = "id", right_id: str = "id",
                    salt_rows: int | None = DEFAULT_SALT_ROWS,
                    split_rows: int | None = DEFAULT_SPLIT_ROWS,
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """All (left, right) row pairs within the bits window and the three
    Hamming bounds.  Both inputs carry the 12 words, ``bits_col`` and an id.

    Returns ``l_id, r_id, diff_a, diff_dh, diff_dv``.  With ``self_join``
    (left and right are the same table) each unordered pair appears exactly
    once; pairs in one bits bucket come with ``l_id < r_id``, pairs across
    adjacent buckets in either order, so callers canonicalise with
    ``least``/``greatest``.
    """
    prepare(left.sparkSession)
    n_bands = th.max_a + 1
    if n_bands > MAX_BANDS:
        raise ValueError(f"aHash bound {th.max_a} needs {n_bands} bands; at most {MAX_BANDS} exist")
    if th.max_delta is None:
        # No bits window asked for: set bits of two rows still differ by at most
        # their distance, so the bucket on true popcounts loses nothing.
        delta, bits_col = th.max_a + min(th.max_dh + th.max_dv, th.max_d or 768), "popcount"
        left, right = left.withColumn(bits_col, popcount()), right.withColumn(bits_col, popcount())
    else:
        delta = th.max_delta
    cols = [*WORDS, bits_col]
    bands = _coolest_bands(right, n_bands, split_rows)
    halves = [_halves(AHASH)[b] for b in bands]
    lx = _banded(left.select(F.col(left_id).alias("l_id"), *cols), halves)
    rx = _banded(right.select(F.col(right_id).alias("r_id"), *cols), halves)
    n_second = max(len(DHASH_H), th.max_dh + 1)
    lx, rx, keys = _leveled(lx, rx, ["band_no", "band"], word_parts(DHASH_H, n_second), split_rows, salt_rows, broadcast_rows,
                            bucket=_buckets(bits_col, delta, self_join))
    return _verified(lx, rx, keys, th, delta, bits_col, self_join, bands=bands)


def _verified(lx: DataFrame, rx: DataFrame, keys: list[str], th: Thresholds, delta: int, bits_col: str,
              self_join: bool = False, extra: tuple[str, ...] = (), bands: list[int] | None = None) -> DataFrame:
    """Join exploded rows on ``keys`` and keep each pair once, within the bounds."""
    bands, n_second = bands or list(range(th.max_a + 1)), max(len(DHASH_H), th.max_dh + 1)
    l, r = lx.alias("l"), rx.alias("r")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    # the candidates of a self join outgrow its rows: never in the few tasks of a small scan
    joined = l.join(r.hint("merge") if self_join else r, cond, "inner")
    keep = _first_equal_band(bands) == F.col("l.band_no")
    if "part" in keys:
        first = _first_equal(word_parts(DHASH_H, n_second, "l"), word_parts(DHASH_H, n_second, "r"))
        keep = keep & ((F.col("l.part") == -1) | (first == F.col("l.part")))
    keep = keep & (F.abs(F.col(f"l.{bits_col}") - F.col(f"r.{bits_col}")) <= delta)
    if self_join:
        ordered = F.col("l.l_id") < F.col("r.r_id")
        keep = keep & ((F.col("l.bkt_off") == 1) | ordered if "bkt" in keys else ordered)
    out = joined.filter(keep).select(F.col("l.l_id").alias("l_id"), F.col("r.r_id").alias("r_id"),
                                     sum_distance(AHASH).alias("diff_a"), sum_distance(DHASH_H).alias("diff_dh"),
                                     sum_distance(DHASH_V).alias("diff_dv"), *[F.col(f"r.{c}").alias(c) for c in extra])
    bound = ((F.col("diff_a") <= th.max_a) & (F.col("diff_dh") <= th.max_dh)
             & (F.col("diff_dv") <= th.max_dv))
    if th.max_d is not None:
        bound = bound & (F.col("diff_dh") + F.col("diff_dv") <= th.max_d)
    return out.filter(bound)


def _leveled(left: DataFrame, right: DataFrame, keys: list[str], second: list[str], split_rows: int | None,
             salt_rows: int | None, broadcast_rows: int, own: str | None = None,
             bucket: tuple[str, int, tuple[int, ...]] | None = None):
    """Second-level keys for hot keys, then bits buckets and salts for what is still hot."""
    most = None
    if split_rows:
        left, right, keys, most = _split(left, right, keys, second, split_rows, broadcast_rows, own)
    if bucket and (most is None or most > BUCKET_ROWS):
        left, right, keys = _bucketed(left, right, keys, bucket, broadcast_rows)
    if salt_rows and (most is None or most > salt_rows):
        left, right, keys = _salted(left, right, keys, salt_rows, broadcast_rows, "r_id")
    return left, right, keys


def _buckets(bits_col: str, delta: int, self_join: bool = False) -> tuple[str, int, tuple[int, ...]]:
    """``(bits column, bucket width, offsets of the left side)``."""
    return bits_col, delta + 1, (0, 1) if self_join else (-1, 0, 1)


def _bucketed(left: DataFrame, right: DataFrame, keys: list[str], bucket: tuple[str, int, tuple[int, ...]],
              broadcast_rows: int):
    """Give the rows of keys with more than ``BUCKET_ROWS`` index rows the bits bucket as a
    further key (``bkt``; 0 for all others), and the left ones a row per offset (``bkt_off``)."""
    bits_col, width, offsets = bucket
    hot, n_hot, _ = _hot_keys(right, keys, BUCKET_ROWS)
    if not n_hot:
        return left, right, keys
    hot = hot.select(*keys, F.lit(True).alias("is_wide"))
    hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
    own = _bucket(bits_col, width)
    wide = F.col("is_wide").isNotNull()
    right = right.join(hot, keys, "left").select(*right.columns, F.when(wide, own).otherwise(F.lit(0)).alias("bkt"))
    offs = F.when(wide, F.array(*[F.lit(o) for o in offsets])).otherwise(F.array(F.lit(0)))
    left = left.join(hot, keys, "left").select(*left.columns, F.when(wide, own).otherwise(F.lit(0)).alias("own"),
                                               F.explode(offs).alias("bkt_off"))
    return left.withColumn("bkt", F.col("own") + F.col("bkt_off")).drop("own"), right, keys + ["bkt"]


def popcount() -> Column:
    """Set bits over the twelve words."""
    return F.expr(" + ".join(f"bit_count({w})" for w in WORDS))


def sum_distance(words) -> Column:
    """Differing bits; a missing word reads as 0."""
    return F.expr(" + ".join(f"bit_count(coalesce(l.{w}, 0L) ^ coalesce(r.{w}, 0L))" for w in words))


def still_images(images: DataFrame) -> DataFrame:
    return images.filter(~F.col("animated"))


def fingerprint_classes(images: DataFrame, bits_col: str = "bits",
                        hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Collapse still images with identical words.

    Returns ``(roots, members)``: roots hold one row per distinct fingerprint
    (``id`` = smallest image id, the words, ``bits_col``); members map every
    still image ``id`` to its ``root``.  The aggregation is partial (map-side)
    and classes of more than ``hot_rows`` images meet their root by broadcast,
    so a class of any size never gathers in one task.
    """
    still = still_images(images).withColumn("fp", F.struct(*WORDS))
    # One struct-valued key instead of twelve equal columns keeps Catalyst's
    # constraint inference linear.
    classes = still.groupBy("fp").agg(F.min("id").alias("root"), F.min(bits_col).alias(bits_col),
                                      F.count(F.lit(1)).alias("n_rows"))
    roots = classes.select(F.col("root").alias("id"), *[F.col(f"fp.{w}").alias(w) for w in WORDS], bits_col)
    members = join_back(still.select("id", "fp"), classes.select("fp", "root", "n_rows"), "fp", "n_rows",
                        hot_rows).select("id", "root")
    return roots, members


def near_index(images: DataFrame, th: Thresholds = STORE, *, bits_col: str = "bits",
               salt_rows: int | None = DEFAULT_SALT_ROWS,
               split_rows: int | None = DEFAULT_SPLIT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(members, root_edges)``: class root of every still image, and the
    edges ``a < b, diff_a, diff_d`` between distinct fingerprints."""
    roots, members = fingerprint_classes(images, bits_col)
    roots = stored(roots, "roots")             # read by the search for hot keys and by both sides of the join
    root_edges = (similarity_join(roots, roots, th, bits_col=bits_col, self_join=True,
                                  salt_rows=salt_rows, split_rows=split_rows)
                  .select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"),
                          "diff_a", (F.col("diff_dh") + F.col("diff_dv")).alias("diff_d")))
    return members, root_edges


def near_pairs(images: DataFrame, th: Thresholds = STORE, *, bits_col: str = "bits",
               salt_rows: int | None = DEFAULT_SALT_ROWS,
               split_rows: int | None = DEFAULT_SPLIT_ROWS) -> DataFrame:
    """JN1/JN2 + SNK4: the stored near-duplicate edge table ``a, b, diff_a,
    diff_d`` (``a < b``): root edges between distinct fingerprints within the
    bounds, plus one zero-distance edge from each copy to its class root."""
    members, root_edges = near_index(images, th, bits_col=bits_col, salt_rows=salt_rows, split_rows=split_rows)
    return root_edges.unionByName(copy_edges(members))


def copy_edges(members: DataFrame) -> DataFrame:
    return (members.filter(F.col("id") != F.col("root"))
            .select(F.col("root").alias("a"), F.col("id").alias("b"),
                    F.lit(0).alias("diff_a"), F.lit(0).alias("diff_d")))


def returned(pairs: DataFrame, max_a: int = RETURN_MAX_A, max_d: int = RETURN_MAX_D) -> DataFrame:
    """Stored edges that are strong enough to be reported (diff_a <= 3 and
    diff_d <= 10)."""
    return pairs.filter((F.col("diff_a") <= max_a) & (F.col("diff_d") <= max_d))


PLACE_EDGES = 1024     # edges of one neighbourhood that may meet their texts in one place
MAX_SIDE = 64          # a larger neighbourhood is dealt over up to this many rows and columns of places


def places(edges: DataFrame, place_edges: int = PLACE_EDGES) -> DataFrame:
    """``a, b, place``: edges of one neighbourhood get one place, so that a text travels once to most of its
    pairs instead of once to each.

    The neighbourhood is the smallest id next to either end.  One with more than ``place_edges`` edges is cut
    into a grid by hashes of both ends, so its pairs are spread however many there are."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"), F.count(F.lit(1)).alias("n_rows"))
    e = join_back(edges.select("a", "b"), low.withColumnRenamed("low", "low_b"), "b", "n_rows")
    e = e.join(low.select(F.col("b").alias("a"), F.col("low").alias("low_a")), "a", "left")
    e = e.select("a", "b", F.least("low_a", "low_b").alias("home"))     # a is never below low_b
    sizes = e.groupBy("home").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "side", F.least(F.lit(MAX_SIDE), F.ceil(F.col("n_rows") / F.lit(place_edges))).cast("int"))
    return join_back(e, sizes, "home", "n_rows").select("a", "b", F.xxhash64(
        "home", F.pmod(F.hash("a"), F.col("side")), F.pmod(F.hash("b"), F.col("side"))).alias("place"))


def with_texts(edges: DataFrame, docs: DataFrame, doc: str, text: str, place_edges: int = PLACE_EDGES) -> DataFrame:
    """``a, b, ta, tb``: the edges with the texts of both ends (each row of ``docs`` counts).

    A text crosses one shuffle to the few places that need it; a join by (place, id) would send the edges on with
    their first text to meet the second.  So texts and edges are dealt by place alone, and within a
    place each edge takes the texts of its first end, then those of its second, from the rows beside it."""
    spark = edges.sparkSession
    placed = stored(places(edges, place_edges), "places")
    needed = placed.select("place", F.explode(F.array("a", "b")).alias(doc)).distinct()
    there = needed.join(docs.select(doc, F.struct(F.col(text).alias("t")).alias("own")), doc)
    # little to move, much to do with it: no fewer partitions than that, and AQE does not merge them
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = there.select("place", F.col(doc).alias("at"), "own").unionByName(
        placed.withColumn("at", F.col("a")), allowMissingColumns=True).repartition(n, "place")
    beside = F.collect_list("own").over(Window.partitionBy("place", "at"))
    nothing = F.array(F.lit(None).cast(there.schema["own"].dataType))
    for end in "ab":       # an edge stands at its first end, then at its second; a text stays where it is
        rows = rows.select("*", F.when(F.col("own").isNull(), beside).otherwise(nothing).alias("met"))
        rows = rows.select(*[c for c in rows.columns if c not in ("met", "at")], F.explode("met").alias(f"t{end}"),
                           F.coalesce("b", "at").alias("at"))
    return rows.filter(F.col("own").isNull()).select("a", "b", F.col("ta.t").alias("ta"), F.col("tb.t").alias("tb"))


def exact_classes(images: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Animated images grouped by content digest: ``id, root`` with root the
    smallest id sharing the digest (JN4 groups)."""
    anim = images.filter(F.col("animated")).select("id", "crc")
    roots = anim.groupBy("crc").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n_rows"))
    return join_back(anim, roots, "crc", "n_rows", hot_rows).select("id", "root", "crc")


def exact_pairs(images: DataFrame) -> DataFrame:
    """JN4 + SNK3: exact-duplicate edges among animated images, one per copy
    to the digest group's root (``a = root < b``)."""
    return (exact_classes(images).filter(F.col("id") != F.col("root"))
            .select(F.col("root").alias("a"), F.col("id").alias("b")))


def exact_groups(images: DataFrame) -> DataFrame:
    """Digest groups with more than one animated image: crc, n, first and
    last id (the group form of JN4 for reports)."""
    return (images.filter(F.col("animated")).groupBy("crc")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                 F.max("id").alias("last_id"))
            .filter(F.col("n") > 1))


def new_pairs_only(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """JN3/JN13/SET2: candidate edges not stored yet, in either orientation
    (edges are canonical ``a < b``, so one anti join on (a, b) covers both)."""
    canon = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                              *[c for c in candidates.columns if c not in ("a", "b")])
    return canon.join(stored.select("a", "b"), ["a", "b"], "left_anti")


TOTAL_SPLIT_ROWS = 2048   # a split row is written once per second band, 21 times at ``TOTAL_MAX``
TOTAL_MAX = 20   # LSH prototype: largest total distance over the 768 bits


def total_distance_pairs(images: DataFrame, max_total: int = TOTAL_MAX, *,
                         salt_rows: int | None = DEFAULT_SALT_ROWS,
                         split_rows: int | None = TOTAL_SPLIT_ROWS) -> DataFrame:
    """JN15 made exact: still-image pairs whose distance over all 768 bits is
    at most ``max_total`` (``a < b, distance``).

    The reference sketches this with random-hyperplane LSH (approximate,
    never wired up).  With 24 disjoint 32-bit bands, ``max_total + 1 <= 24``
    bands guarantee an equal band for every qualifying pair, so the same
    band join finds all of them; copies collapse to class roots as in
    ``near_pairs``.  The rows of a hot band are split by a second equal band:
    outside the first one at least one of any ``max_total + 1`` others is
    equal too, so nothing is lost (up to ``max_total`` 22).
    """
    prepare(images.sparkSession)
    n_bands = max_total + 1
    if n_bands > 2 * len(WORDS):
        raise ValueError(f"total distance {max_total} needs {n_bands} bands; at most {2 * len(WORDS)} exist")
    roots, members = fingerprint_classes(images)
    roots = stored(roots.select("id", *WORDS), "roots")
    def explode(df):
        return df.select("*", F.posexplode(_band_array(_halves(WORDS)[:n_bands])).alias("band_no", "band"))
    lx, rx = explode(roots.withColumnRenamed("id", "l_id")), explode(roots.withColumnRenamed("id", "r_id"))
    n_second = n_bands + 1                       # the first-level band is one of them
    can_split = n_second <= 2 * len(WORDS)
    lx, rx, keys = _leveled(lx, rx, ["band_no", "band"], _halves(WORDS)[:n_second], split_rows if can_split else None,
                            salt_rows, DEFAULT_BROADCAST_ROWS, "band_no")
    l, r = lx.alias("l"), rx.alias("r")
    j = l.join(r.hint("merge"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    left_b, right_b = _halves(WORDS, "l"), _halves(WORDS, "r")
    keep = (F.col("l.l_id") < F.col("r.r_id")) & (_first_equal(left_b[:n_bands], right_b[:n_bands]) == F.col("l.band_no"))
    if "part" in keys:
        second = _first_equal(left_b[:n_second], right_b[:n_second], unless="l.band_no")
        keep = keep & ((F.col("l.part") == -1) | (second == F.col("l.part")))
    out = (j.filter(keep).select(F.col("l.l_id").alias("a"), F.col("r.r_id").alias("b"), sum_distance(WORDS).alias("distance"))
           .filter(F.col("distance") <= max_total))
    copies = (members.filter(F.col("id") != F.col("root"))
              .select(F.col("root").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")))
    return out.unionByName(copies)


def nearest(pairs: DataFrame, k: int, dist_col: str = "distance") -> DataFrame:
    """SRT6: for every image, its ``k`` nearest partners (distance, then id);
    the per-image limit runs as a partial window group limit."""
    both = (pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), dist_col)
            .unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), dist_col)))
    w = Window.partitionBy("id").orderBy(dist_col, "other")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def band_rows(roots: DataFrame, th: Thresholds = STORE, *, bits_col: str = "bits", id_col: str = "id") -> DataFrame:
    """Index-side rows of the band join, ready to be stored: ``band_no, band, bkt,
    r_id``, the words and ``bits_col`` (one row per band)."""
    if th.max_delta is None:
        raise ValueError("stored bands need a bits window")
    base = roots.select(F.col(id_col).alias("r_id"), *WORDS, bits_col)
    out = _explode_bands(base, th.max_a + 1, bits_col, th.max_delta + 1, (0,))
    return out.select("band_no", "band", "bkt", "r_id", *WORDS, bits_col)


def match_bands(queries: DataFrame, index: DataFrame, th: Thresholds = STORE, *, bits_col: str = "bits",
                id_col: str = "id", extra: tuple[str, ...] = (), split_rows: int | None = DEFAULT_SPLIT_ROWS,
                salt_rows: int | None = DEFAULT_SALT_ROWS) -> DataFrame:
    """Query rows against stored ``band_rows``; ``extra`` names further columns of the
    index to carry.  Returns ``l_id, r_id, diff_a, diff_dh, diff_dv`` within the bounds."""
    prepare(queries.sparkSession)
    cols = ["band_no", "band", *WORDS, bits_col]
    q = _banded(queries.select(F.col(id_col).alias("l_id"), *WORDS, bits_col), _halves(AHASH)[:th.max_a + 1])
    lx, rx, keys = _leveled(q.select("l_id", *cols), index.select("r_id", *cols, *extra), ["band_no", "band"],
                            word_parts(DHASH_H, max(len(DHASH_H), th.max_dh + 1)), split_rows, salt_rows,
                            DEFAULT_BROADCAST_ROWS, bucket=_buckets(bits_col, th.max_delta))
    return _verified(lx, rx, keys, th, th.max_delta, bits_col, extra=extra)
