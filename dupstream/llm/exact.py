"""Exact deduplication by content sort.

Texts are normalised to UTF-8 bytes with A-Z lower-cased.  Sampled splitters
deal the rows into ranges of the order (first bytes, fingerprint, id); each range
is sorted by (first bytes, fingerprint, whole normalised bytes, id) with Spark's
external sort, which places equal texts side by side, and neighbours are compared
byte by byte.  A splitter holds at most ``HEAD`` bytes, a fingerprint and an id, so
what the driver samples is bounded however long the texts are, and a large group
of copies is split over ranges by its ids.  Only a group that touches the first or
last key of a range can go on in another one: those groups, at most two keys a
range, are put together from a small stored table.

Defined results: null texts count as empty; a null id is smaller than any id and
its rows are returned too; of rows that repeat both id and text exactly one is
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C

HEAD = 64
RANGE_BYTES = 256 << 20      # normalised bytes of one range, when Spark's own number of partitions gives more


def _normalised(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for batch in batches:
        data, offsets = C.string_buffers(batch.column("text"))
        text = fold[data[offsets[0]:offsets[-1]]].tobytes()
        base = int(offsets[0])
        norm = [text[a - base:b - base] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([x[:HEAD] for x in norm], pa.binary()),
            pa.array(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in norm), np.uint64, len(norm)).view(np.int64)),
            pa.array(norm, pa.binary())], names=["doc_id", "head", "fp", "norm"])


def _neighbours(batches):
    """Runs of equal neighbours of one sorted range.  A run's rows are given out
    when it ends; only ids are held meanwhile."""
    import hashlib

    import pyarrow as pa
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    first_key, key, text, ids = None, None, None, []
    out: list = []
    waiting: list = []                 # ended runs whose key is still the latest one

    def end_run():
        waiting.append((hashlib.sha256(text).digest(), list(ids)))

    def settle(last: bool):
        border = last or key == first_key
        for digest, members in waiting:
            best = max((i for i in members if i is not None), default=None)
            n = len(members)
            out.extend((i, best, n, at == n - 1, border, digest) for at, i in enumerate(members))
        waiting.clear()

    def flush():
        rows = list(zip(*out)) if out else [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([
            pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
            pa.array(rows[3], pa.bool_()), pa.array(rows[4], pa.bool_()), pa.array(rows[5], pa.binary()),
            pa.array([part] * len(rows[0]), pa.int32())],
            names=["doc_id", "best", "n", "last", "border", "digest", "part"])

    for batch in batches:
        for doc, head, fp, norm in zip(batch.column("doc_id").to_pylist(), batch.column("head"),
                                       batch.column("fp").to_pylist(), batch.column("norm")):
            now, norm = (head.as_py(), fp), norm.as_py()
            if text is None:
                first_key, key, text = now, now, norm
            elif norm != text:
                end_run()
                ids.clear()
                text = norm
                if now != key:
                    settle(False)
                    key = now
            ids.append(doc)
        if out:
            yield flush()
    if text is not None:
        end_run()
        settle(True)
        yield flush()


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Per row: ``doc_id``, ``keep_id`` (id of the row of its group that stays),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.
    ``keep`` is ``smallest`` or ``largest`` identifier."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-C.text_bytes(rows) // RANGE_BYTES))
    # the row to keep sorts last of its run, so ids run downwards for "smallest"
    by_id = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()
    runs = (rows.mapInArrow(C.tidy("exact", _normalised), "doc_id long, head binary, fp long, norm binary")
            .repartitionByRange(parts, "head", "fp", by_id)
            .sortWithinPartitions("head", "fp", "norm", by_id)
            .mapInArrow(C.tidy("exact", _neighbours if keep == "largest" else _neighbours_down),
                        "doc_id long, best long, n long, last boolean, border boolean, digest binary, part int"))
    runs = C.stored(spark, runs, "exact")
    best = F.max if keep == "largest" else F.min
    whole = (runs.filter("border").groupBy("digest")
             .agg(best("doc_id").alias("all_best"), F.count(F.lit(1)).alias("all_n"),
                  F.max(F.when(F.col("last"), F.struct(
                      (F.col("best") if keep == "largest" else -F.col("best")).alias("b"), "part"))).alias("win")))
    inner = runs.filter(~F.col("border")).select(
        "doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.col("last").alias("kept"), "digest")
    # at most two keys a range are on a border: the table of their groups is small
    edge = (runs.filter("border").join(F.broadcast(whole), "digest")
            .select("doc_id", F.col("all_best").alias("keep_id"), F.col("all_n").alias("group_size"),
                    (F.col("last") & F.col("doc_id").eqNullSafe(F.col("all_best"))
                     & (F.col("part") == F.col("win.part"))).alias("kept"), "digest"))
    return inner.unionAll(edge).select("doc_id", "keep_id", "group_size", "kept",
                                       F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all
    their columns."""
    from pyspark.sql import Window
    from pyspark.sql import types as T
    at, digest = "_exact_id", "_exact_digest"
    stay = exact_groups(docs, keep).filter("kept").select(F.col("doc_id").alias(at), F.col("text_sha256").alias("_exact_sha"))

    def digests(batches):
        import hashlib

        import pyarrow as pa
        for batch in batches:
            sums = [hashlib.sha256((x or "").encode().lower()).hexdigest() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, digest])

    rows = docs.mapInArrow(C.tidy("exact", digests), T.StructType([*docs.schema.fields, T.StructField(digest, T.StringType())]))
    joined = rows.join(stay, rows["doc_id"].eqNullSafe(stay[at]) & (rows[digest] == stay["_exact_sha"]))
    # rows that repeat id and text come once
    once = F.row_number().over(Window.partitionBy(at, digest).orderBy(F.lit(0)))
    return joined.withColumn("_exact_row", once).filter(F.col("_exact_row") == 1).select(*docs.columns)


def _neighbours_down(batches):
    """As ``_neighbours`` where the smallest id is kept."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in _neighbours(_negated(batches)):
        yield pa.RecordBatch.from_arrays(
            [pc.negate(c) if name in ("doc_id", "best") else c for name, c in zip(batch.schema.names, batch.columns)],
            names=batch.schema.names)


def _negated(batches):
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pc.negate(c) if name == "doc_id" else c for name, c in zip(batch.schema.names, batch.columns)],
            names=batch.schema.names)
