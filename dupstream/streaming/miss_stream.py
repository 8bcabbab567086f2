"""Sliding 180-second miss limiter as a stateful stream, free of arrival order (ST2, DML3).

The state is kept per hour, as the batch form cuts its windows, and per shard of the users
(a hash of the user): it holds that hour's misses of the shard's users and those of the
``window`` seconds before it.  A group costs a call of its own whatever it holds, so the
number of groups is hours times ``shards`` and does not grow with users or misses; a
group grows with the misses of an hour over ``shards``, which is fixed when a checkpoint is
first created.  An arriving miss raises the counts of all misses in
the ``window`` seconds after it, which may have been written before; their rows are
written again.  Counts only grow, so ``read_counts`` takes the largest, whatever order
files arrive in and however often a batch is replayed.

``late`` bounds the disorder: a miss that is more than ``late`` seconds older than the newest one
of earlier batches is dropped, as by any watermark, and the state of an hour goes when
the watermark has passed it.  Watermarks start at the epoch, so earlier misses are dropped
too.  Misses without a time are left out; a null user is a user, with a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dupstream.operators.limits import HOUR, MISS_LIMIT, MISS_WINDOW

OUT_SCHEMA = "userid bigint, ts bigint, n bigint, recent bigint"
STATE_SCHEMA = "users array<bigint>, times array<bigint>"
SHARDS = 32          # groups of users an hour's misses are dealt to
NO_USER = -1         # the shard of the null user


def _limiter(window: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shard, hour = key
        held = state.get if state.exists else ([], [])
        old_users, old_times = (np.array(x, dtype=np.int64) for x in held)
        new = [(b["userid"].fillna(0).to_numpy(dtype=np.int64), b["ts"].to_numpy(dtype=np.int64)) for b in batches]
        users = np.concatenate([old_users, *(u for u, _ in new)])
        times = np.concatenate([old_times, *(t for _, t in new)])
        state.update((users.tolist(), times.tolist()))
        state.setTimeoutTimestamp(max(int(hour + 1) * HOUR * 1000, state.getCurrentWatermarkMs() + 1))
        # one sorted line of seconds, the users so far apart that no window reaches the next one
        names, at = np.unique(users, return_inverse=True)
        line = at * (HOUR + 2 * window + 1) + times - hour * HOUR
        fresh, line_all = np.sort(line[len(old_times):]), np.sort(line)
        own, first = np.unique(line[times >= hour * HOUR], return_index=True)
        who, ts = (x[times >= hour * HOUR][first] for x in (at, times))
        # seconds whose window holds a new miss
        changed = np.searchsorted(fresh, own, side="right") > np.searchsorted(fresh, own - window, side="left")
        own, who, ts = own[changed], who[changed], ts[changed]
        upto = np.searchsorted(line_all, own, side="right")
        yield pd.DataFrame({"userid": pd.array([None] * len(own) if shard == NO_USER else names[who], dtype="Int64"), "ts": ts,
                            "n": upto - np.searchsorted(line_all, own, side="left"),
                            "recent": upto - np.searchsorted(line_all, own - window, side="left")})
    return step


def miss_stream(misses: DataFrame, *, window: int = MISS_WINDOW, late: int = MISS_WINDOW, shards: int = SHARDS) -> DataFrame:
    """Streaming DataFrame of (userid, ts, n, recent) from a stream of (userid, ts epoch
    seconds): the misses of that second and those in ``[ts - window, ts]``, as known so far."""
    if not 0 <= window <= HOUR:
        raise ValueError("window must be within an hour")
    hour = F.floor(F.col("ts") / HOUR).cast("bigint")
    # the last seconds of an hour also belong to the next hour's first windows
    hours = F.when(F.col("ts") >= (hour + 1) * HOUR - window, F.array(hour, hour + 1)).otherwise(F.array(hour))
    ev = (misses.filter(F.col("ts").isNotNull()).select("userid", "ts", F.timestamp_seconds("ts").alias("event_time"))
          .withWatermark("event_time", f"{late} seconds").withColumn("hour", F.explode(hours))
          .withColumn("shard", F.when(F.col("userid").isNull(), NO_USER).otherwise(F.pmod(F.xxhash64("userid"), F.lit(shards))).cast("int")))
    return ev.groupBy("shard", "hour").applyInPandasWithState(
        _limiter(window), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_miss_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                    files_per_batch: int = 1, state_partitions: int | None = None, late: int = MISS_WINDOW,
                    shards: int = SHARDS) -> None:
    """Run the limiter over every file in ``source_dir`` (then stop).

    The number of state partitions is fixed when a checkpoint is first
    created; it is taken from ``state_partitions`` or the cluster's default
    parallelism rather than the session's shuffle setting, then restored.
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        src = (spark.readStream.schema("userid bigint, ts bigint")
               .option("maxFilesPerTrigger", files_per_batch).parquet(source_dir))
        q = (miss_stream(src, late=late, shards=shards).writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)


def read_counts(spark: SparkSession, out_dir: str, limit: int = MISS_LIMIT) -> DataFrame:
    """One row per miss, as ``limits.miss_counts`` gives them: the newest counts written."""
    rows = spark.read.schema(OUT_SCHEMA).parquet(out_dir)
    last = rows.groupBy("userid", "ts").agg(F.max("n").alias("n"), F.max("recent").alias("recent"))
    return last.select("userid", "ts", "recent", (F.col("recent") > limit).alias("blocked"),
                       F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k")).drop("k")


def write_arrivals(misses: DataFrame, folder: str, chunks: int, by_time: bool = True) -> None:
    """Write misses as ``chunks`` files in one job: by time, or dealt by a hash, so that
    every file spans the whole time and nearly every miss is out of order."""
    dealt = (misses.repartitionByRange(chunks, "ts") if by_time
             else misses.repartition(chunks, F.xxhash64("userid", "ts")))
    dealt.write.mode("append").parquet(folder)
