"""Block lists and the miss limiter (SRC5, SET1, FLT11, AGG8, WIN5, DML3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dupstream.functions.text import PY_SPACE

# ---- fixed values (reference rules) --------------------------------------
MISS_LIMIT = 10       # more than this many misses ...
MISS_WINDOW = 180     # ... within this many seconds blocks the user
# --------------------------------------------------------------------------
HOUR = 3600           # time slice that splits one user's events across tasks

_INT_LINE = r"^[+-]?[0-9]+$"


def read_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC5 source: a text file (or folder) with one id per line."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_id_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """SRC5: trimmed lines that parse as integers, as ``userid`` (other lines
    are skipped, as the reference's ``int(line)`` failures are)."""
    t = F.trim(F.col(col), F.lit(PY_SPACE))
    return (lines.select(t.alias("t")).filter(F.col("t").rlike(_INT_LINE))
            .select(F.col("t").try_cast("bigint").alias("userid"))
            .filter(F.col("userid").isNotNull()))


def update_blocklist(blocked: DataFrame, add_lines: DataFrame, remove_lines: DataFrame) -> DataFrame:
    """SET1: (blocked ∪ added) − removed; removal runs last."""
    added = blocked.select("userid").unionByName(parse_id_lines(add_lines)).distinct()
    return added.join(parse_id_lines(remove_lines), "userid", "left_anti")


def miss_counts(misses: DataFrame, *, limit: int = MISS_LIMIT, window: int = MISS_WINDOW) -> DataFrame:
    """AGG8/WIN5 in batch: for every miss event (taken as "now"), the user's
    misses within the last ``window`` seconds (inclusive, expired ones are
    gone: DML3) and whether that exceeds ``limit``.

    The window is partitioned by (user, hour slice) rather than by user, so a
    user with a huge history is spread over many tasks: each slice also gets
    a read-only copy of the previous slice's last ``window`` seconds.
    """
    m = misses.select("userid", "ts").withColumn("slice", F.floor(F.col("ts") / HOUR).cast("bigint"))
    own = m.withColumn("ghost", F.lit(False))
    tail = (m.filter(F.col("ts") >= (F.col("slice") + 1) * HOUR - window)
            .withColumn("slice", F.col("slice") + 1).withColumn("ghost", F.lit(True)))
    w = Window.partitionBy("userid", "slice").orderBy("ts").rangeBetween(-window, 0)
    counted = own.unionByName(tail).withColumn("recent", F.count(F.lit(1)).over(w))
    return (counted.filter(~F.col("ghost"))
            .select("userid", "ts", "recent", (F.col("recent") > limit).alias("blocked")))
