"""Joining an aggregate back to the rows it came from without a hot key in one task.

``rows.join(rows.groupBy(key).agg(...), key)`` shuffles a key's rows to one task, and
adaptive execution cannot split them, because the aggregate sits right behind its own
shuffle.  The aggregate knows the size of each key, so the few keys above a row bound are
broadcast and meet their rows where they are; only the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000   # keys with more rows than this are met by broadcast


def join_back(rows: DataFrame, per_key: DataFrame, key: str, n_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row per ``key``, its row count in
    ``n_col``); ``n_col`` is dropped.

    At most ``rows / hot_rows`` keys can be hot, so the broadcast holds one entry per
    ``hot_rows`` rows at the very most (a hundred thousand for 20 billion rows).
    """
    hot = per_key.filter(F.col(n_col) > hot_rows).drop(n_col)
    cold = per_key.filter(F.col(n_col) <= hot_rows).drop(n_col)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return met.unionByName(rest)
