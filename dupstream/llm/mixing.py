"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic).  The token mass of the cells
is raked: each margin in turn is scaled to its target shares, round after round.  A
cell's weight is its raked mass over its own; divided by the largest weight it is the
probability with which each document of the cell is taken, so shares among the taken
tokens meet all targets and no document is taken twice.  A document's draw is a hash
of its id and the seed: equal at every run and on every executor.

Rounds go on until every value's share is within ``TOLERANCE`` of its target, however
nearly sources and languages are bound together; ``ROUNDS`` are run at least.  Targets
that no weights can meet, or not within the ceiling of rounds, end in a warning that
names the residual left.

Texts are read in place for token counts; only the cell table, one row for each cell
that occurs, goes through the rounds: on the driver up to ``DRIVER_CELLS`` cells, since
thousands of rounds may be needed, else as DataFrame steps, written to the shared folder
once a round.  It is joined back to the documents as Spark's size estimates decide
(broadcast when small, else a shuffle in which adaptive execution may split a frequent
source).

Defined results: null source, language or topic is a value of its own (empty string);
null texts count 0 tokens; cells without tokens have weight 1 before scaling; targets
that name values which do not occur are spread over those that do; values without a
target are not taken (probability 0); every row is returned, repeated ones and null ids
too; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C

MARGINS = ("source", "lang", "topic")
ROUNDS = 6                     # at least
TOLERANCE = 1e-5               # largest distance of a share from its target
DRIVER_CELLS = 200_000         # larger cell tables are raked by Spark
CEILING = {"driver": 100_000, "spark": 1_000}    # rounds
WRITE_EVERY = 1                # rounds between two writes of the cell table
# Exponents of the natural shares that make the default targets: below 1 small
# sources, languages and topics gain.
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.95}
SEED = 17
WORDS = r"[^\x20\x09-\x0D]+"


def topic_of(text):
    """Topic of a text by its form (first that fits): ``license`` lines,
    ``table`` bars, ``contact`` details, several ``lines``, or ``plain``."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("icense"), "license").when(t.contains(" | "), "table")
            .when(t.contains("@") | t.contains("+1 ("), "contact").when(t.contains("\n"), "lines").otherwise("plain"))


def _keys() -> list:
    """The three margins of a document, under names of their own."""
    return [*(F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_mix_{m}") for m in MARGINS[:2]),
            topic_of(F.col("text")).alias("_mix_topic")]


def _tokens():
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def tempered_targets(cells: DataFrame, temper: dict[str, float]) -> dict[str, DataFrame]:
    """Targets (``value``, ``share``) that grow as a power of the natural shares."""
    return {m: cells.groupBy(F.col(m).alias("value")).agg(F.sum("mass").alias("mass")).filter("mass > 0")
            .select("value", F.pow(F.col("mass"), F.lit(float(temper[m]))).alias("share")) for m in MARGINS}


def _rake_here(rows: list, rounds: int, ceiling: int) -> tuple[np.ndarray, float]:
    """Raked masses of collected cells, and the largest distance of a share from its
    target."""
    mass = np.array([r["mass"] for r in rows], float)
    raked, total = mass.copy(), mass.sum()
    margins = []
    for m in MARGINS:
        _, code = np.unique(np.array([r[m] for r in rows], object), return_inverse=True)
        share = np.zeros(code.max() + 1)
        share[code] = [r[f"share_{m}"] for r in rows]
        # shares count over the values that have mass
        share[np.bincount(code, mass) == 0] = 0
        margins.append((code, share / (share.sum() or 1.0)))
    for turn in range(1, max(rounds, ceiling) + 1):
        for code, share in margins:
            now = np.bincount(code, raked)
            raked = raked * np.divide(total * share, now, out=np.zeros_like(now), where=now > 0)[code]
        if turn >= rounds:
            left = max(np.abs(np.bincount(code, raked) / total - share).max() for code, share in margins)
            if left <= TOLERANCE:
                break
    return raked, float(left)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``cells`` (margins, ``mass``) with ``raked``, the mass after fitting, and the
    residual: the largest distance of a value's share from its target.  Each step sums
    the raked mass by one margin (partial sums first) and scales the cells to that
    margin's shares.  ``rounds`` are run at least, and more until the residual is
    within ``TOLERANCE`` or the ceiling is reached."""
    spark = cells.sparkSession
    now = cells.withColumn("raked", F.col("mass").cast("double"))
    for m, target in targets.items():
        shares = target.groupBy(F.col("value").alias(m)).agg(F.sum("share").alias(f"share_{m}"))
        now = now.join(shares, m, "left").withColumn(f"share_{m}", F.coalesce(f"share_{m}", F.lit(0.0)))
    now = C.stored(spark, now, "cells")
    n, total = now.agg(F.count("*"), F.sum("mass")).first()
    if not total:
        return now.select(*MARGINS, "mass", "raked"), 0.0
    total = float(total)
    if n <= DRIVER_CELLS:
        rows = now.collect()
        raked, left = _rake_here(rows, rounds, CEILING["driver"])
        done = [(*(r[m] for m in MARGINS), r["mass"], float(x)) for r, x in zip(rows, raked)]
        names = ", ".join(f"{m} string" for m in MARGINS)
        return spark.createDataFrame(done, f"{names}, mass long, raked double"), left
    # shares count over the values that have mass
    present = [now.filter("mass > 0").groupBy(m).agg(F.first(f"share_{m}").alias("s")).agg(F.sum("s")).first()[0] or 1.0
               for m in MARGINS]
    for turn in range(1, max(rounds, CEILING["spark"]) + 1):
        for m, whole in zip(MARGINS, present):
            sums = now.groupBy(m).agg(F.sum("raked").alias("now"))
            factor = F.when(F.col("now") > 0, F.lit(total) * F.col(f"share_{m}") / F.lit(float(whole)) / F.col("now")).otherwise(0.0)
            now = now.join(sums, m).withColumn("raked", F.col("raked") * factor).drop("now")
        if turn % WRITE_EVERY == 0 or turn >= rounds:
            now = C.stored(spark, now, "cells")
        if turn >= rounds:
            # one aggregate over all margins; values without mass have no target
            off = [F.abs(F.col("now") / total - F.col(f"s_{m}") / float(whole)) for m, whole in zip(MARGINS, present)]
            sums = now.groupingSets([[F.col(m)] for m in MARGINS], *MARGINS).agg(
                F.sum("raked").alias("now"), F.sum("mass").alias("had"), F.grouping_id().alias("g"),
                *(F.max(f"share_{m}").alias(f"s_{m}") for m in MARGINS))
            left = sums.filter("had > 0").agg(F.max(
                F.when(F.col("g") == 3, off[0]).when(F.col("g") == 5, off[1]).otherwise(off[2]))).first()[0]
            if left <= TOLERANCE:
                break
    return now.select(*MARGINS, "mass", "raked"), float(left)


def uniform(doc_id, seed: int):
    """Draw in [0, 1) from an id: 52 bits of a hash of id and seed."""
    digest = F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def chances(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The calibrated ``probability`` of every cell.  ``targets`` gives shares by
    margin and value; margins that are not given get tempered natural shares."""
    spark = docs.sparkSession
    rows = docs.select(*_keys(), _tokens().alias("n"))
    cells = C.stored(spark, rows.groupBy(*(F.col(f"_mix_{m}").alias(m) for m in MARGINS)).agg(F.sum("n").alias("mass")), "mass")
    wanted = tempered_targets(cells, TEMPER)
    for m, shares in (targets or {}).items():
        wanted[m] = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "value string, share double")
    raked, left = rake(cells, wanted, rounds)
    if left > TOLERANCE:
        warnings.warn(f"mixing: a share is still {left:.2g} from its target after the last round", RuntimeWarning, stacklevel=2)
    raked = raked.withColumn(
        "weight", F.when(F.col("mass") > 0, F.col("raked") / F.col("mass")).otherwise(1.0))
    top = raked.agg(F.max("weight").alias("top")).first()["top"] or 1.0
    chance = F.round(F.least(F.col("weight") / F.lit(float(top)), F.lit(1.0)), 9)
    return C.stored(spark, raked.select(*(F.col(m).alias(f"_mix_{m}") for m in MARGINS), chance.alias("_mix_chance")), "chances")


def _drawn(docs: DataFrame, targets, rounds: int, seed: int) -> DataFrame:
    """``docs`` with margins, probability and draw."""
    return (docs.select("*", *_keys()).join(chances(docs, targets, rounds), [f"_mix_{m}" for m in MARGINS])
            .withColumn("_mix_kept", uniform(F.col("doc_id"), seed) < F.col("_mix_chance")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
        seed: int = SEED) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``probability`` and ``kept``."""
    needed = docs.select("doc_id", *MARGINS[:2], "text")
    return _drawn(needed, targets, rounds, seed).select(
        "doc_id", *(F.col(f"_mix_{m}").alias(m) for m in MARGINS), _tokens().alias("n_tokens"),
        F.col("_mix_chance").alias("probability"), F.col("_mix_kept").alias("kept"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS,
            seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    return _drawn(docs, targets, rounds, seed).filter("_mix_kept").select(*docs.columns)
