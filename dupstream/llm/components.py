"""Connected components of a link table, entirely as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstream.llm import common as C


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) of every node in
    ``links`` (columns ``a``, ``b``).

    Each round takes the smallest label among the neighbours and then the label
    of that label (pointer jumping), so paths shrink by more than half a round.
    Labels are written to the shared folder each round: plans stay short and a lost
    executor costs one round at most.
    """
    spark = links.sparkSession
    both = C.stored(spark, links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a")))
                    .filter("a != b").distinct(), "links")
    labels = C.stored(spark, both.groupBy(F.col("a").alias("node"))
                      .agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                                F.least("component", "near").alias("via"))
        target = labels.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        new = C.stored(spark, step.join(target, "via").select(
            "node", "old", F.least("via", "jump").alias("component")), "labels")
        moved = new.filter("component != old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def merged(labels: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``labels`` (``node``, ``component``) after further ``links``: the components of all
    links so far.  Only links between different components are followed, and between
    components, so settled ones are never walked again."""
    spark = labels.sparkSession
    ends = links.select("a", "b")
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        ends = ends.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    ends = C.stored(spark, ends, "ends")
    between = ends.filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    nodes = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")),
                                          F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("n")).select("n.*")
    nodes = labels.unionAll(nodes.filter("node = component")).distinct()
    if not between.limit(1).count():
        return C.stored(spark, nodes, "labels")
    now = components(between, most_rounds).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return C.stored(spark, nodes.join(now, "component", "left")
                    .select("node", F.coalesce("least", "component").alias("component")), "labels")
