"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.staging import staged

MAX_ROUNDS = 60


def _stars(links: DataFrame) -> tuple[DataFrame, int]:
    """One large-star and one small-star step; also a fingerprint of the result."""
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    # Large star: link every larger neighbour to the smallest node of the neighbourhood.
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    large = (
        both.where("other > node")
        .join(least, "node")
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )
    # Small star: link a node and its smaller neighbours to the smallest of them.
    down = large.groupBy("high").agg(F.min("low").alias("least"))
    small = (
        large.join(down, "high")
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
        .where("high > low")
        .union(down.select("high", F.col("least").alias("low")))
        .distinct()
    )
    kept = staged(small, "components")
    return kept, kept.agg(F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``links`` (high, low).

    Links have ``high > low``; repeated links are harmless, no links give no rows. Each round
    is written to the shared folder. Neighbours are reduced to minima before any shuffle by
    node, so a node with very many links is no hot key.
    """
    current, before = links.select("high", "low").where("high > low").distinct(), None
    for _ in range(MAX_ROUNDS):
        current, state = _stars(current)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("low").alias("node")).distinct()
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
