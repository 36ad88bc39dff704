"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed


def components(pairs: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it reaches, for each id of the pairs (columns ``a`` and ``b``).

    Each round gives an id the smallest label among its neighbours and itself, then that label's own label, so that
    chains shorten by more than half; it ends when no label changes. Labels and pairs stay in Spark throughout.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        seen = labels.withColumnsRenamed({"id": "b", "component": "near"})
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        moved = checkpointed(
            lower.join(jump, "next").select("id", F.least("next", "jump").alias("component"), F.col("component").alias("was"))
        )
        labels = moved.select("id", "component")
        if moved.filter("component <> was").isEmpty():
            return labels
