"""Intake of rows with counted drops: what is refused is counted by reason in the write that takes the rest."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.scalar import col

#: Reasons for which an observation is refused, the first that holds deciding; a row of null or NaN fails its rule.
OBSERVATION_RULES: dict[str, Callable[[], Column]] = {
    "no_token": lambda: F.col("clob_token_id").isNotNull(),
    "invalid_ts": lambda: F.col("odds_timestamp_epoch") > 0,
    "invalid_price": lambda: (F.col("price") >= 0) & (F.col("price") <= 1),
}


def judged(rows: DataFrame, rules: Mapping[str, Callable[[], Column]] = OBSERVATION_RULES, name: str = "reason") -> DataFrame:
    """``rows`` with the first rule that each breaks, null for those that keep all."""
    out = F.lit(None).cast("string")
    for reason, keeps in reversed(rules.items()):
        out = F.when(F.coalesce(keeps(), F.lit(False)), out).otherwise(F.lit(reason))
    return rows.withColumn(name, out)


class Drops:
    """Counts of ``judged`` rows, taken by whichever action runs first over ``kept``: no pass of their own.

    ``kept``: the rows without a reason. ``refused``: the others, with it, for a second sink; a caller that writes both
    persists the judged rows, or reads the source twice.
    """

    def __init__(self, rows: DataFrame, rules: Mapping[str, Callable[[], Column]] = OBSERVATION_RULES, name: str = "reason") -> None:
        self.reasons, self._seen = tuple(rules), Observation()
        counts = [F.count_if(F.coalesce(F.col(name) == r, F.lit(False))).alias(r) for r in self.reasons]
        seen = rows.observe(self._seen, F.count("*").alias("rows"), F.count_if(F.col(name).isNull()).alias("kept"), *counts)
        self.kept = seen.filter(F.col(name).isNull()).drop(name)
        self.refused = rows.filter(F.col(name).isNotNull())

    def counts(self) -> dict[str, int]:
        """``rows``, ``kept`` and each reason's number; waits for the action that counts."""
        return {k: int(v) for k, v in self._seen.get.items()}


class Referred:
    """Rows whose ``key`` the ``parents`` have, and how many had none: both counted in the action that runs over ``kept``.

    The count is taken behind the join, so that it stays in the plan where Spark finds one side empty at run time.
    """

    def __init__(self, rows: DataFrame, parents: DataFrame, key: str) -> None:
        self._seen = Observation()
        known = parents.select(col(key)).distinct().withColumn("_known", F.lit(True))
        joined = rows.join(known, key, "left").observe(self._seen, F.count("*").alias("rows"), F.count("_known").alias("kept"))
        self.kept = joined.filter("_known").select(*rows.columns)
        self.refused = rows.join(known, key, "left_anti")

    def counts(self) -> dict[str, int]:
        try:
            rows, kept = int(self._seen.get["rows"]), int(self._seen.get["kept"])
        except Py4JJavaError:  # of no rows at all Spark may leave no plan that counts
            rows = kept = 0
        return {"rows": rows, "kept": kept, "orphans": rows - kept}
