"""Global order without a global task: numbers, running totals and pages of a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import kept


def numbered(rows: DataFrame, *order: Column | str, number: str = "number", total: str | None = None) -> DataFrame:
    """``rows`` with ``number``, from 1 in ``order``, which should tell all rows apart; ``total``: a column whose sum over
    the rows before a row is ``<total>_before``.

    Rows are dealt to ranges of the order and sorted there; one row for each range, with its size and sum, gives the ranges
    their offsets. So no task sees more than a range, however many rows there are.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = kept(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    value = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"), F.sum(value).alias("s")).orderBy("_part").collect()
    offsets, n, s = [], 0, 0
    for r in sizes:
        offsets.append((r["_part"], n, s))
        n, s = n + r["n"], s + r["s"]
    known = rows.sparkSession.createDataFrame(offsets, f"_part int, _n long, _s {'double' if isinstance(s, float) else 'long'}")
    joined = parts.join(F.broadcast(known), "_part")  # a row for each range
    made = joined.withColumn(number, F.col("_n") + F.col("_at") + 1)
    if total:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        made = made.withColumn(f"{total}_before", F.col("_s") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return made.drop("_part", "_at", "_n", "_s")


def paged(rows: DataFrame, size: int, *order: Column | str, page: str = "page") -> DataFrame:
    """``rows`` with the number, from 0, of the page of ``size`` rows that each is on."""
    if size < 1:
        raise ValueError("a page has at least one row")
    return numbered(rows, *order, number="_number").withColumn(page, F.floor((F.col("_number") - 1) / size).cast("long")).drop("_number")


def within_budget(rows: DataFrame, cost: str, budget: int, *order: Column | str) -> DataFrame:
    """The rows, in order, that a budget reaches, with ``spent_before`` and ``paid``: their cost, of the last maybe a part.

    ``cut``: whether the row's cost isn't wholly paid. Rows of no cost are reached while anything of the budget is left.
    """
    spent = numbered(rows, *order, number="_number", total=cost).withColumnRenamed(f"{cost}_before", "spent_before")
    left, full = F.lit(budget) - F.col("spent_before"), F.coalesce(F.col(cost), F.lit(0))
    return spent.filter(left > 0).withColumns({"paid": F.least(full, left), "cut": full > left}).drop("_number")
