"""Verification of a rebuilt table before it takes the place of the old one, and retention cuts with a dry run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ohlc import EPOCH
from tidemark.sources.store import Store, StoreError

_ROW = "kind string, name string, n long"


def rebuild_violations(old: DataFrame, new: DataFrame, key: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """What tells a rebuilt table from the old one: rows of ``kind``, ``name`` and a number ``n``; none if nothing does.

    ``schema``: columns that one side lacks or has with another type (n: 1 if the old side has it). ``null``: rows without
    a value in a key or required column. ``duplicate``: keys of several rows, by the key's columns. ``lost`` and ``added``:
    rows that the old or the new table has more often, repeats counted; only where both have the same columns.
    """
    spark = old.sparkSession
    a, b = dict(old.dtypes), dict(new.dtypes)
    differ = [("schema", c, int(c in a)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]
    out = spark.createDataFrame(differ, _ROW)
    there = [c for c in dict.fromkeys([*key, *required]) if c in b]
    if there:
        # One aggregate for all columns, then a row for each that has nulls.
        counts = new.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in there))
        listed = counts.select(F.explode(F.create_map(*(x for c in there for x in (F.lit(c), F.col(c))))).alias("name", "n"))
        out = out.unionByName(listed.filter("n > 0").select(F.lit("null").alias("kind"), "name", F.col("n").cast("long").alias("n")))
    if key and all(c in b for c in key):
        twice = new.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).filter("n > 0")
        out = out.unionByName(twice.select(F.lit("duplicate").alias("kind"), F.lit(",".join(key)).alias("name"), "n"))
    if a == b:
        # Counts of equal rows with opposite signs: both differences from one shuffle.
        signed = old.withColumn("_n", F.lit(1)).unionByName(new.withColumn("_n", F.lit(-1)))
        more = signed.groupBy(*old.columns).agg(F.sum("_n").alias("_n"))
        sums = more.agg(F.sum(F.greatest("_n", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("added"))
        listed = sums.select(F.explode(F.create_map(F.lit("lost"), "lost", F.lit("added"), "added")).alias("kind", "n")).filter("n > 0")
        out = out.unionByName(listed.select("kind", F.lit("rows").alias("name"), F.col("n").cast("long").alias("n")))
    return out


def exchange(store: Store, name: str, new: DataFrame, key: Sequence[str], required: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """The new rows in place of a table, unless they differ from it in anything that ``rebuild_violations`` finds."""
    found = rebuild_violations(store.read(name, new.schema), new, key, required).limit(20).collect()  # few rows by nature
    if found:
        raise StoreError(f"{name} isn't exchanged: {[tuple(r) for r in found]}")
    return store.overwrite(name, new, by)


def cutoff_epoch(now: datetime, days: int) -> int:
    """The first second that is kept; ``now`` is in UTC."""
    if days <= 0:
        raise ValueError("days of retention must be above 0")
    return int((now - timedelta(days=days)).replace(tzinfo=timezone.utc).timestamp())


def retained(history: DataFrame, now: datetime, days: int) -> DataFrame:
    """The observations of the last ``days``; those without a time are kept, as nothing says that they are old."""
    return history.filter(F.coalesce(F.col(EPOCH) >= cutoff_epoch(now, days), F.lit(True)))


def retention_counts(history: DataFrame, now: datetime, days: int, dry_run: bool = True) -> DataFrame:
    """One row of what a cut deletes: ``cutoff_epoch``, ``total_before``, ``deleted``, ``remaining``; all remain in a dry run."""
    limit = cutoff_epoch(now, days)
    counts = history.agg(F.count("*").alias("total_before"), F.count_if(F.col(EPOCH) < limit).alias("deleted"))
    left = F.col("total_before") if dry_run else F.col("total_before") - F.col("deleted")
    return counts.select(F.lit(limit).cast("long").alias("cutoff_epoch"), "total_before", "deleted", left.alias("remaining"))


def prune(store: Store, name: str, now: datetime, days: int, by: str, dry_run: bool = False) -> dict[str, int]:
    """Cut a table in parts by day: whole parts that are too old are named no more, the one at the edge is written again.

    Returns the counts of ``retention_counts``; a dry run changes nothing.
    """
    history = store.read(name)
    counts = retention_counts(history, now, days, dry_run).first().asDict()
    if dry_run or not counts["deleted"]:
        return counts
    old = [r[0] for r in history.filter(F.col(EPOCH) < counts["cutoff_epoch"]).select(by).distinct().collect()]  # a row a day
    store.replace(name, retained(store.read(name, history.schema, old), now, days), by, old)
    return counts
