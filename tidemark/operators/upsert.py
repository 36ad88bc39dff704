"""Merges of a table with new rows, as functions of DataFrames; ``sources.store`` publishes their results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key's rows the last by ``order`` (nulls first). One aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``old`` with new rows in place of those of equal key; of several new rows of a key the last by ``order``."""
    fresh = last_write_wins(new, keys, order).select(*old.columns)
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """A full outer merge; ``rules`` gives each other column from ``old.x`` and ``new.x``; ``_in_old``, ``_in_new`` tell
    where a row is from."""
    a = old.withColumn("_in_old", F.lit(True)).alias("old")
    b = new.withColumn("_in_new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = a.join(b, on, "full_outer")
    named = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys]
    return joined.select(*named, *(rule.alias(c) for c, rule in rules.items()))


def old_(name: str) -> Column:
    return F.col(f"old.{name}")


def new_(name: str) -> Column:
    return F.col(f"new.{name}")


def prefer_new(name: str) -> Column:
    return F.coalesce(new_(name), old_(name))


def replace(name: str) -> Column:
    """The new row's value, null or not, if there is a new row."""
    return F.when(F.col("_in_new"), new_(name)).otherwise(old_(name))


def merge_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str], replaced: Sequence[str]) -> DataFrame:
    """New values of ``kept`` unless null; values of ``replaced`` in any case."""
    return merged(old, new, keys, {c: prefer_new(c) for c in kept} | {c: replace(c) for c in replaced})


def merge_monotonic(old: DataFrame, new: DataFrame, key: str, cursor: str) -> DataFrame:
    """The larger cursor; the old row's other columns."""
    rules = {c: F.greatest(old_(c), new_(c)) if c == cursor else old_(c) for c in old.columns if c != key}
    return merged(old, new, [key], rules)


def merge_state(old: DataFrame, new: DataFrame, key: str = "clob_token_id") -> DataFrame:
    """Scheduler state: the larger cursor (null if both are), the latest check, a flag that stays once set. Tokens that
    are now fully checked lose their next check and their streak of empty runs."""
    done = F.coalesce(new_("fully_checked"), F.lit(False))
    rules = {
        "last_sync_timestamp": F.greatest(old_("last_sync_timestamp"), new_("last_sync_timestamp")),
        "fully_checked": F.coalesce(old_("fully_checked"), F.lit(False)) | done,
        "last_checked_at": prefer_new("last_checked_at"),
        "next_check_at": F.when(done, F.lit(None)).otherwise(prefer_new("next_check_at")),
        "empty_run_streak": F.when(done, 0).otherwise(F.coalesce(new_("empty_run_streak"), old_("empty_run_streak"), F.lit(0))),
    }
    return merged(old, new, [key], rules)


def merge_keep_created(old: DataFrame, new: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    """New values, but the time at which the row was first made."""
    return merged(old, new, [key], {c: F.coalesce(old_(c), new_(c)) if c == created else replace(c) for c in old.columns if c != key})


def merge_counter(old: DataFrame, failed: DataFrame, keys: Sequence[str], now: datetime, retry_hours: int) -> DataFrame:
    """Attempts counted up for failed keys, with the time of the next one, an hour ahead at least."""
    at = F.lit(now).cast("timestamp_ntz")
    retry = at + F.make_dt_interval(hours=F.lit(max(1, retry_hours)))
    hit = F.coalesce("_in_new", F.lit(False))
    rules = {
        "reason": replace("reason"),
        "attempts": F.coalesce(old_("attempts"), F.lit(0)) + F.when(hit, 1).otherwise(0),
        "last_checked_at": F.when(hit, at).otherwise(old_("last_checked_at")),
        "next_retry_at": F.when(hit, retry).otherwise(old_("next_retry_at")),
    }
    return merged(old, failed, keys, rules)


def set_flag(old: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag set for the given keys, rows made where there are none."""
    rules = {c: F.coalesce(F.col("_in_new"), old_(c)) if c == flag else old_(c) for c in old.columns if c != key}
    return merged(old, keys.select(key).distinct(), [key], rules)


def update_columns(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New values, where not null, of some columns of rows that there are."""
    given = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = old.join(given, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def append_history(old: DataFrame, new: DataFrame, key: str, history: str, limit: int = 20) -> DataFrame:
    """Arrays of entries with the new ones at the end, the last ``limit`` kept (all, if it isn't positive)."""
    none = F.array().cast(old.schema[history].dataType)
    longer = F.concat(F.coalesce(old_(history), none), F.coalesce(new_(history), none))
    kept = longer if limit <= 0 else F.when(F.size(longer) > limit, F.slice(longer, -limit, limit)).otherwise(longer)
    return merged(old, new, [key], {c: kept if c == history else replace(c) for c in old.columns if c != key})


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent there is."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def not_in(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is surely none of the others': nulls on either side could be any key, but not of no others."""
    known = others.agg(F.count("*").alias("_n"), F.count(key).alias("_n_known"))  # one row
    sure = (F.col("_n") == 0) | ((F.col("_n") == F.col("_n_known")) & F.col(key).isNotNull())
    return rows.join(others.select(key), key, "left_anti").join(F.broadcast(known)).filter(sure).drop("_n", "_n_known")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as often as they are more in one than in the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def changed_keys(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two snapshots, nulls and missing keys included."""
    a = before.select(key, F.col(value).alias("before"))
    b = after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
