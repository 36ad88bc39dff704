"""Data-quality checks. Each returns the rows that violate it; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ohlc import DAY, TOKEN


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def by_row(condition: Callable[..., Column]) -> Callable[..., DataFrame]:
    """A check of each row by itself: ``check(rows, ...)`` for the violations, ``check.where(...)`` for their condition."""

    @wraps(condition)
    def check(rows: DataFrame, *args: object, **named: object) -> DataFrame:
        return rows.filter(condition(*args, **named))

    check.where = condition
    return check


def duplicate_grain(rows: DataFrame, grain: Sequence[str], where: Column | None = None) -> DataFrame:
    found = rows if where is None else rows.filter(where)
    return found.groupBy(*grain).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def not_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull())


def unique(rows: DataFrame, column: str) -> DataFrame:
    return duplicate_grain(rows, [column], F.col(column).isNotNull())


def relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


@by_row
def outside_unit(columns: Sequence[str]) -> Column:
    """Rows with a price below 0 or above 1; null prices pass."""
    return _any([(F.col(c) < 0) | (F.col(c) > 1) for c in columns])


def freshness(loaded: DataFrame, column: str, now: datetime, warn_hours: int, error_hours: int) -> DataFrame:
    """The last load, its age in whole hours, and ``pass``, ``warn`` or ``error`` (also for an empty table)."""
    last = loaded.agg(F.max(column).alias("last_loaded_at"))
    age = F.timestamp_diff("HOUR", F.col("last_loaded_at"), F.lit(now).cast("timestamp_ntz"))
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") >= error_hours), "error").when(F.col("age_hours") >= warn_hours, "warn").otherwise("pass")
    return last.withColumn("age_hours", age.cast("long")).withColumn("status", status)


@by_row
def ohlc_order() -> Column:
    """Days whose prices or times are out of order, or without points."""
    low, high = F.col("low_price"), F.col("high_price")
    outside = [(F.col(c) < low) | (F.col(c) > high) for c in ("open_price", "close_price", "avg_price")]
    return _any([*outside, F.col("observed_points") < 1, F.col("first_timestamp") > F.col("last_timestamp")])


@by_row
def ohlc_bounds() -> Column:
    prices = ("open_price", "high_price", "low_price", "close_price", "avg_price")
    return _any([*((F.col(c) < 0) | (F.col(c) > 1) for c in prices), F.col("high_price") < F.col("low_price")])


@by_row
def price_without_time() -> Column:
    return F.col("price").isNotNull() & (F.col("odds_timestamp").isNull() | F.col("odds_timestamp_epoch").isNull())


@by_row
def negative(columns: Sequence[str]) -> Column:
    return _any([F.col(c) < 0 for c in columns])


@by_row
def date_order(first: str = "first_odds_date", last: str = "last_odds_date") -> Column:
    return F.col(first) > F.col(last)


@by_row
def odds_without_bounds() -> Column:
    """Markets with odds but without both dates, or with a date but without odds."""
    dates = F.col("first_odds_date").isNotNull() & F.col("last_odds_date").isNotNull()
    some = F.col("first_odds_date").isNotNull() | F.col("last_odds_date").isNotNull()
    return ((F.col("has_odds_data") == 1) & ~dates) | ((F.col("has_odds_data") == 0) & some)


@by_row
def odds_without_tokens() -> Column:
    return (F.col("has_odds_data") == 1) & (F.coalesce("token_count", F.lit(0)) < 1)


def rollup_mismatch(markets: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys (nulls equal) that one side lacks or whose values differ."""
    a, b = markets.alias("a"), recomputed.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    differ = _any([~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    joined = a.join(b, on, "full_outer").filter(differ)
    return joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *(F.col(f"{s}.{v}").alias(f"{v}_{n}") for v in values for s, n in (("a", "actual"), ("b", "expected"))))


@by_row
def http_counts() -> Column:
    return (F.col("http_429") > F.col("http_requests")) | (F.col("http_errors") > F.col("http_requests"))


@by_row
def planned_below_processed() -> Column:
    return F.col("planned_tokens") < F.col("processed_tokens")


@by_row
def ratio_mismatch(part: str, whole: str, ratio: str) -> Column:
    wanted = F.when(F.coalesce(F.col(whole), F.lit(0)) != 0, F.col(part).cast("double") / F.col(whole))
    null_differs = wanted.isNull() != F.col(ratio).isNull()
    return null_differs | F.coalesce(F.abs(wanted - F.col(ratio)) > 1e-9, F.lit(False))


@by_row
def coverage_disagreement() -> Column:
    """Tokens whose dates, flag and counts of observed days disagree."""
    has, days = F.col("has_daily_odds") == 1, F.col("token_days_observed")
    dated = F.col("first_odds_date").isNotNull() & F.col("last_odds_date").isNotNull()
    return (has != dated) | (has != (days > 0)) | F.coalesce(F.col("first_odds_date") > F.col("last_odds_date"), F.lit(False))


@by_row
def checked_above_count() -> Column:
    return F.col("market_fully_checked_tokens") > F.col("market_token_count")


@by_row
def checked_flag_wrong() -> Column:
    all_checked = (F.col("market_token_count") > 0) & (F.col("market_token_count") == F.col("market_fully_checked_tokens"))
    return F.col("market_fully_checked") != all_checked


def count_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with both counts if they differ."""
    n = a.agg(F.count("*").alias("n_left")).crossJoin(b.agg(F.count("*").alias("n_right")))  # one row each
    return n.filter("n_left <> n_right")


def days_mismatch(tokens: DataFrame, daily: DataFrame) -> DataFrame:
    """Tokens whose number of observed days isn't that of the daily rows."""
    counted = daily.filter(F.col(DAY).isNotNull()).groupBy(TOKEN).agg(F.count("*").alias("expected_days"))
    joined = tokens.select(TOKEN, "token_days_observed").join(counted, TOKEN, "full_outer")
    return joined.filter(F.coalesce("token_days_observed", F.lit(0)) != F.coalesce("expected_days", F.lit(0)))


def subset_mismatch(part: DataFrame, whole: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of ``part`` whose keys ``whole`` lacks or has with other values only: each row once, however often keys repeat."""
    keys, seen = list(keys), whole.select(*keys, F.col(value).alias("_value")).distinct()
    a, b = part.select(*keys, value).alias("a"), seen.alias("b")
    on = [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col(value).eqNullSafe(F.col("_value"))]
    differ = a.join(b, reduce(lambda x, y: x & y, on), "left_anti").select(*keys)
    there = seen.select(*keys, F.lit(True).alias("_there")).distinct()
    kind = F.when(F.col("_there").isNull(), "missing").otherwise("value_mismatch")
    return differ.join(there, keys, "left").select(*keys, kind.alias("mismatch_type"))


@by_row
def below_threshold(column: str, least: float) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0)) < least


def scope_mismatch(mart: DataFrame, expected: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that only the mart or only the expectation has, and keys whose values differ; each with its kind."""
    keys = list(keys)
    mart_only = mart.join(expected, keys, "left_anti").select(*keys, F.lit("mart_only").alias("mismatch_type"))
    expected_only = expected.join(mart, keys, "left_anti").select(*keys, F.lit("expected_only").alias("mismatch_type"))
    b = expected.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    differ = mart.join(b, keys).filter(_any([~F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values]))
    return mart_only.unionByName(expected_only).unionByName(differ.select(*keys, F.lit("value_mismatch").alias("mismatch_type")))
