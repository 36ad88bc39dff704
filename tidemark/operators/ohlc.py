"""Daily open/high/low/close of price observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import day_gap, epoch_day

TOKEN, EPOCH, DAY = "clob_token_id", "odds_timestamp_epoch", "odds_date_utc"


def daily_ohlc(history: DataFrame) -> DataFrame:
    """One row for each token and UTC day of observations (token, epoch second, price), in one aggregation.

    Of observations of one second the smaller price is the earlier. Rows without token, time or price are left out.
    """
    seen = history.filter(f"{TOKEN} is not null and {EPOCH} is not null and price is not null")
    when = F.struct(EPOCH, "price")
    days = seen.withColumn(DAY, epoch_day(EPOCH)).groupBy(TOKEN, DAY)
    return days.agg(
        F.min_by("price", when).alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", when).alias("close_price"),
        F.least(F.max("price"), F.greatest(F.min("price"), F.round(F.avg("price"), 8))).alias("avg_price"),
        F.count("*").alias("observed_points"),
        F.min(EPOCH).alias("first_timestamp"),
        F.max(EPOCH).alias("last_timestamp"),
    )


def dirty_days(written: DataFrame) -> DataFrame:
    """The token-days that newly written observations touch."""
    return written.select(TOKEN, epoch_day(EPOCH).alias(DAY)).filter(f"{TOKEN} is not null and {DAY} is not null").distinct()


def refresh_days(daily: DataFrame, history: DataFrame, dirty: DataFrame) -> DataFrame:
    """``daily`` with the dirty token-days computed anew from the canonical history; days without history go."""
    stale = dirty.select(TOKEN, DAY).distinct()
    touched = history.withColumn(DAY, epoch_day(EPOCH)).join(stale, [TOKEN, DAY], "left_semi")
    fresh = daily_ohlc(touched.select(*history.columns))
    return daily.join(stale, [TOKEN, DAY], "left_anti").unionByName(fresh, allowMissingColumns=True)


def token_coverage_days(daily: DataFrame) -> DataFrame:
    """Days and points observed of each token, and the first and last day."""
    return daily.filter(F.col(DAY).isNotNull()).groupBy(TOKEN).agg(
        F.min(DAY).alias("first_odds_date"),
        F.max(DAY).alias("last_odds_date"),
        F.count("*").alias("token_days_observed"),
        F.sum("observed_points").cast("long").alias("sum_observed_points"),
    )


def gap_diagnostics(daily: DataFrame) -> DataFrame:
    """Longest and mean gap between a token's observed days; its first day counts 0 for the longest, not for the mean."""
    from pyspark.sql import Window

    before = F.lag(DAY).over(Window.partitionBy(TOKEN).orderBy(DAY))
    gaps = daily.filter(F.col(DAY).isNotNull()).select(TOKEN, day_gap(before, DAY).alias("gap"))
    return gaps.groupBy(TOKEN).agg(
        F.max(F.coalesce("gap", F.lit(0))).cast("long").alias("max_gap_days"),
        F.coalesce(F.avg(F.nullif("gap", F.lit(0))), F.lit(0.0)).alias("avg_gap_days"),
    )
