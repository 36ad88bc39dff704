"""Missing market metadata: found by id, then in event payloads, else marked for a later retry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import iso_timestamp, json_text_list
from tidemark.operators.planning import event_markets, missing_metadata
from tidemark.operators.upsert import merge_counter, update_columns

FIELDS = ("tokens", "slug", "event_slug", "end_date")
REASON = "missing from market and event payloads"


@dataclass(frozen=True)
class Backfill:
    """What a backfill makes: ``markets`` with the values found, and ``unresolved`` with its new marks.

    ``found`` has a row for each eligible market: ``market_id``, whether it ``returned`` a payload, the values of the four
    fields, and ``fallback``, whether the event slug is an event payload's.
    """

    markets: DataFrame
    unresolved: DataFrame
    found: DataFrame

    def counts(self) -> DataFrame:
        """One row: eligible markets, values found for each field, those by fallback, and markets left unresolved."""
        has = lambda c: F.count_if(F.col(c).isNotNull())
        left = F.count_if(F.col("returned") & F.col("event_slug").isNull())
        return self.found.agg(F.count("*").alias("eligible"), *(has(f).alias(f) for f in FIELDS), F.count_if("fallback").alias("fallback"), left.alias("unresolved"))


def backfill(markets: DataFrame, payloads: DataFrame, events: DataFrame, unresolved: DataFrame, now: datetime, retry_hours: int = 168) -> Backfill:
    """Fill in markets that lack tokens, a slug, an event slug or an end date, except fields that wait for a retry.

    ``markets``: ``market_id``, ``clob_token_ids``, ``slug``, ``event_slug``, ``end_date``, and any others. ``payloads``: one for each
    market that was asked for by id. Every field that a payload has is taken, not only what was missing. Of the markets with
    a payload but no event slug in it, ``events`` are searched; what they lack, too, is marked ``event_slug`` in ``unresolved``
    until ``retry_hours`` after ``now``. Markets without a payload are left as they are, unmarked.
    """
    eligible = missing_metadata(markets, unresolved, now).select("market_id").distinct()
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    given = payloads.select(
        F.col("id").alias("market_id"),
        F.lit(True).alias("_returned"),
        F.when(F.size("clobTokenIds") > 0, json_text_list("clobTokenIds")).alias("tokens"),
        some("slug").alias("slug"),
        F.get("events", F.lit(0))["slug"].alias("_event_slug"),
        iso_timestamp(F.coalesce("endDate", "endDateIso")).alias("end_date"),
    ).dropDuplicates(["market_id"])
    first = eligible.join(given, "market_id", "left").withColumn("_event_slug", some("_event_slug"))
    returned = F.coalesce("_returned", F.lit(False))
    asked = first.filter(returned & F.col("_event_slug").isNull()).select("market_id")
    late = event_markets(events).select("market_id", some("event_slug").alias("_late")).join(asked, "market_id", "left_semi")
    joined = first.join(late, "market_id", "left")
    found = joined.select(
        "market_id",
        returned.alias("returned"),
        "tokens",
        "slug",
        F.coalesce("_event_slug", "_late").alias("event_slug"),
        "end_date",
        (F.col("_event_slug").isNull() & F.col("_late").isNotNull()).alias("fallback"),
    )
    filled = update_columns(markets, found.withColumnRenamed("tokens", "clob_token_ids"), "market_id", ["clob_token_ids", "slug", "event_slug", "end_date"])
    failed = found.filter("returned and event_slug is null").select("market_id", F.lit("event_slug").alias("field_name"), F.lit(REASON).alias("reason"))
    marks = merge_counter(unresolved, failed, ["market_id", "field_name"], now, retry_hours)
    return Backfill(filled, marks, found)
