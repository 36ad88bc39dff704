"""Schemas and keys of the raw and operational tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bigint": T.LongType(), "int": T.IntegerType(), "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """A schema of plain columns; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


TABLES = {
    "raw.markets": _schema(
        "id string, question string, category string, description string, outcomes string, volume double, active boolean, "
        "closed boolean, created_at timestamp_ntz, scraped_at timestamp_ntz, end_date timestamp_ntz, slug string, "
        "event_slug string, event_id string"
    ),
    "raw.market_tokens": _schema("market_id string, clobTokenIds string, updated_at timestamp_ntz"),
    "raw.odds_history": _schema("clobTokenId string, timestamp bigint, price double, ingested_at timestamp_ntz"),
    "raw.token_odds_daily": _schema(
        "clobTokenId string, odds_date_utc date, open_price double, high_price double, low_price double, close_price double, "
        "avg_price double, observed_points bigint, first_timestamp bigint, last_timestamp bigint, refreshed_at timestamp_ntz"
    ),
    "ops.token_sync_ledger": _schema(
        "clobTokenId string, last_sync_timestamp bigint, fully_checked boolean, last_checked_at timestamp_ntz, "
        "next_check_at timestamp_ntz, empty_run_streak int"
    ),
    "ops.token_sync_skips": _schema("clobTokenId string, reason string, created_at timestamp_ntz"),
    "ops.market_metadata_unresolved": _schema(
        "market_id string, field_name string, reason string, attempts int, last_checked_at timestamp_ntz, next_retry_at timestamp_ntz"
    ),
    "ops.pipeline_run_events": _schema("run_id string, task_name string, recorded_at timestamp_ntz, metrics_json string"),
    "ops.sync_run_metrics": _schema("task_name string, recorded_at timestamp_ntz, metrics_json string, history_json string"),
    "ops.market_registry": _schema("market_id string, event_slug string, event_id string, source string, refreshed_at timestamp_ntz"),
    "ops.scrape_metadata": _schema("key string, value string"),
}

KEYS = {
    "raw.markets": ["id"],
    "raw.market_tokens": ["market_id"],
    "raw.odds_history": ["clobTokenId", "timestamp"],
    "raw.token_odds_daily": ["clobTokenId", "odds_date_utc"],
    "ops.token_sync_ledger": ["clobTokenId"],
    "ops.token_sync_skips": ["clobTokenId"],
    "ops.market_metadata_unresolved": ["market_id", "field_name"],
    "ops.pipeline_run_events": ["run_id"],
    "ops.sync_run_metrics": ["task_name"],
    "ops.market_registry": ["market_id"],
    "ops.scrape_metadata": ["key"],
}

#: Payload of a market as the API lands it, as JSON lines.
MARKET_PAYLOAD = (
    "id string, question string, category string, description string, outcomes array<string>, volumeNum string, active boolean, "
    "closed boolean, createdAt string, endDate string, endDateIso string, clobTokenIds array<string>, slug string, "
    "events array<struct<id:string,slug:string>>"
)
EVENT_PAYLOAD = (
    "row_order bigint, id string, slug string, tags array<struct<slug:string>>, "
    "markets array<struct<id:string,question:string,volumeNum:string,slug:string,clobTokenIds:array<string>>>"
)
