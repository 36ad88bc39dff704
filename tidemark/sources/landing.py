"""Shaping of landed API payloads (JSON lines read with an explicit schema) into raw tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import first_of, iso_timestamp, json_text_list
from tidemark.operators.upsert import last_write_wins
from tidemark.sources.schemas import EVENT_PAYLOAD, MARKET_PAYLOAD, TABLES
from tidemark.sources.store import ContractError, Store, checked


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """Market payloads; keys that the schema doesn't know are not read, lines that are no objects are null rows."""
    return spark.read.schema(MARKET_PAYLOAD).json(path).filter("id is not null")


def parsed_markets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Market payloads that came as texts, as ``read_markets`` reads them from files; what is no object is left out."""
    return lines.select(F.from_json(column, MARKET_PAYLOAD).alias("p")).select("p.*").filter("id is not null")


def load_stage(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """A stage table with exactly these rows, under its strict contract. No rows at all are an error, and leave it as it was."""
    if checked(rows, TABLES[name]).isEmpty():
        raise ContractError(f"no rows for {name}")
    return store.overwrite(name, rows)


def bootstrap(store: Store) -> list[str]:
    """Make the tables that there aren't, empty; again, it makes none. Returns the names of those it made."""
    made = [name for name in TABLES if not store.exists(name)]
    for name in made:
        store.overwrite(name, store.spark.createDataFrame([], TABLES[name]))
    return made


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event payloads, of an event's pages the first."""
    rows = spark.read.schema(EVENT_PAYLOAD).json(path).filter("id is not null")
    rest = [c for c in rows.columns if c != "id"]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rest), "row_order").alias("f"))
    return first.select("id", "f.*").select(*rows.columns)


def shape_markets(payloads: DataFrame, now: datetime) -> DataFrame:
    """Payloads as rows of ``raw.markets`` with ``clob_token_ids`` as JSON; defaults for what is missing."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return payloads.select(
        "id",
        text("question").alias("question"),
        text("category").alias("category"),
        text("description").alias("description"),
        json_text_list(F.coalesce("outcomes", F.array().cast("array<string>"))).alias("outcomes"),
        F.coalesce(F.col("volumeNum").try_cast("double"), F.lit(0.0)).alias("volume"),
        F.coalesce("active", F.lit(False)).alias("active"),
        F.coalesce("closed", F.lit(False)).alias("closed"),
        iso_timestamp("createdAt").alias("created_at"),
        F.lit(now).cast("timestamp_ntz").alias("scraped_at"),
        iso_timestamp(F.coalesce("endDate", "endDateIso")).alias("end_date"),
        "slug",
        first_of("events", "slug").alias("event_slug"),
        first_of("events", "id").alias("event_id"),
        json_text_list("clobTokenIds").alias("clob_token_ids"),
    )


def split_tokens(shaped: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows of ``raw.markets`` and of ``raw.market_tokens``; markets without tokens have none of the latter."""
    listed = shaped.filter("clob_token_ids is not null and clob_token_ids <> '[]'")
    tokens = listed.select(F.col("id").alias("market_id"), F.col("clob_token_ids").alias("clobTokenIds"), F.lit(now).cast("timestamp_ntz").alias("updated_at"))
    return shaped.drop("clob_token_ids"), tokens


def last_payloads(rows: DataFrame, order: str) -> DataFrame:
    """Of each market's payloads the last that arrived."""
    return last_write_wins(rows, ["id"], [order])


def resolve_metadata(markets: DataFrame, payloads: DataFrame) -> DataFrame:
    """Markets with slug, event slug and end date filled in from payloads where they are null."""
    found = payloads.select(
        F.col("id").alias("_id"), F.col("slug").alias("_slug"), first_of("events", "slug").alias("_event_slug"),
        iso_timestamp(F.coalesce("endDate", "endDateIso")).alias("_end_date"),
    )
    joined = markets.join(found, markets["id"] == found["_id"], "left")
    filled = {c: F.coalesce(c, f"_{c}") for c in ("slug", "event_slug", "end_date")}
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in markets.columns))
