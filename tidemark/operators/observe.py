"""Counts that tell how far a sync has come and what a scope admits."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import guarded_ratio, json_field
from tidemark.operators.ohlc import TOKEN
from tidemark.operators.scope import Scope, slug_in_scope
from tidemark.operators.upsert import upsert
from tidemark.sources.schemas import TABLES
from tidemark.sources.store import Store


def _distinct(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.countDistinct(TOKEN).alias(name))


def planning_ratios(tokens: DataFrame, history: DataFrame, daily: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: distinct tokens listed, observed, aggregated, in the ledger and fully checked, and each's share."""
    counts = (
        _distinct(tokens, "market_tokens")
        .crossJoin(_distinct(history, "history_tokens"))  # one row each
        .crossJoin(_distinct(daily, "daily_tokens"))
        .crossJoin(_distinct(ledger, "ledger_tokens"))
        .crossJoin(_distinct(ledger.filter("fully_checked"), "checked_tokens"))
    )
    names = ("history", "daily", "ledger", "checked")
    return counts.select("*", *(guarded_ratio(f"{n}_tokens", "market_tokens", 4).alias(f"{n}_ratio") for n in names))


def scope_audit(markets: DataFrame, registry: DataFrame, scope: Scope) -> DataFrame:
    """One row: markets, those in the registry, those that their slugs admit, and the latter that the registry lacks."""
    keys = registry.select("market_id").distinct().withColumn("_registered", F.lit(True))
    marked = markets.join(keys, "market_id", "left")
    registered, listed = F.col("_registered").isNotNull(), slug_in_scope("event_slug", scope)
    return marked.agg(
        F.count("*").alias("n_markets"),
        F.count_if(registered).alias("n_registered"),
        F.count_if(listed).alias("n_listed"),
        F.count_if(listed & ~registered).alias("n_listed_only"),
    )


def count_by_source(registry: DataFrame) -> DataFrame:
    """Rows and markets of each of a registry's sources; null counts as ``unknown``."""
    source = F.coalesce("source", F.lit("unknown")).alias("source")
    return registry.groupBy(source).agg(F.count("*").alias("n_rows"), F.countDistinct("market_id").alias("n_markets"))


def scope_audit_by_source(markets: DataFrame, registry: DataFrame, scope: Scope) -> DataFrame:
    """``scope_audit`` for each source, a market counting for every source that lists it; ``none`` for those of no source."""
    keys = registry.select("market_id", F.coalesce("source", F.lit("unknown")).alias("source")).distinct()
    marked = markets.join(keys, "market_id", "left")
    registered, listed = F.col("source").isNotNull(), slug_in_scope("event_slug", scope)
    return marked.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("n_markets"),
        F.count_if(registered & ~listed).alias("n_registered_only"),
        F.count_if(listed).alias("n_listed"),
        F.count_if(listed & ~registered).alias("n_listed_only"),
    )


def model_snapshot(spark: SparkSession, models: Mapping[str, str], read: Callable[[str], DataFrame]) -> DataFrame:
    """A row for each model (name and relation): whether it is there and its number of rows, or what failed.

    ``read`` gives a relation's rows. Counts read no column: of Parquet files the footers alone. All models that can be read
    are counted in one query.
    """
    rows, failed = [], []
    for name, relation in models.items():
        try:
            rows.append(read(relation).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("model"), F.lit(relation).alias("relation"), F.lit(True).alias("exists"), "row_count", F.lit(None).cast("string").alias("error")))
        except (PySparkException, LookupError, ValueError, RuntimeError) as e:  # a missing model is a row, not an end
            failed.append((name, relation, False, None, type(e).__name__))
    out = spark.createDataFrame(failed, "model string, relation string, exists boolean, row_count long, error string")
    return reduce(DataFrame.unionByName, rows, out)


RUNS, LAST_RUNS, NOTES = "ops.pipeline_run_events", "ops.sync_run_metrics", "ops.scrape_metadata"


def record_run(store: Store, run_id: str, task: str, at: datetime, metrics: Mapping[str, object], limit: int = 20) -> None:
    """Keep a run's metrics: as an event, as the task's last with a history of ``limit`` runs, and as a note of the last.

    Three commits: a run that dies between them leaves the event without the others, and ``last_run`` with the run before.
    """
    spark = store.spark
    text = json.dumps({**metrics, "timestamp": at.isoformat()}, sort_keys=True)
    store.append(RUNS, spark.createDataFrame([(run_id, task, at, text)], TABLES[RUNS]))
    old = store.read(LAST_RUNS)
    known = old.filter(F.col("task_name") == task).first()  # one row a task
    past = _objects(known["history_json"]) if known else []
    past = [*past, json.loads(text)]
    history = json.dumps(past[-limit:] if limit > 0 else past, sort_keys=True)
    new = spark.createDataFrame([(task, at, text, history)], TABLES[LAST_RUNS])
    store.overwrite(LAST_RUNS, upsert(old, new, ["task_name"], ["recorded_at"]).select(*old.columns))
    notes = spark.createDataFrame([(f"sync_metrics:{task}:last", text), (f"sync_metrics:{task}:history", history)], TABLES[NOTES])
    store.overwrite(NOTES, upsert(store.read(NOTES), notes, ["key"], ["value"]).select(*notes.columns))


def _objects(text: str | None) -> list[dict]:
    """The objects of a JSON list; none of other text."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return []
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def last_run(store: Store, task: str) -> dict | None:
    """The metrics of a task's last run; from the note where its row is missing or isn't an object, None without both."""
    texts = [r["metrics_json"] for r in store.read(LAST_RUNS).filter(F.col("task_name") == task).collect()]  # one row a task
    texts += [r["value"] for r in store.read(NOTES).filter(F.col("key") == f"sync_metrics:{task}:last").collect()]
    return next((x[0] for t in texts if (x := _objects(f"[{t}]"))), None)


def key_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side: ``left`` or ``right``."""
    one = lambda x, y, side: x.select(key).distinct().join(y, key, "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def tag_counts(events: DataFrame, tags: str = "tags") -> DataFrame:
    """Distinct events of each tag (columns ``id`` and an array of tags)."""
    return events.select("id", F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("n_events"))


def read_run(metrics: DataFrame, task: str, fields: dict[str, str]) -> DataFrame:
    """The last run of a task with typed leaves of its metrics; leaves that are missing or of another type are null."""
    last = metrics.filter(F.col("task_name") == task).orderBy(F.desc_nulls_last("recorded_at")).limit(1)
    return last.select("task_name", "recorded_at", *(json_field("metrics_json", f"$.{n}", t).alias(n) for n, t in fields.items()))
