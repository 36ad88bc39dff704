"""Models as functions of earlier ones, in a registry that builds them in order and checks them.

A model takes a ``Catalog``-like mapping of DataFrames by name. Nothing is computed until a result is asked for, except
models marked as tables, which ``build`` writes through the store it is given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_to_timestamp, guarded_ratio, json_leaves, json_list
from tidemark.operators import quality
from tidemark.operators.observe import model_snapshot
from tidemark.operators.ohlc import TOKEN, gap_diagnostics, token_coverage_days
from tidemark.operators.scope import BIG_VOLUME, Scope, volume_band, with_scope

Frames = Mapping[str, DataFrame]
Check = Callable[[DataFrame, Frames], DataFrame]

MARKET_COLUMNS = (
    "market_id", "question", "category", "description", "outcomes", "volume", "is_active", "is_closed", "created_at",
    "scraped_at", "end_date", "slug", "event_slug", "event_id",
)

#: The columns of a run's metrics, where each lies in the JSON text, and its type.
RUN_FIELDS = [
    ("is_noop", "$.noop", "boolean"),
    ("duration_seconds", "$.duration_seconds", "double"),
    ("final_rps", "$.final_rps", "double"),
    ("token_rate", "$.token_rate", "double"),
    ("row_rate", "$.row_rate", "double"),
    ("processed_tokens", "$.tokens", "bigint"),
    ("windows_processed", "$.windows", "bigint"),
    ("rows_fetched", "$.rows", "bigint"),
    ("empty_tokens", "$.empty", "bigint"),
    ("error_tokens", "$.errors", "bigint"),
    ("permanent_error_tokens", "$.permanent_errors", "bigint"),
    ("invalid_tokens", "$.invalid_tokens", "bigint"),
    ("saved_rows", "$.saved_rows", "bigint"),
    ("saved_daily_rows", "$.saved_daily_rows", "bigint"),
    ("sync_updates", "$.sync_updates", "bigint"),
    ("queue_high_watermark", "$.queue_high_watermark", "bigint"),
    ("http_requests", "$.http_requests", "bigint"),
    ("http_429", "$.http_429", "bigint"),
    ("http_errors", "$.http_errors", "bigint"),
    ("planned_tokens", "$.planning.plans", "bigint"),
    ("pre_clob_markets", "$.planning.pre_clob_markets", "bigint"),
    ("invalid_tokens_from_planning", "$.planning.invalid_token", "bigint"),
    ("closed_done_tokens", "$.planning.closed_done", "bigint"),
    ("persisted_skip_tokens", "$.planning.persisted_skip", "bigint"),
    ("recent_skip_tokens", "$.planning.recent_skip", "bigint"),
    ("empty_cache_skip_tokens", "$.planning.empty_cache_skip", "bigint"),
    ("already_current_tokens", "$.planning.already_current", "bigint"),
    ("duplicate_tokens", "$.planning.dup_token", "bigint"),
    ("market_tokens_distinct_tokens", "$.planning_context.market_tokens_distinct_tokens", "bigint"),
    ("odds_history_distinct_tokens", "$.planning_context.odds_history_distinct_tokens", "bigint"),
    ("token_odds_daily_distinct_tokens", "$.planning_context.token_odds_daily_distinct_tokens", "bigint"),
    ("ledger_distinct_tokens", "$.planning_context.ledger_distinct_tokens", "bigint"),
    ("ledger_fully_checked_tokens", "$.planning_context.ledger_fully_checked_tokens", "bigint"),
    ("token_sync_skips_distinct_tokens", "$.planning_context.token_sync_skips_distinct_tokens", "bigint"),
    ("market_tokens_without_history", "$.planning_context.market_tokens_without_history", "bigint"),
    ("history_tokens_without_market_tokens", "$.planning_context.history_tokens_without_market_tokens", "bigint"),
    ("planned_vs_market_tokens_ratio", "$.planning_context.planned_vs_market_tokens", "double"),
    ("history_coverage_vs_market_tokens_ratio", "$.planning_context.history_coverage_vs_market_tokens", "double"),
    ("daily_coverage_vs_market_tokens_ratio", "$.planning_context.daily_coverage_vs_market_tokens", "double"),
    ("ledger_coverage_vs_market_tokens_ratio", "$.planning_context.ledger_coverage_vs_market_tokens", "double"),
    ("fully_checked_vs_market_tokens_ratio", "$.planning_context.fully_checked_vs_market_tokens", "double"),
]


def stg_markets(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed({"id": "market_id"})
    flags = {"is_active": F.col("active").cast("boolean"), "is_closed": F.col("closed").cast("boolean")}
    return named.withColumns(flags).select(*MARKET_COLUMNS)


def stg_market_tokens(raw: DataFrame) -> DataFrame:
    """A row for each element of a market's JSON list of tokens; empty, null and malformed lists give none."""
    rows = raw.select("market_id", "updated_at", F.posexplode(json_list("clobTokenIds")).alias("outcome_index", TOKEN))
    return rows.select("market_id", "outcome_index", "updated_at", TOKEN)


def stg_odds(raw: DataFrame) -> DataFrame:
    named = raw.select(F.col("clobTokenId").alias(TOKEN), F.col("timestamp").alias("odds_timestamp_epoch"), "price", "ingested_at")
    return named.withColumn("odds_timestamp", epoch_to_timestamp("odds_timestamp_epoch"))


def stg_odds_daily(raw: DataFrame) -> DataFrame:
    named = raw.withColumnRenamed("clobTokenId", TOKEN)
    times = {"first_observed_at": epoch_to_timestamp("first_timestamp"), "last_observed_at": epoch_to_timestamp("last_timestamp")}
    return named.withColumns(times)


def stg_sync_ledger(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("clobTokenId").alias(TOKEN),
        "last_sync_timestamp",
        "last_checked_at",
        "next_check_at",
        F.col("fully_checked").cast("boolean").alias("is_fully_checked"),
        epoch_to_timestamp("last_sync_timestamp").alias("last_sync_at"),
        F.coalesce("empty_run_streak", F.lit(0)).alias("empty_run_streak"),
    )


def stg_token_sync_skips(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("clobTokenId").alias(TOKEN), "reason", "created_at")


def stg_pipeline_run_events(raw: DataFrame) -> DataFrame:
    """Runs with the typed leaves of their metrics; leaves that are missing or of another type are null."""
    parsed = raw.select("run_id", "task_name", "recorded_at", "metrics_json", json_leaves("metrics_json", [p for _, p, _ in RUN_FIELDS]).alias("_m"))
    leaves = [F.col("_m" + path[1:]).try_cast(kind).alias(alias) for alias, path, kind in RUN_FIELDS]
    return parsed.select("run_id", "task_name", "recorded_at", "metrics_json", *leaves)


def int_token_universe(markets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens with their market and the label of their outcome."""
    joined = tokens.withColumnRenamed("updated_at", "token_updated_at").join(markets, "market_id")
    label = F.get(json_list("outcomes"), F.col("outcome_index"))
    return joined.select(
        "market_id", "outcome_index", TOKEN, "token_updated_at", "question", "event_slug", "is_active", "is_closed",
        F.col("volume").alias("market_volume_usd"), label.alias("outcome_label"),
    )


def int_scoped_markets(markets: DataFrame, registry: DataFrame, scope: Scope) -> DataFrame:
    marked = with_scope(markets, registry, scope, "is_target")
    return marked.filter("is_target").select(*MARKET_COLUMNS, "is_target")


def int_scoped_universe(universe: DataFrame, scoped: DataFrame) -> DataFrame:
    kept = universe.join(scoped.select("market_id"), "market_id", "left_semi")
    return kept.select(
        "market_id", "outcome_index", TOKEN, "token_updated_at", "question", "outcome_label", "event_slug", "is_active",
        "is_closed", "market_volume_usd",
    )


_SERIES = ("market_id", "outcome_index", TOKEN, "question", "event_slug", "is_active", "is_closed")


def int_token_timeseries(universe: DataFrame, odds: DataFrame) -> DataFrame:
    """All tokens with their observations; a token without any once, with nulls."""
    joined = universe.join(odds, TOKEN, "left")
    return joined.select(*_SERIES, "odds_timestamp", "odds_timestamp_epoch", "price")


_DAILY = (
    "odds_date_utc", "open_price", "high_price", "low_price", "close_price", "avg_price", "observed_points",
    "first_timestamp", "first_observed_at", "last_timestamp", "last_observed_at",
)


def int_token_daily_timeseries(universe: DataFrame, daily: DataFrame) -> DataFrame:
    return universe.join(daily, TOKEN, "left").select(*_SERIES, *_DAILY)


_MART = ("market_id", "outcome_index", TOKEN, "question", "outcome_label", "event_slug", "is_active", "is_closed", "market_volume_usd")


def scoped_minutely_odds(scoped: DataFrame, series: DataFrame) -> DataFrame:
    seen = series.filter("price is not null and odds_timestamp_epoch is not null")
    joined = scoped.join(seen.select(TOKEN, "odds_timestamp", "odds_timestamp_epoch", "price"), TOKEN)
    return joined.select(*_MART, "odds_timestamp", "odds_timestamp_epoch", "price")


def whale_minutely_odds(minutely: DataFrame, least: float = BIG_VOLUME) -> DataFrame:
    return minutely.filter(volume_band("market_volume_usd", least=least))


def scoped_daily_odds(scoped: DataFrame, daily_series: DataFrame) -> DataFrame:
    seen = daily_series.filter("odds_date_utc is not null").select(TOKEN, *_DAILY)
    return scoped.join(seen, TOKEN).select(*_MART, *_DAILY)


def scoped_markets_mart(scoped: DataFrame) -> DataFrame:
    return scoped.select(
        "market_id", "question", "description", "category", "outcomes", "volume", "is_active", "is_closed", "created_at",
        "scraped_at", "end_date", "slug", "event_slug",
    )


def market_health(universe: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tokens of each market, and how many of them are fully checked."""
    joined = universe.select("market_id", TOKEN).join(ledger.select(TOKEN, "is_fully_checked"), TOKEN, "left")
    checked = F.sum(F.when(F.col("is_fully_checked"), 1).otherwise(0)).cast("long")
    return joined.groupBy("market_id").agg(F.count("*").alias("market_token_count"), checked.alias("market_fully_checked_tokens"))


def token_coverage(universe: DataFrame, daily_series: DataFrame, ledger: DataFrame, skips: DataFrame) -> DataFrame:
    """A row for each token: what was observed of it, its gaps, its sync state and its market's.

    The right sides are unique on their keys, and coverage and gaps share one partitioning by token.
    """
    skipped = skips.select(TOKEN, F.col("reason").alias("skip_reason"), F.col("created_at").alias("skip_created_at"))
    tokens = universe.select("market_id", "outcome_index", TOKEN, "question", "event_slug", "is_active", "is_closed")
    joined = (
        tokens.join(token_coverage_days(daily_series), TOKEN, "left")
        .join(ledger, TOKEN, "left")
        .join(skipped, TOKEN, "left")
        .join(gap_diagnostics(daily_series), TOKEN, "left")
        .join(market_health(universe, ledger), "market_id", "left")
    )
    none = F.lit(0).cast("long")
    count, checked = F.coalesce("market_token_count", none), F.coalesce("market_fully_checked_tokens", none)
    return joined.select(
        TOKEN, "market_id", "outcome_index", "question", "event_slug", "is_active", "is_closed", "first_odds_date",
        "last_odds_date", "is_fully_checked", "last_sync_timestamp", "last_sync_at", "last_checked_at", "next_check_at",
        "empty_run_streak", "skip_reason", "skip_created_at",
        F.col("skip_reason").isNotNull().alias("has_persisted_skip"),
        F.coalesce("max_gap_days", none).alias("max_gap_days"),
        F.coalesce("avg_gap_days", F.lit(0.0)).alias("avg_gap_days"),
        count.alias("market_token_count"),
        checked.alias("market_fully_checked_tokens"),
        F.coalesce("token_days_observed", none).alias("token_days_observed"),
        F.coalesce("sum_observed_points", none).alias("sum_observed_points"),
        ((count > 0) & (count == checked)).alias("market_fully_checked"),
        F.when(F.coalesce("token_days_observed", none) > 0, 1).otherwise(0).alias("has_daily_odds"),
    )


def market_coverage(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("market_id", "question", "event_slug").agg(
        F.count("*").alias("token_count"),
        F.sum("token_days_observed").cast("long").alias("token_days_observed"),
        F.min("first_odds_date").alias("first_odds_date"),
        F.max("last_odds_date").alias("last_odds_date"),
        F.max("has_daily_odds").alias("has_odds_data"),
    )


SYNC_TASKS = ("sync_odds", "reconcile_odds_ledger")


def run_observability(runs: DataFrame) -> DataFrame:
    kept = runs.filter(F.col("task_name").isin(*SYNC_TASKS))
    fields = [alias for alias, _, _ in RUN_FIELDS]
    ratio = guarded_ratio("rows_fetched", "processed_tokens").alias("rows_per_processed_token")
    return kept.select("run_id", "task_name", "recorded_at", *fields, ratio)


@dataclass(frozen=True)
class Model:
    """A relation, the ones it is made of, and its checks by name. ``table``: written when built."""

    name: str
    layer: str
    needs: Sequence[str]
    make: Callable[..., DataFrame]
    grain: Sequence[str] = ()
    table: bool = False
    checks: Mapping[str, Check] = field(default_factory=dict)


@dataclass(frozen=True)
class RowCheck:
    """A check of each row by itself; those of one model are counted in one pass. ``where``: the violations' condition."""

    where: Callable[[], Column]

    def __call__(self, rows: DataFrame, frames: Frames) -> DataFrame:
        return rows.filter(self.where())


def models(scope: Scope, whale: float = BIG_VOLUME) -> list[Model]:
    """All models, each after those it needs."""
    series_checks = {"price_requires_timestamps": RowCheck(quality.price_without_time.where)}
    unit = {"unit_prices": RowCheck(lambda: quality.outside_unit.where(["price"]))}
    return [
        Model("stg_markets", "staging", ["raw.markets"], stg_markets, ["market_id"]),
        Model("stg_market_tokens", "staging", ["raw.market_tokens"], stg_market_tokens, ["market_id", "outcome_index"]),
        Model("stg_odds", "staging", ["raw.odds_history"], stg_odds, [TOKEN, "odds_timestamp_epoch"], checks=unit),
        Model("stg_odds_daily", "staging", ["raw.token_odds_daily"], stg_odds_daily, [TOKEN, "odds_date_utc"],
              checks={"ohlc_order": RowCheck(quality.ohlc_order.where), "ohlc_bounds": RowCheck(quality.ohlc_bounds.where)}),
        Model("stg_sync_ledger", "staging", ["ops.token_sync_ledger"], stg_sync_ledger, [TOKEN]),
        Model("stg_token_sync_skips", "staging", ["ops.token_sync_skips"], stg_token_sync_skips, [TOKEN]),
        Model("stg_pipeline_run_events", "staging", ["ops.pipeline_run_events"], stg_pipeline_run_events, ["run_id"]),
        Model("int_token_universe", "intermediate", ["stg_markets", "stg_market_tokens"], int_token_universe, [TOKEN]),
        Model("int_scoped_markets", "intermediate", ["stg_markets", "ops.market_registry"],
              lambda markets, registry: int_scoped_markets(markets, registry, scope), ["market_id"]),
        Model("int_scoped_universe", "intermediate", ["int_token_universe", "int_scoped_markets"], int_scoped_universe, [TOKEN]),
        Model("int_token_timeseries", "intermediate", ["int_token_universe", "stg_odds"], int_token_timeseries, checks=series_checks),
        Model("int_token_daily_timeseries", "intermediate", ["int_token_universe", "stg_odds_daily"], int_token_daily_timeseries, table=True),
        Model("scoped_markets", "marts", ["int_scoped_markets"], scoped_markets_mart, ["market_id"], True),
        Model("scoped_minutely_odds", "marts", ["int_scoped_universe", "int_token_timeseries"], scoped_minutely_odds,
              [TOKEN, "odds_timestamp_epoch"], checks=unit),
        Model("whale_minutely_odds", "marts", ["scoped_minutely_odds"], lambda rows: whale_minutely_odds(rows, whale),
              checks={"threshold": RowCheck(lambda: quality.below_threshold.where("market_volume_usd", whale)),
                      "subset": lambda rows, frames: quality.subset_mismatch(rows, frames["scoped_minutely_odds"], [TOKEN, "odds_timestamp_epoch"], "price")}),
        Model("scoped_daily_odds", "marts", ["int_scoped_universe", "int_token_daily_timeseries"], scoped_daily_odds, [TOKEN, "odds_date_utc"]),
        Model("token_coverage", "marts", ["int_token_universe", "int_token_daily_timeseries", "stg_sync_ledger", "stg_token_sync_skips"],
              token_coverage, [TOKEN], True,
              {"gaps": RowCheck(lambda: quality.negative.where(["max_gap_days", "avg_gap_days", "token_days_observed"])),
               "dates_and_flags": RowCheck(quality.coverage_disagreement.where), "checked_count": RowCheck(quality.checked_above_count.where),
               "checked_flag": RowCheck(quality.checked_flag_wrong.where),
               "row_count": lambda rows, frames: quality.count_parity(rows, frames["int_token_universe"]),
               "days": lambda rows, frames: quality.days_mismatch(rows, frames["int_token_daily_timeseries"])}),
        Model("market_coverage", "marts", ["token_coverage"], market_coverage, ["market_id", "question", "event_slug"], True,
              {"date_order": RowCheck(quality.date_order.where), "odds_bounds": RowCheck(quality.odds_without_bounds.where),
               "odds_tokens": RowCheck(quality.odds_without_tokens.where)}),
        Model("run_observability", "observability", ["stg_pipeline_run_events"], run_observability, ["run_id"], True,
              {"http": RowCheck(quality.http_counts.where), "non_negative": RowCheck(lambda: quality.negative.where(["processed_tokens", "rows_fetched"])),
               "planned": RowCheck(quality.planned_below_processed.where),
               "ratio": RowCheck(lambda: quality.ratio_mismatch.where("rows_fetched", "processed_tokens", "rows_per_processed_token"))}),
    ]


def needed(names: Sequence[str], scope: Scope) -> set[str]:
    """The named models and all that they are made of, raw tables included."""
    of = {m.name: m.needs for m in models(scope)}
    found: set[str] = set()
    work = list(names)
    while work:
        if (name := work.pop()) not in found:
            found.add(name)
            work += of.get(name, ())
    return found


def build(
    raw: Frames,
    scope: Scope,
    whale: float = BIG_VOLUME,
    publish: Callable[[str, DataFrame], DataFrame] | None = None,
    only: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """All models over the raw tables, or ``only`` some and those they need.

    ``publish`` writes models that are tables, and returns what it wrote.
    """
    wanted = needed(only, scope)
    frames = dict(raw)
    for model in models(scope, whale):
        if not wanted or model.name in wanted:
            made = model.make(*(frames[n] for n in model.needs))
            frames[model.name] = publish(model.name, made) if model.table and publish else made
    return frames


def snapshot(spark: SparkSession, frames: Frames, scope: Scope) -> DataFrame:
    """Which of the models there are and how many rows each has; those that were published are counted by footers alone."""
    return model_snapshot(spark, {m.name: f"{m.layer}.{m.name}" for m in models(scope)}, lambda relation: frames[relation.split(".")[1]])


def violations(frames: Frames, scope: Scope, whale: float = BIG_VOLUME) -> DataFrame:
    """For each check of each model the number of rows that violate it; the grain's uniqueness is one of them."""
    found = []
    for model in models(scope, whale):
        rows = frames[model.name]
        checks = dict(model.checks)
        if model.grain:
            checks["grain"] = lambda r, f, g=tuple(model.grain): quality.duplicate_grain(r, g)
        by_row = {name: check for name, check in checks.items() if isinstance(check, RowCheck)}
        if len(by_row) < 2:  # one alone is a filter that scans and joins may use
            by_row = {}
        counts = [rows.agg(*(F.count_if(check.where()).alias(name) for name, check in by_row.items()))] if by_row else []
        counts += [check(rows, frames).agg(F.count("*").alias(name)) for name, check in checks.items() if name not in by_row]
        for n in counts:
            each = (F.struct(F.lit(model.name).alias("model_name"), F.lit(c).alias("check_name"), F.col(c).alias("n_violations")) for c in n.columns)
            found.append(n.select(F.inline(F.array(*each))))
    return reduce(DataFrame.unionByName, found)
