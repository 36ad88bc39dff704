"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

Each applies library operators to the test tables in the shape of raw tables (``sources.testbed``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import backoff, epoch_of, epoch_to_timestamp, guarded_ratio, iso_timestamp, json_field, json_text_list, plausible_token
from tidemark.operators import backfill, intake, observe, ohlc, ordered, planning, profile, quality, rebuild, scope, upsert
from tidemark.plans import models
from tidemark.sources import landing, scratch
from tidemark.sources import testbed as bed
from tidemark.sources.testbed import with_tables
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = datetime(2024, 2, 1)
_NOW = "timestamp '2024-02-01'"
_NOW_EPOCH = 1_706_745_600


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _frames(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named models (all, if none is) and those they need."""
    raw = bed.raw_tables(spark, sf_dir, models.needed(names, bed.SCOPE) if names else bed.RAW)
    return models.build(raw, bed.SCOPE, only=names)


def _published(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All models; what many of them or of their checks read, and is made of all observations, is computed once."""
    raw = bed.raw_tables(spark, sf_dir)
    raw["raw.token_odds_daily"] = scratch.kept(raw["raw.token_odds_daily"])
    return models.build(raw, bed.SCOPE, publish=lambda name, made: scratch.kept(made) if name == "token_coverage" else made)


def _model(name: str, sql: str) -> None:
    """Register a model as a query."""
    QUERIES[name] = lambda spark, sf_dir: _frames(spark, sf_dir, name)[name]
    ORACLE_SQL[name] = sql


# Models ---------------------------------------------------------------------------------------------------------------

_model("stg_markets", with_tables("markets") + "select * from markets")
_model("stg_market_tokens", with_tables("tokens") + "select * from tokens")
_model("stg_odds", with_tables("odds") + "select * from odds")
_model(
    "stg_odds_daily",
    with_tables("daily")
    + "select *, null::timestamp as refreshed_at, make_timestamp(first_timestamp * 1000000) as first_observed_at, "
    "make_timestamp(last_timestamp * 1000000) as last_observed_at from daily",
)
_model("stg_sync_ledger", with_tables("ledger") + "select * from ledger")
_model("stg_token_sync_skips", with_tables("skips") + "select * from skips")
_model("int_token_universe", with_tables("universe") + "select * from universe")
_model("int_scoped_markets", with_tables("scoped") + "select * from scoped")
_model(
    "int_scoped_universe",
    with_tables("universe", "scoped") + "select * from universe where market_id in (select market_id from scoped)",
)
_model("int_token_timeseries", with_tables("series") + "select * from series")
_model("int_token_daily_timeseries", with_tables("daily_series") + "select * from daily_series")
_model(
    "scoped_markets",
    with_tables("scoped")
    + "select market_id, question, description, category, outcomes, volume, is_active, is_closed, created_at, scraped_at, end_date, slug, event_slug from scoped",
)
_model("scoped_minutely_odds", with_tables("minutely") + "select * from minutely")
_model("whale_minutely_odds", with_tables("minutely") + "select * from minutely where coalesce(market_volume_usd, 0) >= 100000")
_model(
    "scoped_daily_odds",
    with_tables("universe", "scoped", "daily")
    + """select u.market_id, u.outcome_index, u.clob_token_id, u.question, u.outcome_label, u.event_slug, u.is_active, u.is_closed, u.market_volume_usd,
        d.odds_date_utc, d.open_price, d.high_price, d.low_price, d.close_price, d.avg_price, d.observed_points, d.first_timestamp,
        make_timestamp(d.first_timestamp * 1000000) as first_observed_at, d.last_timestamp, make_timestamp(d.last_timestamp * 1000000) as last_observed_at
        from universe u join daily d using (clob_token_id) where u.market_id in (select market_id from scoped)""",
)
_model("token_coverage", with_tables("coverage") + "select * from coverage")
_model(
    "market_coverage",
    with_tables("coverage")
    + """select market_id, question, event_slug, count(*) as token_count, sum(token_days_observed)::bigint as token_days_observed,
        min(first_odds_date) as first_odds_date, max(last_odds_date) as last_odds_date, max(has_daily_odds) as has_odds_data
        from coverage group by market_id, question, event_slug""",
)

_RUN = {
    "is_noop": "n % 2 = 0", "duration_seconds": "n + 0.5::double", "processed_tokens": "n % 7", "rows_fetched": "n * 10",
    "error_tokens": "n % 3", "http_requests": "n", "http_429": "n % 2", "planned_tokens": "n", "planned_vs_market_tokens_ratio": "0.25::double",
}
_RUN_FIELDS = ", ".join(f"({_RUN.get(a, 'null')})::{kind} as {a}" for a, _, kind in models.RUN_FIELDS)
_model(
    "run_observability",
    with_tables("runs")
    + f"""select run_id, task_name, recorded_at, {_RUN_FIELDS},
        case when coalesce(n % 7, 0) = 0 then null else (n * 10)::double / (n % 7) end as rows_per_processed_token
        from runs where task_name in ('sync_odds', 'reconcile_odds_ledger')""",
)


@query(with_tables("runs") + f"select run_id, task_name, recorded_at, {_RUN_FIELDS} from runs")
def stg_pipeline_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stg_pipeline_run_events(bed.run_events(spark, sf_dir)).drop("metrics_json")


# Time series ----------------------------------------------------------------------------------------------------------


@query(with_tables("daily") + "select * from daily")
def daily_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc.daily_ohlc(bed.history(spark, sf_dir))


@query(with_tables("daily") + "select * from daily")
def daily_refresh_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that late observations touch, computed anew: equal to computing all days."""
    history = bed.history(spark, sf_dir)
    late = F.xxhash64("clob_token_id", "odds_timestamp_epoch") % 50 == 0
    daily = ohlc.daily_ohlc(history.filter(~late))
    return ohlc.refresh_days(daily, history, ohlc.dirty_days(history.filter(late)))


@query(with_tables("odds") + "select distinct clob_token_id, (date '1970-01-01' + (odds_timestamp_epoch // 86400)::int)::date as odds_date_utc from odds")
def dirty_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc.dirty_days(bed.history(spark, sf_dir))


@query("select event_id, epoch_us(ts) // 1000000 as epoch, make_timestamp(epoch_us(ts) // 1000000 * 1000000) as at from events")
def epoch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bed.table(spark, sf_dir, "events").select("event_id", epoch_of("ts").alias("epoch"))
    return e.withColumn("at", epoch_to_timestamp("epoch"))


@query(
    with_tables("daily")
    + """select clob_token_id, max(coalesce(gap, 0))::bigint as max_gap_days, coalesce(avg(nullif(gap, 0)), 0)::double as avg_gap_days
    from (select clob_token_id, date_diff('day', lag(odds_date_utc) over (partition by clob_token_id order by odds_date_utc), odds_date_utc) as gap from daily)
    group by clob_token_id"""
)
def gap_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc.gap_diagnostics(ohlc.daily_ohlc(bed.history(spark, sf_dir)))


@query(with_tables("odds") + "select clob_token_id, max(odds_timestamp_epoch) as history_max from odds group by clob_token_id")
def history_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.history_cursors(bed.history(spark, sf_dir))


@query(with_tables("odds") + "select * exclude (ingested_at, odds_timestamp) from odds where odds_timestamp_epoch >= 1706745600 - 365 * 86400")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.retained(bed.history(spark, sf_dir), NOW, 365)


@query(
    with_tables("odds")
    + """, c as (select count(*) as n, (count(*) filter (where odds_timestamp_epoch < 1705881600))::bigint as gone from odds)
    select days, 1706745600 - days * 86400 as cutoff_epoch, n as total_before, d as deleted, case when dry_run then n else n - d end as remaining, dry_run
    from (select 10::bigint as days, gone as d, n, unnest([true, false]) as dry_run from c)"""
)
def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cut at ten days deletes, as a dry run and in earnest."""
    history = bed.history(spark, sf_dir)
    parts = [rebuild.retention_counts(history, NOW, 10, dry).withColumn("dry_run", F.lit(dry)) for dry in (True, False)]
    return parts[0].unionByName(parts[1]).withColumn("days", F.lit(10).cast("long"))


@query("select event_id, (props::json->>'$.k')::bigint as k from events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bed.table(spark, sf_dir, "events").select("event_id", json_field("props", "$.k", "bigint").alias("k"))


# Scope and filters ----------------------------------------------------------------------------------------------------


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stg_markets(bed.markets(spark, sf_dir))


@query(
    with_tables("markets", "registry")
    + """select market_id, market_id in (select market_id from registry) or event_slug in ('brand#12', 'brand#34') or starts_with(event_slug, 'brand#5')
    as in_scope from markets"""
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.with_scope(_staged(spark, sf_dir), bed.market_registry(spark, sf_dir), bed.SCOPE).select("market_id", "in_scope")


@query(with_tables("markets") + "select market_id, volume from markets where coalesce(volume, 0) >= 95000 and coalesce(volume, 0) < 120000")
def volume_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).filter(scope.volume_band("volume", 95_000, 120_000)).select("market_id", "volume")


@query(with_tables("markets") + f"select market_id, end_date from markets where end_date is null or end_date >= {_NOW} - interval 7 day")
def ended_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).filter(scope.not_ended("end_date", NOW, 7)).select("market_id", "end_date")


@query(with_tables("markets") + "select market_id, case when coalesce(volume, 0) >= 100000 then 'hot' else 'cold' end as tier from markets")
def volume_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.volume_tiers(_staged(spark, sf_dir), scope.BIG_VOLUME).select("market_id", "tier")


@query("select event_id from events where epoch_us(ts) > 0 and value / 300 between 0 and 1")
def valid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bed.table(spark, sf_dir, "events")
    return e.filter(scope.valid_observation(epoch_of("ts"), F.col("value") / 300)).select("event_id")


_TOKEN = """case doc_id % 8 when 0 then 'open_token_' || doc_id when 1 then 'closed_no_data' || doc_id when 2 then source || '_' || lang when 3 then repeat('fa', (doc_id % 20)::int)
    when 4 then 'tok' || doc_id when 5 then lang when 6 then 'a-' || doc_id else doc_id::varchar end"""


@query(
    f"""select doc_id, case when t = '' or starts_with(t, 'open_token') or starts_with(t, 'closed_token') or starts_with(t, 'closed_no_data') or not regexp_full_match(t, '[0-9A-Za-z_]+') then false
    when regexp_full_match(t, '[0-9a-fA-F]+') then length(t) >= 30 else regexp_matches(t, '[0-9_]') end as plausible from (select doc_id, {_TOKEN} as t from documents)"""
)
def token_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = bed.table(spark, sf_dir, "documents"), F.col("doc_id")
    kinds = (
        F.concat(F.lit("open_token_"), i), F.concat(F.lit("closed_no_data"), i), F.concat_ws("_", "source", "lang"), F.repeat(F.lit("fa"), (i % 20).cast("int")),
        F.concat(F.lit("tok"), i), F.col("lang"), F.concat(F.lit("a-"), i), i.cast("string"),
    )
    return d.select("doc_id", plausible_token(F.get(F.array(*kinds), (i % 8).cast("int"))).alias("plausible"))


@query(
    """select doc_id, lower(lang) = 'en' or (lower(source) <> 'src1' and lower(source) like '%src1%') as allowed,
    case when doc_id % 5 = 0 then true when doc_id % 5 = 1 then false else lower(source) = 'src2' or (lower(source) <> 'src3' and lower(source) like '%src%') end as allowed_odd,
    coalesce(starts_with(lower(source), 'src2'), false) or lang = 'fr' as in_scope from documents"""
)
def tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of documents; of ``allowed_odd`` some are null, blank, in capitals or with blanks around them."""
    d = bed.table(spark, sf_dir, "documents")
    both = F.when(F.col("lang") == "en", F.col("lang")).otherwise(F.col("source"))
    tags = scope.Scope(prefixes=("src2",), tags=("fr",))
    allowed = scope.crawl_allowed(both, ["en"], ["src1"], ["src1"]) | scope.crawl_allowed("source", [], ["src1"], ["src1"])
    odd = F.when(F.col("doc_id") % 5 == 1, "  ").when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" "), F.upper("source"), F.lit(" ")))
    return d.select(
        "doc_id", allowed.alias("allowed"), scope.crawl_allowed(odd, ["Src2 "], ["src3"], ["src"]).alias("allowed_odd"),
        scope.event_in_scope("source", F.array("lang"), tags).alias("in_scope"),
    )


@query(
    """select id as market_id from (select case p_partkey % 4 when 1 then 'x' || p_partkey when 2 then '-' || p_partkey else p_partkey::varchar end as id,
    case p_size % 3 when 1 then '' when 2 then 'slug' end as slug from part) where coalesce(slug, '') = '' and try_cast(id as bigint) > 0"""
)
def numeric_ids_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = bed.table(spark, sf_dir, "part"), F.col("p_partkey")
    ids = F.when(key % 4 == 1, F.concat(F.lit("x"), key)).when(key % 4 == 2, F.concat(F.lit("-"), key)).otherwise(key.cast("string"))
    slug = F.when(F.col("p_size") % 3 == 1, "").when(F.col("p_size") % 3 == 2, "slug")
    return scope.lacking(p.select(ids.alias("market_id"), slug.alias("slug")), "slug")


@query(
    """select event_id, case event_id % 5 when 1 then date_trunc('second', ts) - interval 2 hour when 3 then date_trunc('day', ts) when 4 then null else date_trunc('second', ts) end as at,
    case when event_id % 5 in (0, 2) then epoch_us(ts) // 1000000 end as plain_epoch from events"""
)
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written with a zone (0, 1), without one (2), as a day (3), and no times (4)."""
    e, kind = bed.table(spark, sf_dir, "events"), F.col("event_id") % 5
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.replace(text, F.lit(" "), F.lit("T"))
    written = F.when(kind == 0, F.concat(iso, F.lit(".5Z"))).when(kind == 1, F.concat(iso, F.lit("+02:00"))).when(kind == 2, text).when(kind == 3, F.left(text, F.lit(10))).otherwise("never")
    return e.select("event_id", iso_timestamp(written).alias("at"), planning.created_epoch(written).alias("plain_epoch"))


@query(r"""select doc_id, '["' || lang || '", "No \u00e9 \"x\" \\ \u2603 \ud83d\ude42\n' || doc_id || '"]' as outcomes from documents""")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bed.table(spark, sf_dir, "documents")
    odd = F.concat(F.lit('No \u00e9 "x" \\ \u2603 \U0001f642\n'), F.col("doc_id").cast("string"))
    return d.select("doc_id", json_text_list(F.array("lang", odd)).alias("outcomes"))


# Upserts --------------------------------------------------------------------------------------------------------------


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bed.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "ts", F.col("event_id").alias("row_order"), "value")


@query("select user_id as k, ts::date as d, ts, event_id as row_order, value from events qualify row_number() over (partition by user_id, ts::date order by ts desc, event_id desc) = 1")
def lww_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.last_write_wins(_observations(spark, sf_dir), ["k", "d"], ["ts", "row_order"])


@query(
    """with rows as (select user_id as k, ts::date as d, ts, event_id as row_order, value, event_id % 2 as half from events),
    last as (select * from rows qualify row_number() over (partition by k, d, half order by ts desc, row_order desc) = 1)
    select k, d, ts, row_order, value from last qualify row_number() over (partition by k, d order by half desc) = 1"""
)
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    old = upsert.last_write_wins(rows.filter("row_order % 2 = 0"), ["k", "d"], ["ts", "row_order"])
    return upsert.upsert(old, rows.filter("row_order % 2 = 1"), ["k", "d"], ["ts", "row_order"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows as they were, and new ones that overlap them."""
    ledger = bed.sync_ledger(spark, sf_dir).withColumnRenamed("clobTokenId", "clob_token_id")
    key = F.col("clob_token_id").cast("long")
    new = ledger.filter(key % 3 != 0).withColumns({
        "last_sync_timestamp": F.when(key % 5 != 0, F.col("last_sync_timestamp") + 1000 - key),
        "fully_checked": key % 7 == 0,
        "next_check_at": F.when(key % 2 == 0, F.col("last_checked_at")),
    })
    return ledger.filter(key % 2 == 0), new


_LEDGER = """with l as (select c_custkey as i, c_custkey::varchar as clob_token_id, case when c_nationkey % 6 <> 0 then 1704067200 + c_custkey * 60 end as last_sync_timestamp,
    c_nationkey % 3 = 0 as fully_checked, timestamp '2024-01-01 00:10:00' + c_custkey * interval 1 minute as last_checked_at,
    case when c_nationkey % 4 = 0 then timestamp '2024-01-02' + c_custkey * interval 1 minute end as next_check_at,
    (case when c_nationkey % 5 <> 0 then c_nationkey % 8 end)::int as empty_run_streak from customer),
    o as (select * exclude (i) from l where i % 2 = 0),
    n as (select clob_token_id, case when i % 5 <> 0 then last_sync_timestamp + 1000 - i end as last_sync_timestamp, i % 7 = 0 as fully_checked, last_checked_at,
    case when i % 2 = 0 then last_checked_at end as next_check_at, empty_run_streak from l where i % 3 <> 0) """


@query(
    _LEDGER
    + """select clob_token_id, coalesce(n.last_sync_timestamp, o.last_sync_timestamp) as last_sync_timestamp, coalesce(n.next_check_at, o.next_check_at) as next_check_at,
    case when n.clob_token_id is not null then n.fully_checked else o.fully_checked end as fully_checked from o full join n using (clob_token_id)"""
)
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return upsert.merge_coalesce(old, new, ["clob_token_id"], ["last_sync_timestamp", "next_check_at"], ["fully_checked"])


@query(_LEDGER + "select clob_token_id, greatest(o.last_sync_timestamp, n.last_sync_timestamp) as last_sync_timestamp, o.fully_checked from o full join n using (clob_token_id)")
def merge_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (x.select("clob_token_id", "last_sync_timestamp", "fully_checked") for x in _halves(spark, sf_dir))
    return upsert.merge_monotonic(old, new, "clob_token_id", "last_sync_timestamp")


@query(
    _LEDGER
    + """select clob_token_id, greatest(o.last_sync_timestamp, n.last_sync_timestamp) as last_sync_timestamp,
    coalesce(o.fully_checked, false) or coalesce(n.fully_checked, false) as fully_checked, coalesce(n.last_checked_at, o.last_checked_at) as last_checked_at,
    case when coalesce(n.fully_checked, false) then null else coalesce(n.next_check_at, o.next_check_at) end as next_check_at,
    case when coalesce(n.fully_checked, false) then 0 else coalesce(n.empty_run_streak, o.empty_run_streak, 0) end as empty_run_streak
    from o full join n using (clob_token_id)"""
)
def merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.merge_state(*_halves(spark, sf_dir))


@query(
    """with s as (select s_suppkey as i, s_suppkey::varchar as k, 'old ' || s_nationkey as reason, timestamp '2024-01-01' as created_at from supplier),
    o as (select * from s where i % 2 = 0), n as (select i, k, 'new' as reason, timestamp '2024-02-01' as created_at from s where i % 3 = 0)
    select k, coalesce(n.reason, o.reason) as reason, coalesce(o.created_at, n.created_at) as created_at from o full join n using (k)"""
)
def merge_keep_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bed.table(spark, sf_dir, "supplier")
    key, at = F.col("s_suppkey"), lambda t: F.lit(t).cast("timestamp_ntz")
    old = s.filter(key % 2 == 0).select(key.cast("string").alias("k"), F.concat(F.lit("old "), "s_nationkey").alias("reason"), at(datetime(2024, 1, 1)).alias("created_at"))
    new = s.filter(key % 3 == 0).select(key.cast("string").alias("k"), F.lit("new").alias("reason"), at(NOW).alias("created_at"))
    return upsert.merge_keep_created(old, new, "k")


@query(
    f"""with p as (select p_partkey as i, p_partkey::varchar as market_id from part), o as (select market_id, (i % 5)::int as attempts from p where i % 2 = 0),
    n as (select market_id from p where i % 3 = 0)
    select market_id, 'slug' as field_name, case when n.market_id is not null then 'retry' else 'first' end as reason,
    (coalesce(o.attempts, 0) + (n.market_id is not null)::int)::int as attempts, case when n.market_id is not null then {_NOW} else timestamp '2024-01-01' end as last_checked_at,
    case when n.market_id is not null then {_NOW} + interval 168 hour else timestamp '2024-01-02' end as next_retry_at from o full join n using (market_id)"""
)
def merge_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = bed.table(spark, sf_dir, "part"), F.col("p_partkey")
    named = p.select(key, key.cast("string").alias("market_id"), F.lit("slug").alias("field_name"))
    at = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    old = named.filter(key % 2 == 0).select("market_id", "field_name", F.lit("first").alias("reason"), (key % 5).cast("int").alias("attempts"), at(1).alias("last_checked_at"), at(2).alias("next_retry_at"))
    failed = named.filter(key % 3 == 0).select("market_id", "field_name", F.lit("retry").alias("reason"), F.lit(None).cast("int").alias("attempts"), at(1).alias("last_checked_at"), at(1).alias("next_retry_at"))
    return upsert.merge_counter(old, failed, ["market_id", "field_name"], NOW, 168)


@query(_LEDGER + "select clob_token_id, case when n.clob_token_id is not null then true else o.fully_checked end as fully_checked, o.last_sync_timestamp from o full join n using (clob_token_id)")
def merge_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return upsert.set_flag(old.select("clob_token_id", "fully_checked", "last_sync_timestamp"), new, "clob_token_id", "fully_checked")


@query(with_tables("markets") + "select market_id, case when market_id::bigint % 4 = 0 then 'new-' || market_id else slug end as slug, event_slug from markets")
def update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(spark, sf_dir).select("market_id", "slug", "event_slug")
    new = rows.filter(F.col("market_id").cast("long") % 4 == 0).select("market_id", F.concat(F.lit("new-"), "market_id").alias("slug"))
    return upsert.update_columns(rows, new, "market_id", ["slug"])


@query(
    """select user_id as k, list(event_id order by event_id)[-20:] as history from events group by user_id"""
)
def rolling_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the entries, of each the last 20 of a user by rank before they are gathered."""
    e = bed.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id")
    mid = e.agg(F.percentile_approx("event_id", 0.5).alias("mid"))  # one row
    rows = e.join(F.broadcast(mid))
    last = Window.partitionBy("k").orderBy(F.desc("event_id"))

    def of(r: DataFrame) -> DataFrame:
        few = r.withColumn("n", F.row_number().over(last)).filter("n <= 20")
        return few.groupBy("k").agg(F.array_sort(F.collect_list("event_id")).alias("history"))

    return upsert.append_history(of(rows.filter("event_id <= mid")), of(rows.filter("event_id > mid")), "k", "history", 20)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def orphan_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = bed.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return upsert.without_orphans(bed.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders; none if an order's customer is unknown."""
    orders = bed.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.not_in(bed.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bed.table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return bed.table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query(
    """with a as (select o_custkey % 50 as k, o_orderpriority as p from orders where o_orderkey % 3 <> 0), b as (select o_custkey % 50 as k, o_orderpriority as p from orders where o_orderkey % 5 <> 0)
    select * from ((select * from a except all select * from b) union all (select * from b except all select * from a))"""
)
def except_all_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bed.table(spark, sf_dir, "orders")
    rows = lambda r: r.select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderpriority").alias("p"))
    return upsert.symmetric_difference(rows(o.filter("o_orderkey % 3 <> 0")), rows(o.filter("o_orderkey % 5 <> 0")))


@query(
    """with a as (select o_custkey as k, count(*) as n from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, count(*) as n from orders where o_orderkey % 3 = 0 group by 1)
    select k, a.n as before, b.n as after from a full join b using (k) where a.n is distinct from b.n"""
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bed.table(spark, sf_dir, "orders")
    n = lambda r: r.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return upsert.changed_keys(n(o.filter("o_orderkey % 2 = 0")), n(o.filter("o_orderkey % 3 = 0")), "k", "n")


def _odd_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of which some break a rule, or several."""
    n, h = F.col("event_id"), bed.table(spark, sf_dir, "events")
    return h.select(
        "event_id",
        F.when(n % 50 != 0, F.col("user_id").cast("string")).alias("clob_token_id"),
        F.when(n % 20 == 0, -epoch_of("ts")).when(n % 33 != 0, epoch_of("ts")).alias("odds_timestamp_epoch"),
        F.when(n % 7 == 0, F.col("value") - 5).when(n % 11 != 0, F.col("value") / 1000).alias("price"),
    )


_ODD = """with o as (select event_id, case when event_id % 50 <> 0 then user_id end as t, case when event_id % 20 = 0 then -1 when event_id % 33 <> 0 then 1 end as e,
    case when event_id % 7 = 0 then value - 5 when event_id % 11 <> 0 then value / 1000 end as p from events),
    j as (select event_id, case when t is null then 'no_token' when e is null or e <= 0 then 'invalid_ts' when p is null or p < 0 or p > 1 then 'invalid_price' end as reason from o) """


@query(_ODD + "select coalesce(reason, 'kept') as reason, count(*) as n_rows from j group by 1 union all select 'rows', count(*) from j")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the write of the kept rows takes, here to nowhere: no pass is made for them."""
    drops = intake.Drops(intake.judged(_odd_observations(spark, sf_dir)))
    drops.kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(list(drops.counts().items()), "reason string, n_rows long")


@query(_ODD + "select event_id, reason from j where reason is not null")
def refused_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.Drops(intake.judged(_odd_observations(spark, sf_dir))).refused.select("event_id", "reason")


@query("""select count(*) as n_rows, (count(*) filter (where o_custkey in (select c_custkey from customer where c_acctbal > 0)))::bigint as kept,
    (count(*) filter (where o_custkey not in (select c_custkey from customer where c_acctbal > 0)))::bigint as orphans from orders""")
def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders kept and dropped by their customer, counted in the job that keeps them."""
    parents = bed.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    found = intake.Referred(bed.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey")
    found.kept.write.format("noop").mode("overwrite").save()
    c = found.counts()
    return spark.createDataFrame([(c["rows"], c["kept"], c["orphans"])], "n_rows long, kept long, orphans long")


@query(
    """with a as (select o_orderkey as k, o_orderstatus as v from orders), b as (select case when o_orderkey % 1000 = 1 then null else o_orderkey end as k,
        case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 13 <> 0 union all select o_orderkey, o_orderstatus from orders where o_orderkey % 50 = 3),
    d as (select k, v, sum(n) as n from (select k, v, 1 as n from a union all select k, v, -1 from b) group by k, v),
    f as (select 'null' as kind, 'k' as name, count(*) as n from b where k is null
        union all select 'duplicate', 'k', count(*) from (select k from b group by k having count(*) > 1)
        union all select 'lost', 'rows', coalesce(sum(n) filter (where n > 0), 0) from d union all select 'added', 'rows', coalesce(-sum(n) filter (where n < 0), 0) from d)
    select kind, name, n::bigint as n from f where n > 0"""
)
def rebuild_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild that lost rows, changed some, wrote some twice and lost some keys."""
    old = bed.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    k = F.col("k")
    changed = old.filter(k % 13 != 0).select(F.when(k % 1000 != 1, k).alias("k"), F.when(k % 7 == 0, "X").otherwise(F.col("v")).alias("v"))
    return rebuild.rebuild_violations(old, changed.unionByName(old.filter(k % 50 == 3)), ["k"], ["v"])


# Planning -------------------------------------------------------------------------------------------------------------


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bed.market_tokens(spark, sf_dir).select("market_id", F.col("clobTokenIds").alias("clob_token_ids"))
    return _staged(spark, sf_dir).join(tokens, "market_id")


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ledger = bed.sync_ledger(spark, sf_dir).withColumnRenamed("clobTokenId", "clob_token_id")
    return ledger, models.stg_token_sync_skips(bed.sync_skips(spark, sf_dir)).drop("created_at")


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.due_tokens(_listed(spark, sf_dir), *_states(spark, sf_dir), NOW, datetime(2024, 1, 5))


_DUE = with_tables("tokens", "markets", "ledger", "skips", "registry", "scoped") + f""", due as (
    select m.*, t.clob_token_id, t.outcome_index from markets m join tokens t using (market_id) left join ledger l using (clob_token_id) left join skips s using (clob_token_id)
    where s.reason is null and not coalesce(m.is_closed and l.is_fully_checked, false) and (l.next_check_at is null or l.next_check_at <= {_NOW})
    and m.created_at >= timestamp '2024-01-05') """


@query(_DUE + "select market_id, outcome_index, clob_token_id from due")
def due_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(spark, sf_dir).select("market_id", "outcome_index", "clob_token_id")


@query(with_tables("markets", "market_tokens") + "select count(*) as market_count, coalesce(sum(json_array_length(clob_token_ids)), 0)::bigint as token_count from markets join market_tokens using (market_id) where clob_token_ids <> '[]' and is_active")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.candidate_counts(_listed(spark, sf_dir), F.col("is_active"))


@query(_DUE + f"select (count(*) filter (where market_id not in (select market_id from scoped)))::bigint as scope_skipped, (count(*) filter (where market_id in (select market_id from scoped) and end_date < {_NOW} - interval 7 day))::bigint as ended_skipped from due")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = scope.with_scope(_due(spark, sf_dir), bed.market_registry(spark, sf_dir), bed.SCOPE)
    return planning.exclusion_counts(marked, F.col("in_scope"), scope.not_ended("end_date", NOW, 7))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the ledger, some of them twice, implausible, skipped or done."""
    c = bed.table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    named = F.when(nation == 3, F.lit("!")).otherwise(F.concat(F.lit("tok_"), F.floor(key / 2).cast("string")))
    return c.select(
        key.alias("arrival"), named.alias("clob_token_id"), (F.lit(1_704_067_200) + key * 600).cast("long").alias("created_ts"),
        F.when(nation % 4 != 0, F.lit(1_704_067_200) + key * 1200).cast("long").alias("cursor"), F.when(nation == 5, "skip").alias("reason"),
        (nation % 2 == 0).alias("is_closed"), (nation % 3 == 0).alias("fully_checked"), (nation % 8).cast("int").alias("empty_run_streak"),
        F.when(nation % 6 == 1, 2).when(nation % 6 == 2, 1).alias("skip_budget"),
    )


_CANDIDATES = """with c as (select c_custkey as arrival, case when c_nationkey = 3 then '!' else 'tok_' || (c_custkey // 2) end as clob_token_id, 1704067200 + c_custkey * 600 as created_ts,
    case when c_nationkey % 4 <> 0 then 1704067200 + c_custkey * 1200 end as cursor, c_nationkey = 5 as skipped, c_nationkey % 2 = 0 and c_nationkey % 3 = 0 as done, c_nationkey % 8 as streak,
    case c_nationkey % 6 when 1 then 2 when 2 then 1 else 0 end as budget, c_nationkey as nation from customer), """
_JUDGED = """s as (select *, case when cursor is null then created_ts else greatest(created_ts, cursor - 300) end as start, row_number() over (partition by clob_token_id order by arrival) as nth from {}),
    r as (select *, case when nth > 1 then 'dup_token' when clob_token_id = '!' then 'invalid_token' when skipped then 'persisted_skip' when done then 'closed_done' when budget > 0 then 'empty_cache_skip'
    when 1705200000 - cursor < 600 then 'recent_skip' when start >= 1705200000 then 'already_current' else 'plan' end as outcome from s) """
_CLASSIFIED = _CANDIDATES + _JUDGED.format("c")
_PLAN_COLUMNS = """arrival, clob_token_id, outcome, (case when outcome = 'plan' then start end)::bigint as start_ts, (case when outcome = 'plan' then 1705200000 end)::bigint as end_ts,
    streak::int as empty_run_streak, (budget - (outcome = 'empty_cache_skip')::int)::int as skip_budget"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.classify_plans(_candidates(spark, sf_dir), planning.PlanRules(1_705_200_000, recent=600))


@query(_CLASSIFIED + f"select {_PLAN_COLUMNS} from r")
def plan_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)


@query(
    _CANDIDATES
    + "d as (select * from c where nation % 7 > 1 and created_ts >= 1704240000), "
    + _JUDGED.format("d")
    + f""", q as (select * replace (case when outcome = 'plan' and ((arrival // 2) % 3 = 0 or (arrival // 2) % 5 <> 0 or arrival // 2 >= 10000) then 'scope_skip' else outcome end as outcome) from r)
    select {_PLAN_COLUMNS} from q union all select arrival, clob_token_id, 'pre_clob_markets', null, null, streak::int, budget::int from c where nation % 7 > 1 and created_ts < 1704240000"""
)
def plan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with written times, some unreadable; tokens of multiples of 5 are allowed, those of 3 denied."""
    rows, nation = _candidates(spark, sf_dir), bed.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("arrival"), "c_nationkey")
    written = F.concat(F.date_format(epoch_to_timestamp("created_ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456"))
    text = F.when(F.col("c_nationkey") % 7 == 0, "not a time").when(F.col("c_nationkey") % 7 != 1, written)
    rows = rows.join(nation, "arrival").withColumn("created_at", text).drop("created_ts", "c_nationkey")
    numbers = spark.range(0, 10_000).withColumn("clob_token_id", F.concat(F.lit("tok_"), F.col("id")))
    allow, deny = numbers.filter("id % 5 = 0").select("clob_token_id"), numbers.filter("id % 3 = 0").select("clob_token_id")
    rules = planning.PlanRules(1_705_200_000, recent=600)
    return planning.plan_stream(rows, rules, planning.cutoff_time("2024-01-03"), allow, deny)


@query(_CLASSIFIED + "select outcome, count(*) as n_tokens from r group by outcome")
def plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n_tokens"))


@query(_CLASSIFIED + "select clob_token_id, w::bigint as window_start, least(w + 21600, 1705200000)::bigint as window_end from (select clob_token_id, unnest(range(start, 1705200000, 21600)) as w from r where outcome = 'plan')")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.window_slices(_plans(spark, sf_dir).filter("outcome = 'plan'"), 21_600).select("clob_token_id", "window_start", "window_end")


def _refused(windows: DataFrame) -> DataFrame:
    """A source that takes no window beyond two hours, and of some tokens none beyond twenty minutes."""
    most = F.when(F.pmod(F.col("arrival"), F.lit(3)) == 0, 1_200).otherwise(7_200)
    return windows.withColumn("refused", F.col("window_end") - F.col("window_start") > most)


@query(
    _CLASSIFIED.replace("with c as", "with recursive c as", 1)
    + """, w as (select clob_token_id, arrival, start as s, 1705200000 as e, case when arrival % 3 = 0 then 1200 else 7200 end as most from r where outcome = 'plan'),
    h(clob_token_id, s, e, most) as (select clob_token_id, s, e, most from w union all
        select clob_token_id, unnest([s, s + (e - s) // 2]), unnest([s + (e - s) // 2, e]), most from h where e - s > most and e - s > 1800)
    select clob_token_id, s::bigint as window_start, e::bigint as window_end, e - s > most as refused from h where not (e - s > most and e - s > 1800)"""
)
def window_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans asked for whole, and in halves where that is refused, down to half an hour."""
    plans = _plans(spark, sf_dir).filter("outcome = 'plan'").withColumnsRenamed({"start_ts": "window_start", "end_ts": "window_end"})
    return planning.bisected_windows(plans, _refused, 1_800).select("clob_token_id", "window_start", "window_end", "refused")


@query(
    _CLASSIFIED
    + """, p as (select *, (row_number() over (order by arrival) - 1) // 100 as page from r)
    select page, (row_number() over (partition by page order by 1705200000 - start, created_ts, arrival))::int as place, arrival, clob_token_id, start::bigint as start_ts from p where outcome = 'plan'"""
)
def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by page of 100 candidates, the shortest range of each page first."""
    created = _candidates(spark, sf_dir).select("arrival", "created_ts")
    return planning.plan_pages(_plans(spark, sf_dir).join(created, "arrival"), 100).select("page", "place", "arrival", "clob_token_id", "start_ts")


@query(
    """select o_orderkey, (s - c)::bigint as spent_before, least(c, 20000 - (s - c))::bigint as paid, c > 20000 - (s - c) as cut
    from (select o_orderkey, o_custkey % 50 as c, sum(o_custkey % 50) over (order by o_orderdate, o_orderkey) as s from orders) where s - c < 20000"""
)
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order, each of some pages, as far as a budget of 20,000 pages goes."""
    o = bed.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("cost"))
    return ordered.within_budget(o, "cost", 20_000, "o_orderdate", "o_orderkey").select("o_orderkey", "spent_before", "paid", "cut")


@query(
    _CANDIDATES
    + "d as (select * from c where created_ts >= 1704240000), "
    + _JUDGED.format("d")
    + f"""select {_PLAN_COLUMNS} from r union all select min(arrival), null, 'pre_clob_markets', null, null, arg_min(streak, arrival)::int, arg_min(budget, arrival)::int
    from c where created_ts < 1704240000 group by arrival // 4"""
)
def plan_stream_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by market, of four tokens each: early ones count once a market."""
    rows = _candidates(spark, sf_dir).withColumn("market_id", F.floor(F.col("arrival") / 4))
    rows = rows.withColumn("created_at", epoch_to_timestamp("created_ts")).drop("created_ts")
    return planning.plan_stream(rows, planning.PlanRules(1_705_200_000, recent=600), planning.cutoff_time("2024-01-03"), full=True)


@query("select p_partkey, least(60 * pow(2, greatest(p_size - 1, 0)), 86400)::bigint as wait from part")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bed.table(spark, sf_dir, "part").select("p_partkey", backoff("p_size", 60, 86_400).alias("wait"))


_RUNS = """with w as (select l_partkey::varchar as t, l_orderkey * 10 + l_linenumber as ws, l_orderkey * 10 + l_linenumber + 1 as we,
    case when l_quantity % 23 = 0 then 'permanent' when l_quantity % 7 = 0 then 'error' else 'ok' end as status, (l_quantity % 3)::bigint as n, l_orderkey as last from lineitem),
    b as (select *, coalesce(max((status = 'permanent')::int) over (partition by t order by ws rows between unbounded preceding and 1 preceding), 0) as ended,
    max((status <> 'ok')::int) over (partition by t order by ws) as broken from w),
    r as (select t, max(last) filter (where status = 'ok' and n > 0 and broken = 0) as seen_first, max(last) filter (where status = 'ok' and n > 0) as seen, max(we) filter (where status = 'ok' and broken = 0) as reached,
    coalesce(sum(n) filter (where status = 'ok'), 0) as n, count(*) as windows, bool_or(status = 'error') as failed, bool_or(status = 'permanent') as permanent,
    max('window ' || ws) filter (where status = 'permanent') as message from b where ended = 0 group by t),
    p as (select p_partkey::varchar as t, p_size, p_partkey as s, 1000000 + p_partkey as e, p_size % 5 = 0 as closed, p_size % 4 as streak from part),
    x as (select p.*, seen_first, seen, reached, message, coalesce(n, 0) as n, coalesce(windows, 0) as windows, coalesce(permanent, false) as permanent, coalesce(failed, false) and not coalesce(permanent, false) as failed
    from p left join r using (t)),
    y as (select *, closed and not failed and not permanent as checked, case when n = 0 and not failed and not permanent then streak + 1 else 0 end as k from x) """


def _transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States after windows some of which failed, and their plans."""
    l, p = bed.table(spark, sf_dir, "lineitem"), bed.table(spark, sf_dir, "part")
    at, rows, q = F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_quantity") % 3).cast("long"), F.col("l_quantity")
    results = l.select(
        F.col("l_partkey").cast("string").alias("clob_token_id"), at.alias("window_start"), (at + 1).alias("window_end"),
        F.when(q % 23 == 0, "permanent").when(q % 7 == 0, "error").otherwise("ok").alias("status"), rows.alias("rows"),
        F.when(rows > 0, F.col("l_orderkey")).alias("last_ts"), F.concat(F.lit("window "), at).alias("message"),
    )
    key, size = F.col("p_partkey"), F.col("p_size")
    plans = p.select(
        key.cast("string").alias("clob_token_id"), size.cast("string").alias("market_id"), key.alias("start_ts"), (key + 1_000_000).alias("end_ts"),
        (size % 5 == 0).alias("is_closed"), (size % 4).cast("int").alias("empty_run_streak"),
    )
    return planning.state_transitions(results, plans, planning.RetryRules(3600, 300, 60, 86_400)), plans


@query(
    _RUNS
    + """select t as clob_token_id, (case when permanent then e when failed then case when seen_first > s then seen_first when n = 0 and reached > s then reached end when n = 0 then e else greatest(seen, s) end)::bigint as cursor,
    e as checked_ts, (case when not permanent and not checked then e + case when failed then 300 when n = 0 then least(60 * pow(2, greatest(k - 1, 0)), 86400) else 3600 end end)::bigint as next_check_ts,
    k::int as empty_run_streak, checked as fully_checked, n::bigint as rows, windows, failed or permanent as error, permanent as permanent_error, case when permanent then message end as skip_reason from y"""
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir)[0]


@query(
    _RUNS
    + """select count(*) as processed_tokens, count(distinct p_size) as distinct_markets, sum(n)::bigint as rows, sum(windows)::bigint as windows, (count(*) filter (where n = 0))::bigint as empty,
    (count(*) filter (where failed or permanent))::bigint as error, (count(*) filter (where permanent))::bigint as permanent_error, (count(*) filter (where checked))::bigint as fully_checked,
    round(count(*) / 12.5::double, 4) as token_rate, round(sum(n)::bigint / 12.5::double, 4) as row_rate from y"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.run_totals(*_transitions(spark, sf_dir), 12.5)


@query(
    """with r as (select p_partkey, p_size::double as rate, p_partkey % 400 as requests, p_partkey % 13 as throttled, p_partkey % 7 as errors from part),
    t as (select *, case when throttled / greatest(requests, 1)::double > 0.03 then greatest(2.0::double, rate * 0.8::double) when errors / greatest(requests, 1)::double > 0.01 then greatest(2.0::double, rate * 0.9::double)
    when throttled = 0 then least(40.0::double, rate * 1.1::double) else rate end as target from r)
    select p_partkey, case when requests >= 200 and abs(target - rate) >= 0.5 then target else rate end as next_rate from t"""
)
def tuned_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = bed.table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select("p_partkey", planning.tuned_rate(F.col("p_size").cast("double"), key % 400, key % 13, key % 7, 2, 40).alias("next_rate"))


@query(
    """select user_id::varchar as clob_token_id, max(event_id) as cursor, arg_max(ts, event_id) filter (where event_id % 3 <> 0) as checked_at,
    arg_max(ts, event_id) filter (where event_id % 5 <> 0) as next_check_at, (arg_max(event_id, event_id) % 8)::int as streak, bool_or(event_id % 11 = 0) as fully_checked from events group by user_id"""
)
def merge_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = bed.table(spark, sf_dir, "events"), F.col("event_id")
    return planning.merge_buffers(e.select(
        F.col("user_id").cast("string").alias("clob_token_id"), i.alias("arrival"), i.alias("cursor"), F.when(i % 3 != 0, F.col("ts")).alias("checked_at"),
        F.when(i % 5 != 0, F.col("ts")).alias("next_check_at"), (i % 8).cast("int").alias("streak"), (i % 11 == 0).alias("fully_checked"),
    ))


_LAST = "(select clob_token_id, max(odds_timestamp_epoch) as history_max from odds group by clob_token_id)"


@query(
    with_tables("odds", "ledger", "skips", "tokens")
    + f"""select t.clob_token_id, coalesce(l.last_sync_timestamp, h.history_max) as cursor, coalesce(l.is_fully_checked, false) as fully_checked, l.next_check_at,
    coalesce(l.empty_run_streak, 0)::int as empty_run_streak, s.reason is not null as is_skipped
    from (select distinct clob_token_id from tokens) t left join ledger l using (clob_token_id) left join skips s using (clob_token_id) left join {_LAST} h using (clob_token_id)"""
)
def cursor_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = models.stg_market_tokens(bed.market_tokens(spark, sf_dir))
    return planning.cursor_snapshot(tokens, *_states(spark, sf_dir), bed.history(spark, sf_dir))


@query(with_tables("odds", "ledger") + f"select clob_token_id, greatest(l.last_sync_timestamp, h.history_max) as cursor from ledger l full join {_LAST} h using (clob_token_id)")
def latest_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.latest_cursors(_states(spark, sf_dir)[0], bed.history(spark, sf_dir))


@query(with_tables("odds", "ledger") + f"select count(*) as scanned, (count(*) filter (where l.last_sync_timestamp is null or l.last_sync_timestamp < h.history_max))::bigint as repaired from {_LAST} h left join ledger l using (clob_token_id)")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.reconcile_ledger(_states(spark, sf_dir)[0], bed.history(spark, sf_dir))[1]


@query(with_tables("odds", "ledger") + f"select clob_token_id, greatest(l.last_sync_timestamp, h.history_max) as last_sync_timestamp from ledger l full join {_LAST} h using (clob_token_id)")
def reconcile_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.reconcile_ledger(_states(spark, sf_dir)[0], bed.history(spark, sf_dir))[0].select("clob_token_id", "last_sync_timestamp")


@query(
    """with r as (select (s_suppkey % 40)::varchar as market_id, s_name as event_slug, case s_suppkey % 3 when 0 then 'seed' else 'events_api' end as source, s_suppkey as row_order from supplier)
    select * from r qualify row_number() over (partition by market_id order by source = 'events_api' desc, row_order) = 1"""
)
def registry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = bed.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select((key % 40).cast("string").alias("market_id"), F.col("s_name").alias("event_slug"), F.when(key % 3 == 0, "seed").otherwise("events_api").alias("source"), key.alias("row_order"))
    return planning.best_registry_rows(rows, ["seed", "events_api"])


@query("select tag, list(distinct source order by source) as sources from (select lang as tag, 'seed' as source from documents union all select source as tag, 'tags' from documents where lower(source) like '%rc1%') group by tag")
def tag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bed.table(spark, sf_dir, "documents")
    return planning.tag_sources({"seed": d.select(F.col("lang").alias("tag")), "tags": d.select(F.col("source").alias("tag"))}, ["rc1"])


@query(
    """with recursive e as (select distinct (s_suppkey % 60)::varchar as tag, ((s_suppkey * 7) % 60)::varchar as other from supplier),
    t(tag, round) as (select '1', 0 union select e.other, t.round + 1 from t join e using (tag) where t.round < 4) select tag, min(round)::int as round from t group by tag"""
)
def tag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bed.table(spark, sf_dir, "supplier")
    edges = s.select((F.col("s_suppkey") % 60).cast("string").alias("tag"), ((F.col("s_suppkey") * 7) % 60).cast("string").alias("other")).distinct()
    return planning.tag_closure(edges, ["1"], 4, 1000)


@query(
    with_tables("markets", "market_tokens")
    + """select market_id, unnest(list_filter([case when clob_token_ids = '[]' then 'tokens' end, case when end_date is null then 'end_date' end], lambda x: x is not null)) as field_name
    from markets join market_tokens using (market_id)
    except select p_partkey::varchar, 'end_date' from part where p_partkey % 2 = 0"""
)
def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = bed.table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").cast("string").alias("market_id"), F.lit("end_date").alias("field_name"), F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz").alias("next_retry_at")
    )
    return planning.missing_metadata(_listed(spark, sf_dir), waiting, NOW)


def _backfill(spark: SparkSession, sf_dir: str) -> backfill.Backfill:
    """Markets without slugs or end dates; payloads of most, event payloads of the others."""
    key = F.col("market_id").cast("long")
    lacking = _listed(spark, sf_dir).withColumns({"slug": F.when(key % 3 != 0, F.col("slug")), "event_slug": F.when(key % 4 != 0, F.col("event_slug"))})
    p, k = bed.table(spark, sf_dir, "part"), F.col("p_partkey")
    event = F.struct(F.lit("e").alias("id"), F.when(k % 8 != 0, F.concat(F.lit("event-"), k)).alias("slug"))
    payloads = p.filter(k % 10 != 0).select(
        k.cast("string").alias("id"), F.array(F.concat(F.lit("n_"), k)).alias("clobTokenIds"), F.when(k % 6 != 0, F.concat(F.lit("new-"), k)).alias("slug"),
        F.lit("2024-09-01T12:00:00Z").alias("endDate"), F.lit(None).cast("string").alias("endDateIso"), F.array(event).alias("events"),
    )
    market = F.struct(k.cast("string").alias("id"), F.lit("q").alias("question"))
    events = p.filter(k % 24 == 0).select(k.alias("row_order"), F.lit("e").alias("id"), F.concat(F.lit("late-"), k).alias("slug"), F.array(market).alias("markets"))
    waiting = p.filter(k % 5 == 0).select(
        k.cast("string").alias("market_id"), F.lit("end_date").alias("field_name"), F.lit("before").alias("reason"), F.lit(2).alias("attempts"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("last_checked_at"), F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz").alias("next_retry_at"),
    )
    return backfill.backfill(lacking, payloads, events, waiting, NOW)


_BACKFILL = (
    with_tables("markets", "market_tokens")
    + """, m as (select market_id, market_id::bigint as k, clob_token_ids, case when market_id::bigint % 3 <> 0 then slug end as slug,
        case when market_id::bigint % 4 <> 0 then event_slug end as event_slug, end_date from markets join market_tokens using (market_id)),
    el as (select *, k % 10 <> 0 as returned from m where clob_token_ids = '[]' or slug is null or event_slug is null or (end_date is null and k % 5 <> 0)),
    f as (select market_id, k, returned, case when returned then '["n_' || k || '"]' end as tokens, case when returned and k % 6 <> 0 then 'new-' || k end as slug,
        case when returned and k % 8 <> 0 then 'event-' || k when returned and k % 24 = 0 then 'late-' || k end as event_slug,
        case when returned then timestamp '2024-09-01 12:00:00' end as end_date, returned and k % 24 = 0 as fallback from el) """
)


@query(
    _BACKFILL
    + """select m.market_id, coalesce(f.tokens, m.clob_token_ids) as clob_token_ids, coalesce(f.slug, m.slug) as slug, coalesce(f.event_slug, m.event_slug) as event_slug,
    coalesce(f.end_date, m.end_date) as end_date from m left join f using (market_id)"""
)
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backfill(spark, sf_dir).markets.select("market_id", "clob_token_ids", "slug", "event_slug", "end_date")


@query(
    _BACKFILL
    + f"""select p_partkey::varchar as market_id, 'end_date' as field_name, 'before' as reason, 2 as attempts, timestamp '2024-01-01' as last_checked_at,
    timestamp '2024-03-01' as next_retry_at from part where p_partkey % 5 = 0
    union all select market_id, 'event_slug', '{backfill.REASON}', 1, {_NOW}, {_NOW} + interval 168 hour from f where returned and event_slug is null"""
)
def backfill_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of before, and those of event slugs that neither kind of payload has."""
    return _backfill(spark, sf_dir).unresolved


@query(
    _BACKFILL
    + """select count(*) as eligible, count(tokens) as tokens, count(slug) as slug, count(event_slug) as event_slug, count(end_date) as end_date,
    (count(*) filter (where fallback))::bigint as fallback, (count(*) filter (where returned and event_slug is null))::bigint as unresolved from f"""
)
def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backfill(spark, sf_dir).counts()


def _payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they land, one JSON text each: keys beyond the schema, keys left out, and texts that are no objects."""
    k = F.col("p_partkey")
    event = F.struct(F.lit("9").alias("id"), F.concat(F.lit("ev-"), k % 7).alias("slug"))
    made = F.to_json(
        F.struct(
            k.cast("string").alias("id"), F.when(k % 3 != 0, F.col("p_name")).alias("question"), F.when(k % 4 != 0, F.array(F.lit("Yes"), F.lit("No"))).alias("outcomes"),
            F.when(k % 5 == 0, "much").otherwise(F.col("p_retailprice").cast("string")).alias("volumeNum"), (k % 2 == 0).alias("active"), F.lit("2024-01-02T03:04:05.678Z").alias("createdAt"),
            F.when(k % 6 != 0, "2024-05-06").alias("endDateIso"), F.when(k % 7 != 0, F.array(F.concat(F.lit("a"), k), F.concat(F.lit("b"), k))).alias("clobTokenIds"),
            F.concat(F.lit("slug-"), k).alias("slug"), F.when(k % 8 != 0, F.array(event, event)).alias("events"), F.lit("more").alias("unknownKey"),
        )
    )
    return bed.table(spark, sf_dir, "part").select(F.when(k % 9 == 0, "not json").otherwise(made).alias("value"))


@query(
    """select p_partkey::varchar as id, case when p_partkey % 3 <> 0 then p_name else '' end as question, '' as category, '' as description,
    case when p_partkey % 4 <> 0 then '["Yes", "No"]' else '[]' end as outcomes, case when p_partkey % 5 = 0 then 0 else p_retailprice end as volume, p_partkey % 2 = 0 as active,
    false as closed, timestamp '2024-01-02 03:04:05' as created_at, timestamp '2024-02-01' as scraped_at, case when p_partkey % 6 <> 0 then timestamp '2024-05-06' end as end_date,
    'slug-' || p_partkey as slug, case when p_partkey % 8 <> 0 then 'ev-' || p_partkey % 7 end as event_slug, case when p_partkey % 8 <> 0 then '9' end as event_id
    from part where p_partkey % 9 <> 0"""
)
def landed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as rows of ``raw.markets``: known keys, first events, whole seconds, defaults."""
    return landing.split_tokens(landing.shape_markets(landing.parsed_markets(_payload_lines(spark, sf_dir)), NOW), NOW)[0]


@query(
    """select p_partkey::varchar as market_id, '["a' || p_partkey || '", "b' || p_partkey || '"]' as "clobTokenIds", timestamp '2024-02-01' as updated_at
    from part where p_partkey % 9 <> 0 and p_partkey % 7 <> 0"""
)
def landed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.split_tokens(landing.shape_markets(landing.parsed_markets(_payload_lines(spark, sf_dir)), NOW), NOW)[1]


@query(
    with_tables("markets")
    + """select m.market_id, coalesce(case when m.market_id::bigint % 2 = 0 then m.slug end, case when m.market_id::bigint % 9 <> 0 then 'slug-' || m.market_id end) as slug,
    coalesce(case when m.market_id::bigint % 5 = 0 then m.event_slug end, case when m.market_id::bigint % 9 <> 0 and m.market_id::bigint % 8 <> 0 then 'ev-' || m.market_id::bigint % 7 end) as event_slug,
    coalesce(m.end_date, case when m.market_id::bigint % 9 <> 0 and m.market_id::bigint % 6 <> 0 then timestamp '2024-05-06' end) as end_date from markets m"""
)
def metadata_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with what they lack from payloads of their ids."""
    k = F.col("market_id").cast("long")
    lacking = _staged(spark, sf_dir).withColumns({"slug": F.when(k % 2 == 0, F.col("slug")), "event_slug": F.when(k % 5 == 0, F.col("event_slug"))})
    payloads = landing.parsed_markets(_payload_lines(spark, sf_dir))
    filled = landing.resolve_metadata(lacking.withColumnRenamed("market_id", "id"), payloads)
    return filled.select(F.col("id").alias("market_id"), "slug", "event_slug", "end_date")


@query(
    """with e as (select s_suppkey as row_order, s_suppkey::varchar as event_id, 'e-' || s_suppkey as event_slug, unnest([0, 1, 2]) as place from supplier),
    m as (select *, case when place = 1 and row_order % 4 = 0 then ' ' else ((row_order * 3 + place * 5) % 60)::varchar end as market_id from e)
    select market_id, arg_min(event_id, row_order * 10 + place) as event_id, arg_min(event_slug, row_order * 10 + place) as event_slug from m where trim(market_id) <> '' group by market_id"""
)
def event_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of event payloads; some are in several events, some have no id."""
    k = F.col("s_suppkey")
    market = lambda i: F.struct(F.when((F.lit(i) == 1) & (k % 4 == 0), " ").otherwise(((k * 3 + i * 5) % 60).cast("string")).alias("id"), F.lit("q").alias("question"))
    events = bed.table(spark, sf_dir, "supplier").select(k.alias("row_order"), k.cast("string").alias("id"), F.concat(F.lit("e-"), k).alias("slug"), F.array(*map(market, range(3))).alias("markets"))
    return planning.event_markets(events).select("market_id", "event_id", "event_slug")


@query(
    with_tables("markets", "market_tokens")
    + """select market_id, clob_token_ids, created_at, is_closed from markets join market_tokens using (market_id)
    where clob_token_ids <> '[]' and created_at >= timestamp '2024-01-10' and volume >= 20000 and volume < 120000"""
)
def markets_with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bed.market_tokens(spark, sf_dir).select("market_id", F.col("clobTokenIds").alias("clob_token_ids"))
    return planning.markets_with_tokens(_staged(spark, sf_dir), tokens, datetime(2024, 1, 10), admitted=scope.volume_band("volume", 20_000, 120_000))


@query(
    with_tables("ranked")
    + """select clob_token_id, odds_date_utc::timestamp as window_start, max(case when up = 1 then price end) as open_price, max(price) as high_price, min(price) as low_price,
    max(case when down = 1 then price end) as close_price, count(*) as observed_points from ranked where price between 0 and 1 and odds_timestamp_epoch > 0 group by all"""
)
def windowed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's tumbling windows over all observations at once."""
    got = ingest.windowed_ohlc(bed.history(spark, sf_dir))
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """select 'o_orderdate' as column_name, min(o_orderdate)::date::varchar as low, max(o_orderdate)::date::varchar as high, count(distinct o_orderdate)::bigint as n_distinct from orders
    union all select 'o_orderkey', min(o_orderkey)::varchar, max(o_orderkey)::varchar, count(distinct o_orderkey)::bigint from orders"""
)
def profile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest values as text, of times and of numbers."""
    rows = bed.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey")
    return profile.profile_table(rows, exact=True).select("column_name", "low", "high", "n_distinct")


# Profiles and counts --------------------------------------------------------------------------------------------------


@query("select event_type, count(*) as n_rows from events group by event_type order by n_rows desc, event_type limit 10")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(bed.table(spark, sf_dir, "events"), "event_type", 10)


def _profile_sql(table: str, columns: list[tuple[str, str, str]]) -> str:
    rows = []
    for name, kind, spark_type in columns:
        length = f"length({name})"
        low, high, mean = {"numeric": (f"min({name})", f"max({name})", f"avg({name})"), "text": (f"min({length})", f"max({length})", f"avg({length})"), "boolean": ("null", "null", "null")}[kind]
        flags = (f"count(*) filter (where {name})", f"count(*) filter (where not {name})") if kind == "boolean" else ("null", "null")
        rows.append(
            f"select '{name}' as column_name, '{spark_type}' as data_type, '{kind}' as kind, count(*) as n_rows, count(*) - count({name}) as n_nulls, "
            f"round(100.0 * (count(*) - count({name})) / count(*), 3)::double as null_percent, count(distinct {name}) as n_distinct, ({low})::varchar as low, ({high})::varchar as high, "
            f"round(({mean})::double, 6) as mean, ({flags[0]})::bigint as n_true, ({flags[1]})::bigint as n_false from {table}"
        )
    return " union all ".join(rows)


def _profiled(rows: DataFrame) -> DataFrame:
    return profile.profile_table(rows, exact=True).drop("deviation", "sample").withColumn("mean", F.round("mean", 6))


@query(_profile_sql("lineitem", [("l_orderkey", "numeric", "bigint"), ("l_linenumber", "numeric", "int"), ("l_partkey", "numeric", "bigint")]))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(bed.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))


@query(_profile_sql("documents", [("lang", "text", "string"), ("source", "text", "string"), ("n_chars", "numeric", "bigint")]))
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(bed.table(spark, sf_dir, "documents").select("lang", "source", "n_chars"))


@query(_profile_sql("(select quality = 1 as good, toxic = 1 as bad from labels)", [("good", "boolean", "boolean"), ("bad", "boolean", "boolean")]))
def profile_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(bed.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")))


@query("select round(stddev_samp(l_quantity), 6) as deviation, round(avg(l_quantity), 6) as mean from lineitem")
def profile_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile_table(bed.table(spark, sf_dir, "lineitem").select("l_quantity"), "full")
    return p.select(F.round("deviation", 6).alias("deviation"), F.round("mean", 6).alias("mean"))


@query()
def profile_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches differ between engines, so there is no SQL."""
    return profile.profile_table(bed.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"))


@query(
    with_tables("odds")
    + """select 'clob_token_id' as name, count(distinct clob_token_id)::bigint as exact, true as within from odds
    union all select 'odds_timestamp_epoch', count(distinct odds_timestamp_epoch)::bigint, true from odds"""
)
def sketched_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by day, united: within six standard errors of the exact number."""
    history, names = bed.history(spark, sf_dir), ["clob_token_id", "odds_timestamp_epoch"]
    daily = profile.distinct_sketches(history.withColumn("day", F.floor(F.col("odds_timestamp_epoch") / 86_400)), "day", *names)
    about = profile.united_distinct(daily, *names)
    exact = history.agg(*(F.countDistinct(c).alias(c) for c in names))
    listed = lambda df, n: df.select(F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c))))).alias("name", n))
    both = listed(exact, "exact").join(listed(about, "about"), "name")
    return both.select("name", "exact", (F.abs(F.col("about") - F.col("exact")) <= 6 * 0.83 / 2 ** (profile.SKETCH_BITS / 2) * F.col("exact")).alias("within"))


_SNAPSHOT = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(
    " union all ".join(f"select '{t}' as model, '{t}.parquet' as relation, true as exists, count(*) as row_count, null::varchar as error from {t}" for t in _SNAPSHOT)
    + " union all select 'nowhere', 'nowhere.parquet', false, null, 'AnalysisException'"
)
def model_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which relations are there and how many rows each has, by footers alone."""
    names = {n: f"{n}.parquet" for n in (*_SNAPSHOT, "nowhere")}
    return observe.model_snapshot(spark, names, lambda relation: spark.read.parquet(f"{sf_dir}/{relation}"))


@query("select 'nation' as table_name, count(*) as n_rows, false as missing from nation union all select 'region', count(*), false from region union all select 'nowhere', null, true")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_counts({"nation": bed.table(spark, sf_dir, "nation"), "region": bed.table(spark, sf_dir, "region"), "nowhere": None})


@query(with_tables("skips") + "select reason, count(*) as n_rows from skips group by reason order by n_rows desc, reason")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(_states(spark, sf_dir)[1], "reason")


@query(
    with_tables("tokens", "odds")
    + """select 'market_tokens_without_history' as hole, count(distinct clob_token_id) as n_tokens from tokens where clob_token_id not in (select clob_token_id from odds)
    union all select 'history_tokens_without_market_tokens', count(distinct clob_token_id) from odds where clob_token_id not in (select clob_token_id from tokens)"""
)
def coverage_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, history = models.stg_market_tokens(bed.market_tokens(spark, sf_dir)), bed.history(spark, sf_dir)
    hole = lambda a, b, name: a.join(b, "clob_token_id", "left_anti").agg(F.lit(name).alias("hole"), F.countDistinct("clob_token_id").alias("n_tokens"))
    return hole(tokens, history, "market_tokens_without_history").unionByName(hole(history, tokens, "history_tokens_without_market_tokens"))


@query("select n_nationkey, case when n_regionkey = 0 then null else round(n_nationkey::double / n_regionkey, 4) end as ratio from nation")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bed.table(spark, sf_dir, "nation").select("n_nationkey", guarded_ratio("n_nationkey", "n_regionkey", 4).alias("ratio"))


@query("select o_orderstatus, count(*) as n_rows, count(distinct o_custkey) as n_customers, (count(*) filter (where o_totalprice > 150000))::bigint as n_large from orders group by o_orderstatus")
def counts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bed.table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_totalprice") > 150_000).alias("n_large"))


@query(
    with_tables("tokens", "odds", "ledger")
    + """select *, round(history_tokens::double / market_tokens, 4) as history_ratio, round(daily_tokens::double / market_tokens, 4) as daily_ratio,
    round(ledger_tokens::double / market_tokens, 4) as ledger_ratio, round(checked_tokens::double / market_tokens, 4) as checked_ratio from
    (select (select count(distinct clob_token_id) from tokens) as market_tokens, (select count(distinct clob_token_id) from odds) as history_tokens,
    (select count(distinct clob_token_id) from odds) as daily_tokens, (select count(distinct clob_token_id) from ledger) as ledger_tokens,
    (select count(distinct clob_token_id) from ledger where is_fully_checked) as checked_tokens)"""
)
def planning_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, history = models.stg_market_tokens(bed.market_tokens(spark, sf_dir)), bed.history(spark, sf_dir)
    return observe.planning_ratios(tokens, history, ohlc.daily_ohlc(history), _states(spark, sf_dir)[0])


@query(
    with_tables("markets", "registry")
    + """select count(*) as n_markets, (count(*) filter (where r))::bigint as n_registered, (count(*) filter (where l))::bigint as n_listed, (count(*) filter (where l and not r))::bigint as n_listed_only
    from (select market_id in (select market_id from registry) as r, event_slug in ('brand#12', 'brand#34') or starts_with(event_slug, 'brand#5') as l from markets)"""
)
def scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.scope_audit(_staged(spark, sf_dir), bed.market_registry(spark, sf_dir), bed.SCOPE)


@query(
    " union all ".join(
        f"select '{m.name}' as model, '{m.layer}.{m.name}' as relation, true as exists, count(*) as row_count, null::varchar as error from ({ORACLE_SQL[m.name]})"
        for m in models.models(bed.SCOPE)
        if m.name in ORACLE_SQL
    )
)
def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 19 models as one query of counts, as after a build."""
    return models.snapshot(spark, _published(spark, sf_dir), bed.SCOPE)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of several sources, some markets in two of them."""
    registry, key = bed.market_registry(spark, sf_dir), F.col("market_id").cast("long")
    more = registry.filter(key % 22 == 0).withColumn("source", F.when(key % 44 == 0, "events_api"))
    return registry.unionByName(more)


_SOURCES = """, sources as (select p_partkey::varchar as market_id, 'seed' as source from part where p_partkey % 11 = 0
    union all select p_partkey::varchar, case when p_partkey % 44 = 0 then 'events_api' else 'unknown' end from part where p_partkey % 22 = 0) """


@query(with_tables("markets") + _SOURCES + "select source, count(*) as n_rows, count(distinct market_id) as n_markets from sources group by source")
def registry_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.count_by_source(_sources(spark, sf_dir))


@query(
    with_tables("markets")
    + _SOURCES
    + """select coalesce(source, 'none') as source, count(*) as n_markets, (count(*) filter (where source is not null and not l))::bigint as n_registered_only,
    (count(*) filter (where l))::bigint as n_listed, (count(*) filter (where l and source is null))::bigint as n_listed_only
    from (select m.*, s.source, event_slug in ('brand#12', 'brand#34') or starts_with(event_slug, 'brand#5') as l from markets m left join sources s using (market_id)) group by 1"""
)
def scope_audit_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.scope_audit_by_source(_staged(spark, sf_dir), _sources(spark, sf_dir), bed.SCOPE)


@query(
    with_tables("tokens", "odds")
    + """select clob_token_id, 'left' as side from (select clob_token_id from tokens except select clob_token_id from odds)
    union all select clob_token_id, 'right' from (select clob_token_id from odds except select clob_token_id from tokens)"""
)
def key_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.key_gaps(models.stg_market_tokens(bed.market_tokens(spark, sf_dir)), bed.history(spark, sf_dir), "clob_token_id")


@query("select tag, count(distinct doc_id) as n_events from (select doc_id, unnest([lang, source, lang]) as tag from documents) group by tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bed.table(spark, sf_dir, "documents")
    return observe.tag_counts(d.select(F.col("doc_id").alias("id"), F.array("lang", "source", "lang").alias("tags")))


# Data quality: violations in rows that are spoilt on purpose ----------------------------------------------------------


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows, some with their high and low exchanged or their prices out of bounds."""
    daily = ohlc.daily_ohlc(bed.history(spark, sf_dir))
    bad = F.col("first_timestamp") % 9 == 0
    return daily.select(
        "clob_token_id", "odds_date_utc", "open_price", F.when(bad, F.col("low_price") - 1).otherwise(F.col("high_price")).alias("high_price"),
        "low_price", "close_price", "avg_price", "observed_points", "first_timestamp", "last_timestamp",
    )


_SPOILT = with_tables("daily") + ", spoilt as (select * exclude (high_price), case when first_timestamp % 9 = 0 then low_price - 1 else high_price end as high_price from daily) "


@query(
    _SPOILT
    + """select clob_token_id, odds_date_utc from spoilt where open_price < low_price or open_price > high_price or close_price < low_price or close_price > high_price
    or avg_price < low_price or avg_price > high_price or observed_points < 1 or first_timestamp > last_timestamp"""
)
def dq_ohlc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ohlc_order(_spoilt(spark, sf_dir)).select("clob_token_id", "odds_date_utc")


@query(_SPOILT + "select clob_token_id, odds_date_utc from spoilt where high_price < 0 or high_price > 1 or low_price < 0 or low_price > 1 or high_price < low_price")
def dq_ohlc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ohlc_bounds(_spoilt(spark, sf_dir)).select("clob_token_id", "odds_date_utc")


@query("select l_partkey, l_suppkey, count(*) as n_rows from lineitem where l_quantity > 10 group by 1, 2 having count(*) > 1")
def dq_duplicate_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_grain(bed.table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_quantity") > 10)


@query("select o_custkey, count(*) as n_rows from orders group by 1 having count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique(bed.table(spark, sf_dir, "orders"), "o_custkey")


@query(with_tables("skips") + "select clob_token_id, reason from skips where reason is null")
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_null(_states(spark, sf_dir)[1], "reason")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20)")
def dq_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = bed.table(spark, sf_dir, "customer").filter("c_nationkey < 20")
    return quality.relationship(bed.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query("select event_id from events where value / 300 < 0 or value / 300 > 1 or value / 400 > 1")
def dq_unit_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bed.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 300).alias("a"), (F.col("value") / 400).alias("b"))
    return quality.outside_unit(e, ["a", "b"]).select("event_id")


@query("select max(ts) as last_loaded_at, (date_diff('second', max(ts), max(ts)::date + interval 40 hour) // 3600)::bigint as age_hours, case when date_diff('second', max(ts), max(ts)::date + interval 40 hour) // 3600 >= 72 then 'error' when date_diff('second', max(ts), max(ts)::date + interval 40 hour) // 3600 >= 12 then 'warn' else 'pass' end as status from events")
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the second day's afternoon after the last event."""
    e = bed.table(spark, sf_dir, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("d")).first()["d"]
    from datetime import timedelta

    return quality.freshness(e, "ts", datetime(last.year, last.month, last.day) + timedelta(hours=40), 12, 72)


def _shifted(spark: SparkSession, sf_dir: str, name: str, changes: dict) -> DataFrame:
    return _frames(spark, sf_dir, name)[name].withColumns(changes)


@query(with_tables("coverage") + "select clob_token_id from coverage where max_gap_days - 1 < 0")
def dq_negative_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "token_coverage", {"max_gap_days": F.col("max_gap_days") - 1})
    return quality.negative(rows, ["max_gap_days", "avg_gap_days"]).select("clob_token_id")


@query(with_tables("coverage") + "select clob_token_id from coverage where has_daily_odds = 1")
def dq_coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of days set to 0, each token that has odds disagrees."""
    return quality.coverage_disagreement(_shifted(spark, sf_dir, "token_coverage", {"token_days_observed": F.lit(0)})).select("clob_token_id")


@query(with_tables("coverage") + "select clob_token_id from coverage where market_fully_checked_tokens + 1 > market_token_count")
def dq_checked_above_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "token_coverage", {"market_fully_checked_tokens": F.col("market_fully_checked_tokens") + 1})
    return quality.checked_above_count(rows).select("clob_token_id")


@query(with_tables("coverage") + "select clob_token_id from coverage where market_fully_checked")
def dq_checked_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.checked_flag_wrong(_shifted(spark, sf_dir, "token_coverage", {"market_fully_checked": F.lit(False)})).select("clob_token_id")


@query(with_tables("coverage") + ", m as (select market_id, question, event_slug, min(first_odds_date) as f, max(last_odds_date) as l from coverage group by all) select market_id from m where f > l - 1000")
def dq_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "market_coverage", {"last_odds_date": F.date_sub("last_odds_date", 1000)})
    return quality.date_order(rows).select("market_id")


@query(with_tables("coverage") + "select market_id from coverage group by market_id having max(has_daily_odds) = 1")
def dq_odds_without_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "market_coverage", {"last_odds_date": F.lit(None).cast("date")})
    return quality.odds_without_bounds(rows).select("market_id")


@query(with_tables("coverage") + "select market_id from coverage group by market_id having max(has_daily_odds) = 1")
def dq_odds_without_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.odds_without_tokens(_shifted(spark, sf_dir, "market_coverage", {"token_count": F.lit(0)})).select("market_id")


@query(
    with_tables("coverage")
    + ", m as (select market_id, question, event_slug, count(*) as n from coverage group by all) select market_id, question, event_slug, case when n_odd then n + 1 else n end as token_count_actual, n as token_count_expected from (select *, market_id::bigint % 2 = 1 as n_odd from m) where n_odd"
)
def dq_rollup_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of odd ids count one token too many."""
    frames = _frames(spark, sf_dir, "market_coverage")
    rows = frames["market_coverage"].withColumn("token_count", F.col("token_count") + F.col("market_id").cast("long") % 2)
    return quality.rollup_mismatch(rows, models.market_coverage(frames["token_coverage"]), ["market_id", "question", "event_slug"], ["token_count"])


@query(with_tables("runs") + "select run_id from runs where task_name <> 'other' and n % 2 > n - 5")
def dq_http_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.http_counts(_shifted(spark, sf_dir, "run_observability", {"http_requests": F.col("http_requests") - 5})).select("run_id")


@query(with_tables("runs") + "select run_id from runs where task_name <> 'other' and (n % 7 - 1 < 0)")
def dq_run_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "run_observability", {"processed_tokens": F.col("processed_tokens") - 1})
    return quality.negative(rows, ["processed_tokens", "rows_fetched"]).select("run_id")


@query(with_tables("runs") + "select run_id from runs where task_name <> 'other' and n - 20 < n % 7")
def dq_planned_below_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shifted(spark, sf_dir, "run_observability", {"planned_tokens": F.col("planned_tokens") - 20})
    return quality.planned_below_processed(rows).select("run_id")


@query(with_tables("runs") + "select run_id from runs where task_name <> 'other' and n % 7 <> 0 and n % 2 = 0")
def dq_ratio_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.when(F.col("is_noop"), F.col("rows_per_processed_token") + 0.001).otherwise(F.col("rows_per_processed_token"))
    rows = _shifted(spark, sf_dir, "run_observability", {"rows_per_processed_token": off})
    return quality.ratio_mismatch(rows, "rows_fetched", "processed_tokens", "rows_per_processed_token").select("run_id")


@query(with_tables("series") + "select clob_token_id, odds_timestamp_epoch from series where price is not null and odds_timestamp_epoch % 2 = 0")
def dq_price_without_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("odds_timestamp_epoch") % 2 != 0, F.col("odds_timestamp"))
    rows = _shifted(spark, sf_dir, "int_token_timeseries", {"odds_timestamp": cut})
    return quality.price_without_time(rows).select("clob_token_id", "odds_timestamp_epoch")


@query(with_tables("universe", "tokens") + "select a as n_left, b as n_right from (select count(*) as a from universe) join (select count(*) as b from tokens where outcome_index = 0) on a <> b")
def dq_count_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir, "int_token_universe")
    return quality.count_parity(frames["int_token_universe"], frames["stg_market_tokens"].filter("outcome_index = 0"))


@query(with_tables("coverage") + "select clob_token_id, token_days_observed + 1 as token_days_observed, token_days_observed as expected_days from coverage where token_days_observed > 0")
def dq_days_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir, "token_coverage")
    days = F.when(F.col("token_days_observed") > 0, F.col("token_days_observed") + 1).otherwise(F.col("token_days_observed"))
    return quality.days_mismatch(frames["token_coverage"].withColumn("token_days_observed", days), frames["int_token_daily_timeseries"])


@query(with_tables("minutely") + "select clob_token_id, odds_timestamp_epoch, case when odds_timestamp_epoch % 5 = 0 then 'missing' else 'value_mismatch' end as mismatch_type from minutely where market_volume_usd >= 100000 and (odds_timestamp_epoch % 5 = 0 or odds_timestamp_epoch % 7 = 0)")
def dq_subset_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir, "whale_minutely_odds")
    at = F.col("odds_timestamp_epoch")
    whole = frames["scoped_minutely_odds"].filter(at % 5 != 0).withColumn("price", F.when(at % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return quality.subset_mismatch(frames["whale_minutely_odds"], whole, ["clob_token_id", "odds_timestamp_epoch"], "price")


@query(with_tables("markets") + "select market_id from markets where coalesce(volume, 0) < 100000")
def dq_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.below_threshold(_staged(spark, sf_dir), "volume", scope.BIG_VOLUME).select("market_id")


@query(
    with_tables("scoped")
    + """select market_id, case when market_id::bigint % 5 = 0 then 'mart_only' when market_id::bigint % 7 = 0 then 'expected_only' else 'value_mismatch' end as mismatch_type
    from scoped where (market_id::bigint % 5 = 0) <> (market_id::bigint % 7 = 0) or (market_id::bigint % 5 <> 0 and market_id::bigint % 11 = 0)"""
)
def dq_scope_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the scoped markets, multiples of 5 are not expected, of 7 are missing, of 11 have another volume."""
    rows = _frames(spark, sf_dir, "int_scoped_markets")["int_scoped_markets"].select("market_id", "volume")
    key = F.col("market_id").cast("long")
    expected = rows.filter(key % 5 != 0).withColumn("volume", F.when(key % 11 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return quality.scope_mismatch(rows.filter(key % 7 != 0), expected, ["market_id"], ["volume"])


@query()
def model_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of all models: a row for each with the number of violations."""
    return models.violations(_published(spark, sf_dir), bed.SCOPE)
