"""The driver's test tables in the shape of raw and operational tables, in Spark and as DuckDB common table expressions.

``events`` stand for price observations, ``part`` for markets with two tokens each, ``customer`` for the sync ledger,
``supplier`` for skips, and ``events`` once more for run events.
"""

from __future__ import annotations

from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import epoch_of, epoch_to_timestamp
from tidemark.operators.ohlc import daily_ohlc
from tidemark.operators.scope import Scope

SCOPE = Scope(slugs=("Brand#12", "brand#34"), prefixes=("brand#5",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    created = F.lit(1_704_067_200).cast("long") + size * 86_400
    return p.select(
        key.cast("string").alias("id"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("about "), "p_name").alias("description"),
        F.lit('["Yes","No"]').alias("outcomes"),
        (F.col("p_retailprice") * 100 + size % 3 * 20_000).alias("volume"),
        (size % 2 == 0).alias("active"),
        (size % 5 == 0).alias("closed"),
        epoch_to_timestamp(created).alias("created_at"),
        epoch_to_timestamp(created + 3_600).alias("scraped_at"),
        F.when(size % 7 != 0, epoch_to_timestamp(created + size * 86_400)).alias("end_date"),
        F.concat(F.lit("part-"), key).alias("slug"),
        F.lower("p_brand").alias("event_slug"),
        (size % 10).cast("string").alias("event_id"),
    )


def market_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    listed = F.concat(F.lit('["'), key * 2, F.lit('","'), key * 2 + 1, F.lit('"]'))
    tokens = F.when(F.col("p_size") == 13, F.lit("[]")).otherwise(listed)
    return p.select(key.cast("string").alias("market_id"), tokens.alias("clobTokenIds"), epoch_to_timestamp(F.lit(1_704_067_200).cast("long")).alias("updated_at"))


def odds_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("clobTokenId"),
        epoch_of("ts").alias("timestamp"),
        (F.col("value") / 1000).alias("price"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ingested_at"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations under their modelled names."""
    raw = odds_history(spark, sf_dir)
    return raw.select(F.col("clobTokenId").alias("clob_token_id"), F.col("timestamp").alias("odds_timestamp_epoch"), "price")


def sync_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    seen = F.lit(1_704_067_200).cast("long") + key * 60
    return c.select(
        key.cast("string").alias("clobTokenId"),
        F.when(nation % 6 != 0, seen).alias("last_sync_timestamp"),
        (nation % 3 == 0).alias("fully_checked"),
        epoch_to_timestamp(seen + 600).alias("last_checked_at"),
        F.when(nation % 4 == 0, epoch_to_timestamp(seen + 86_400)).alias("next_check_at"),
        F.when(nation % 5 != 0, nation % 8).cast("int").alias("empty_run_streak"),
    )


def sync_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    reason = F.when(F.col("s_nationkey") % 7 != 0, F.concat(F.lit("reason "), F.col("s_nationkey") % 4))
    at = epoch_to_timestamp(F.lit(1_704_067_200).cast("long") + F.col("s_suppkey"))
    return s.select((F.col("s_suppkey") * 3).cast("string").alias("clobTokenId"), reason.alias("reason"), at.alias("created_at"))


def market_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 11 == 0)
    return p.select(
        F.col("p_partkey").cast("string").alias("market_id"), F.lit(None).cast("string").alias("event_slug"),
        F.lit(None).cast("string").alias("event_id"), F.lit("seed").alias("source"), epoch_to_timestamp(F.lit(1_704_067_200).cast("long")).alias("refreshed_at"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    task = F.when(F.col("event_id") % 3 == 0, "sync_odds").when(F.col("event_id") % 3 == 1, "reconcile_odds_ledger").otherwise("other")
    text = F.concat(
        F.lit('{"tokens": '), n % 7, F.lit(', "rows": '), n * 10, F.lit(', "errors": '), n % 3, F.lit(', "http_requests": '), n, F.lit(', "http_429": '), n % 2,
        F.lit(', "noop": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "duration_seconds": '), n, F.lit('.5, "planning": {"plans": '), n,
        F.lit(', "dup_token": null}, "planning_context": {"ledger_distinct_tokens": "x", "planned_vs_market_tokens": 0.25}}'),
    )
    return e.select(F.col("event_id").cast("string").alias("run_id"), task.alias("task_name"), F.col("ts").alias("recorded_at"), text.alias("metrics_json"))


def token_odds_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_ohlc(history(spark, sf_dir)).withColumnRenamed("clob_token_id", "clobTokenId")
    return daily.withColumn("refreshed_at", F.lit(None).cast("timestamp_ntz"))


RAW = {
    "raw.markets": markets,
    "raw.market_tokens": market_tokens,
    "raw.odds_history": odds_history,
    "raw.token_odds_daily": token_odds_daily,
    "ops.token_sync_ledger": sync_ledger,
    "ops.token_sync_skips": sync_skips,
    "ops.pipeline_run_events": run_events,
    "ops.market_registry": market_registry,
}


def raw_tables(spark: SparkSession, sf_dir: str, names: Container[str] = RAW) -> dict[str, DataFrame]:
    """The named tables, all by default."""
    return {name: make(spark, sf_dir) for name, make in RAW.items() if name in names}


#: The same tables, and the models made of them, as bodies of common table expressions. Each may use earlier ones.
CTE = {
    "markets": """
        select p_partkey::varchar as market_id, p_name as question, p_type as category, 'about ' || p_name as description,
               '["Yes","No"]' as outcomes, p_retailprice * 100 + p_size % 3 * 20000 as volume, p_size % 2 = 0 as is_active, p_size % 5 = 0 as is_closed,
               timestamp '2024-01-01' + p_size * interval 1 day as created_at,
               timestamp '2024-01-01 01:00:00' + p_size * interval 1 day as scraped_at,
               case when p_size % 7 <> 0 then timestamp '2024-01-01' + 2 * p_size * interval 1 day end as end_date,
               'part-' || p_partkey as slug, lower(p_brand) as event_slug, (p_size % 10)::varchar as event_id
        from part""",
    "market_tokens": """
        select p_partkey::varchar as market_id, timestamp '2024-01-01' as updated_at,
               case when p_size = 13 then '[]' else '["' || p_partkey * 2 || '","' || (p_partkey * 2 + 1) || '"]' end as clob_token_ids
        from part""",
    "tokens": """
        select market_id, (i - 1)::int as outcome_index, updated_at, json_extract_string(clob_token_ids, '$[' || (i - 1) || ']') as clob_token_id
        from (select *, unnest(generate_series(1, json_array_length(clob_token_ids)::bigint)) as i from market_tokens)""",
    "odds": """
        select user_id::varchar as clob_token_id, epoch_us(ts) // 1000000 as odds_timestamp_epoch, value / 1000 as price,
               ts + interval 1 hour as ingested_at, make_timestamp(epoch_us(ts) // 1000000 * 1000000) as odds_timestamp
        from events""",
    "ranked": """
        select *, (date '1970-01-01' + (odds_timestamp_epoch // 86400)::int)::date as odds_date_utc,
               row_number() over (partition by clob_token_id, odds_timestamp_epoch // 86400 order by odds_timestamp_epoch, price) as up,
               row_number() over (partition by clob_token_id, odds_timestamp_epoch // 86400 order by odds_timestamp_epoch desc, price desc) as down
        from odds""",
    "daily": """
        select clob_token_id, odds_date_utc, max(case when up = 1 then price end) as open_price, max(price) as high_price,
               min(price) as low_price, max(case when down = 1 then price end) as close_price,
               least(max(price), greatest(min(price), round(avg(price), 8))) as avg_price, count(*) as observed_points,
               min(odds_timestamp_epoch) as first_timestamp, max(odds_timestamp_epoch) as last_timestamp
        from ranked group by clob_token_id, odds_date_utc""",
    "ledger": """
        select c_custkey::varchar as clob_token_id, case when c_nationkey % 6 <> 0 then 1704067200 + c_custkey * 60 end as last_sync_timestamp,
               timestamp '2024-01-01 00:10:00' + c_custkey * interval 1 minute as last_checked_at,
               case when c_nationkey % 4 = 0 then timestamp '2024-01-02' + c_custkey * interval 1 minute end as next_check_at,
               c_nationkey % 3 = 0 as is_fully_checked,
               case when c_nationkey % 6 <> 0 then timestamp '2024-01-01' + c_custkey * interval 1 minute end as last_sync_at,
               coalesce(case when c_nationkey % 5 <> 0 then c_nationkey % 8 end, 0)::int as empty_run_streak
        from customer""",
    "skips": """
        select (s_suppkey * 3)::varchar as clob_token_id, case when s_nationkey % 7 <> 0 then 'reason ' || s_nationkey % 4 end as reason,
               timestamp '2024-01-01' + s_suppkey * interval 1 second as created_at
        from supplier""",
    "registry": "select p_partkey::varchar as market_id from part where p_partkey % 11 = 0",
    "universe": """
        select m.market_id, t.outcome_index, t.clob_token_id, t.updated_at as token_updated_at, m.question, m.event_slug, m.is_active,
               m.is_closed, m.volume as market_volume_usd, json_extract_string(m.outcomes, '$[' || t.outcome_index || ']') as outcome_label
        from tokens t join markets m using (market_id)""",
    "scoped": """
        select *, true as is_target from markets m
        where market_id in (select market_id from registry) or event_slug in ('brand#12', 'brand#34') or starts_with(event_slug, 'brand#5')""",
    "series": """
        select u.market_id, u.outcome_index, u.clob_token_id, u.question, u.event_slug, u.is_active, u.is_closed,
               o.odds_timestamp, o.odds_timestamp_epoch, o.price
        from universe u left join odds o using (clob_token_id)""",
    "daily_series": """
        select u.market_id, u.outcome_index, u.clob_token_id, u.question, u.event_slug, u.is_active, u.is_closed, d.odds_date_utc,
               d.open_price, d.high_price, d.low_price, d.close_price, d.avg_price, d.observed_points, d.first_timestamp,
               make_timestamp(d.first_timestamp * 1000000) as first_observed_at, d.last_timestamp,
               make_timestamp(d.last_timestamp * 1000000) as last_observed_at
        from universe u left join daily d using (clob_token_id)""",
    "minutely": """
        select u.market_id, u.outcome_index, u.clob_token_id, u.question, u.outcome_label, u.event_slug, u.is_active, u.is_closed,
               u.market_volume_usd, o.odds_timestamp, o.odds_timestamp_epoch, o.price
        from universe u join odds o using (clob_token_id) where u.market_id in (select market_id from scoped) and o.price is not null""",
    "coverage": """
        select u.clob_token_id, u.market_id, u.outcome_index, u.question, u.event_slug, u.is_active, u.is_closed, a.first_odds_date,
               a.last_odds_date, l.is_fully_checked, l.last_sync_timestamp, l.last_sync_at, l.last_checked_at, l.next_check_at,
               l.empty_run_streak, s.reason as skip_reason, s.created_at as skip_created_at, s.reason is not null as has_persisted_skip,
               coalesce(g.max_gap_days, 0)::bigint as max_gap_days, coalesce(g.avg_gap_days, 0)::double as avg_gap_days,
               coalesce(h.n, 0)::bigint as market_token_count, coalesce(h.checked, 0)::bigint as market_fully_checked_tokens,
               coalesce(a.days, 0)::bigint as token_days_observed, coalesce(a.points, 0)::bigint as sum_observed_points,
               coalesce(h.n > 0 and h.n = h.checked, false) as market_fully_checked, (coalesce(a.days, 0) > 0)::int as has_daily_odds
        from universe u
        left join (select clob_token_id, min(odds_date_utc) as first_odds_date, max(odds_date_utc) as last_odds_date, count(*) as days,
                          sum(observed_points) as points from daily group by clob_token_id) a using (clob_token_id)
        left join ledger l using (clob_token_id)
        left join skips s using (clob_token_id)
        left join (select clob_token_id, max(coalesce(gap, 0)) as max_gap_days, coalesce(avg(nullif(gap, 0)), 0) as avg_gap_days
                   from (select clob_token_id, date_diff('day', lag(odds_date_utc) over (partition by clob_token_id order by odds_date_utc), odds_date_utc) as gap
                         from daily) group by clob_token_id) g using (clob_token_id)
        left join (select u2.market_id, count(*) as n, sum(case when l2.is_fully_checked then 1 else 0 end) as checked
                   from universe u2 left join ledger l2 using (clob_token_id) group by u2.market_id) h on u.market_id = h.market_id""",
    "runs": """
        select event_id::varchar as run_id,
               case event_id % 3 when 0 then 'sync_odds' when 1 then 'reconcile_odds_ledger' else 'other' end as task_name,
               ts as recorded_at, json_extract_string(props, '$.k')::bigint as n
        from events""",
}


def with_tables(*names: str) -> str:
    """A ``with`` clause of the named expressions and those before them that they may use."""
    order = list(CTE)
    last = max(map(order.index, names))
    used, text = set(names), ""
    for name in reversed(order[: last + 1]):
        if name in used:
            used |= {n for n in order[: order.index(name)] if f" {n} " in f"{CTE[name]} " or f" {n})" in CTE[name]}
    text = ", ".join(f"{n} as ({CTE[n]})" for n in order if n in used)
    return f"with {text} "
