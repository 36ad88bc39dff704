"""Which tokens to sync, over which range, and what their state is afterwards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import backoff, epoch_of, json_list, json_list_guard, plain_timestamp, plausible_token
from tidemark.operators.ohlc import EPOCH, TOKEN
from tidemark.operators.ordered import paged
from tidemark.operators.scope import token_due, volume_band
from tidemark.operators.upsert import merge_monotonic
from tidemark.sources.scratch import kept

OUTCOMES = (
    "dup_token", "invalid_token", "persisted_skip", "closed_done", "empty_cache_skip", "recent_skip", "already_current", "plan",
)


def explode_tokens(markets: DataFrame, trim: bool = True) -> DataFrame:
    """A row for each token of each market's JSON list, with its place ``outcome_index``; other lists give none."""
    listed = markets.filter(json_list_guard("clob_token_ids"))
    rows = listed.select("*", F.posexplode(json_list("clob_token_ids")).alias("outcome_index", TOKEN))
    token = F.trim(TOKEN) if trim else F.col(TOKEN)
    return rows.withColumn(TOKEN, token).filter(F.coalesce(F.col(TOKEN) != "", F.lit(False)))


def markets_with_tokens(
    markets: DataFrame, tokens: DataFrame, created_from: datetime | None = None, lists_only: bool = True, admitted: Column | None = None
) -> DataFrame:
    """The full mode's markets: ``market_id``, ``clob_token_ids``, ``created_at`` and ``is_closed`` of those with a list of tokens.

    ``lists_only``: texts that don't begin as a list are out, too. ``admitted``: a condition on the market's columns, such as its
    scope, volume or end; null admits none.
    """
    text = F.col("clob_token_ids")
    some = text.isNotNull() & (text != "[]")
    if lists_only:
        some &= F.ltrim(text).startswith("[")
    if created_from is not None:
        some &= F.col("created_at") >= F.lit(created_from).cast("timestamp_ntz")
    if admitted is not None:
        some &= admitted
    joined = tokens.select("market_id", "clob_token_ids").join(markets, "market_id").filter(F.coalesce(some, F.lit(False)))
    return joined.select("market_id", "clob_token_ids", "created_at", "is_closed")


def due_tokens(markets: DataFrame, ledger: DataFrame, skips: DataFrame, now: datetime, created_from: datetime | None = None) -> DataFrame:
    """(market, token) pairs that are due: not skipped, not closed and fully checked, not waiting for a later check."""
    joined = explode_tokens(markets).join(ledger, TOKEN, "left").join(skips.select(TOKEN, "reason"), TOKEN, "left")
    return joined.filter(token_due(now, created_from))


def candidate_counts(markets: DataFrame, condition: Column) -> DataFrame:
    """Markets under a condition and the tokens they list: an upper bound of the work."""
    listed = markets.filter(json_list_guard("clob_token_ids") & condition)
    tokens = F.coalesce(F.sum(F.json_array_length("clob_token_ids")), F.lit(0)).cast("long")
    return listed.agg(F.count("*").alias("market_count"), tokens.alias("token_count"))


def exclusion_counts(due: DataFrame, in_scope: Column, open_still: Column) -> DataFrame:
    """Due pairs that a scope and a grace period leave out, in one pass; the ended ones are counted within the scope."""
    return due.agg(
        F.count_if(~in_scope).alias("scope_skipped"), F.count_if(in_scope & ~open_still).alias("ended_skipped")
    )


@dataclass(frozen=True)
class PlanRules:
    """Times in epoch seconds, spans in seconds. ``force``, ``rebuild`` and a ``floor`` pass over what would skip a token:
    its skip, its end, its budget of empty runs. ``rebuild`` starts at the token's creation, ``floor`` no earlier than it.
    Budgets count only if ``skip_runs`` is above 0."""

    now: int
    overlap: int = 300
    recent: int = 900
    skip_runs: int = 2
    floor: int | None = None
    force: bool = False
    rebuild: bool = False


def classify_plans(tokens: DataFrame, rules: PlanRules) -> DataFrame:
    """Each candidate's ``outcome`` and, for plans, ``start_ts`` and ``end_ts``; the first rule that holds decides.

    Columns: ``arrival``, ``clob_token_id``, ``created_ts``, ``cursor``, ``reason``, ``is_closed``, ``fully_checked``,
    ``empty_run_streak``, ``skip_budget`` (empty runs that the token may still be passed over for; null: none). Later
    arrivals of a token are duplicates. ``skip_budget`` comes back as what is left of it.
    """
    go = F.lit(rules.force or rules.rebuild or rules.floor is not None)
    flag = lambda c: F.coalesce(c, F.lit(False))
    cursor, created = F.col("cursor"), F.col("created_ts")
    if rules.rebuild:
        start, recent = created, F.lit(False)
    elif rules.floor is not None:
        start, recent = F.greatest(created, F.lit(rules.floor)), F.lit(False)
    else:
        start = F.when(cursor.isNull(), created).otherwise(F.greatest(created, cursor - rules.overlap))
        recent = flag(F.lit(rules.now) - cursor < rules.recent) & F.lit(not rules.force)
    spare = F.coalesce("skip_budget", F.lit(0))
    spent = (spare > 0) & ~go & F.lit(rules.skip_runs > 0)
    named = (
        (F.row_number().over(Window.partitionBy(TOKEN).orderBy("arrival")) > 1, "dup_token"),
        (~plausible_token(TOKEN), "invalid_token"),
        (F.col("reason").isNotNull() & ~go, "persisted_skip"),
        (flag(F.col("is_closed") & F.col("fully_checked")) & ~go, "closed_done"),
        (spent, "empty_cache_skip"),
        (recent, "recent_skip"),
        (flag(start >= rules.now), "already_current"),
    )
    outcome = reduce(lambda c, x: c.when(*x), named[1:], F.when(*named[0])).otherwise("plan")
    judged = tokens.withColumn("outcome", outcome)
    planned, passed = F.col("outcome") == "plan", F.col("outcome") == "empty_cache_skip"
    return judged.select(
        "arrival",
        TOKEN,
        "outcome",
        F.when(planned, start).cast("long").alias("start_ts"),
        F.when(planned, F.lit(rules.now).cast("long")).alias("end_ts"),
        F.greatest(F.lit(0), F.coalesce("empty_run_streak", F.lit(0))).cast("int").alias("empty_run_streak"),
        (spare - F.when(passed, 1).otherwise(0)).cast("int").alias("skip_budget"),
    )


def cutoff_time(text: str) -> datetime:
    """The start of a UTC day given as ``2024-01-02``; of anything else the default, the first of 2023."""
    try:
        return datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        return datetime(2023, 1, 1)


def plan_stream(
    candidates: DataFrame, rules: PlanRules, cutoff: datetime, allow: DataFrame | None = None, deny: DataFrame | None = None, full: bool = False
) -> DataFrame:
    """``classify_plans`` of candidates with ``created_at`` (as text or time) in place of ``created_ts``.

    Candidates without a readable ``created_at`` or without a token are left out; those created before ``cutoff`` have the
    outcome ``pre_clob_markets``; plans of tokens that ``allow`` lacks or ``deny`` has, ``scope_skip``.

    Due candidates come token by token: tokens are trimmed, empty ones left out. ``full`` candidates come by market (they have
    a ``market_id``): tokens are taken as they are, so that one with blanks around it is no plausible token, and what was
    created before ``cutoff`` is one row for each market, its first candidate's, without a token.
    """
    text = dict(candidates.dtypes)["created_at"] == "string"
    at = plain_timestamp("created_at") if text else F.col("created_at").cast("timestamp_ntz")
    rows = candidates.withColumn("created_ts", epoch_of(at)).drop("created_at").filter("created_ts is not null")
    rows = rows.filter(F.col(TOKEN).isNotNull()) if full else rows.withColumn(TOKEN, F.trim(TOKEN)).filter(F.coalesce(F.col(TOKEN) != "", F.lit(False)))
    limit = F.lit(int((cutoff - datetime(1970, 1, 1)).total_seconds()))
    early = rows.filter(F.col("created_ts") < limit)
    planned = classify_plans(rows.filter(F.col("created_ts") >= limit), rules)
    out = F.lit(False)
    for some, name, inside in ((allow, "_allowed", False), (deny, "_denied", True)):
        if some is not None:
            planned = planned.join(some.select(TOKEN).distinct().withColumn(name, F.lit(True)), TOKEN, "left")
            out |= F.col(name).isNotNull() if inside else F.col(name).isNull()
    skipped = (F.col("outcome") == "plan") & out
    columns = ("arrival", TOKEN, "outcome", "start_ts", "end_ts", "empty_run_streak", "skip_budget")
    planned = planned.withColumns({
        "outcome": F.when(skipped, "scope_skip").otherwise(F.col("outcome")),
        "start_ts": F.when(~skipped, F.col("start_ts")),
        "end_ts": F.when(~skipped, F.col("end_ts")),
    }).select(*columns)
    none = F.lit(None).cast("long")
    if full:
        first = F.min_by(F.struct("arrival", "empty_run_streak", "skip_budget"), "arrival").alias("f")
        early = early.groupBy("market_id").agg(first).select("f.*", F.lit(None).cast("string").alias(TOKEN))
    early = early.select("arrival", TOKEN, F.lit("pre_clob_markets").alias("outcome"), none.alias("start_ts"), none.alias("end_ts"),
                         F.coalesce("empty_run_streak", F.lit(0)).cast("int").alias("empty_run_streak"), F.coalesce("skip_budget", F.lit(0)).cast("int").alias("skip_budget"))
    return planned.unionByName(early)


def plan_order(plans: DataFrame) -> DataFrame:
    """Plans, the shortest range first, over all pages."""
    return plans.filter("outcome = 'plan'").orderBy(F.col("end_ts") - F.col("start_ts"), "start_ts", TOKEN)


def plan_pages(judged: DataFrame, size: int = 2000) -> DataFrame:
    """Plans by page of the candidates' ``arrival``, on each page the shortest range first, then the first created.

    ``judged``: as from ``classify_plans``, with ``created_ts``. Every candidate takes a place on its page, plans alone come
    back, with ``page`` from 0 and ``place`` on it from 1.
    """
    on_page = Window.partitionBy("page").orderBy(F.col("end_ts") - F.col("start_ts"), "created_ts", "arrival")  # a page of rows
    plans = paged(judged, size, "arrival").filter("outcome = 'plan'")
    return plans.withColumn("place", F.row_number().over(on_page))


def window_slices(plans: DataFrame, step: int) -> DataFrame:
    """Each [start_ts, end_ts) cut into windows of at most ``step`` seconds."""
    some = plans.filter("start_ts < end_ts")
    cut = some.withColumn("window_start", F.explode(F.sequence("start_ts", F.col("end_ts") - 1, F.lit(step).cast("long"))))
    return cut.withColumn("window_end", F.least(F.col("window_start") + step, F.col("end_ts")))


def bisected_windows(windows: DataFrame, refused: Callable[[DataFrame], DataFrame], least: int) -> DataFrame:
    """Windows cut in halves where they are refused as too long, down to ``least`` seconds.

    ``refused`` asks for windows and gives them back with a boolean column ``refused``. A refused window that is longer than
    ``least`` is asked for again as its two halves, [s, s + (e - s) // 2) and the rest; a shorter one stays refused, and is
    then an error. Each round asks for the halves of the last one's refusals alone. Windows that don't end after their start
    are left out. Returns the windows that were asked for last, with ``refused``; by start they are in the order, left halves
    first, in which one would ask for them one by one.
    """
    start, end = F.col("window_start"), F.col("window_end")
    done: list[DataFrame] = []
    frontier = windows.filter(end > start)
    while True:
        asked = kept(refused(frontier).withColumn("refused", F.coalesce("refused", F.lit(False))))
        again = F.col("refused") & (end - start > least)
        done.append(asked.filter(~again))
        split = asked.filter(again)
        if split.isEmpty():
            return reduce(DataFrame.unionByName, done)
        middle = start + F.floor((end - start) / 2).cast("long")
        halves = F.array(F.struct(start.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), end.alias("b")))
        cut = split.drop("refused").withColumn("_half", F.explode(halves))
        frontier = cut.withColumns({"window_start": F.col("_half.a"), "window_end": F.col("_half.b")}).drop("_half").filter(end > start)


def bisected_plans(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """Plans with ``n_windows`` that were asked for after all, and ``failed``: whether one of them stayed refused."""
    of = asked.groupBy(TOKEN).agg(F.count("*").alias("n_windows"), F.bool_or("refused").alias("failed"))
    joined = plans.join(of, TOKEN, "left")
    return joined.withColumns({"n_windows": F.coalesce("n_windows", F.lit(0).cast("long")), "failed": F.coalesce("failed", F.lit(False))})


@dataclass(frozen=True)
class RetryRules:
    """Seconds until the next check: after a run with rows, after a transient error, and after empty runs, from ``base``
    on doubled each time up to ``most`` (0: no limit)."""

    routine: int = 6 * 3600
    error: int = 30 * 60
    base: int = 24 * 3600
    most: int = 168 * 3600


def state_transitions(results: DataFrame, plans: DataFrame, rules: RetryRules) -> DataFrame:
    """Each plan's state after its windows, without a pass over them one by one.

    ``results``: token, ``window_start``, ``window_end``, ``status`` (``ok``, ``error`` for a transient one, ``permanent``),
    ``rows``, ``last_ts``, ``message``. ``plans``: token, ``start_ts``, ``end_ts``, ``is_closed``, ``empty_run_streak``.

    A permanent error ends the run: its windows after it don't count, the cursor is the plan's end, and ``skip_reason`` is
    its message. After transient errors the cursor is the last time seen before the first of them; if no window at all had
    rows, the end of what was seen before it; else it stays as it was (null). Without errors it is the last time seen, or
    without rows the plan's end. A closed token whose run had no error is fully checked and has no next check.
    """
    order = Window.partitionBy(TOKEN).orderBy("window_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("status") == "permanent").cast("int")).over(before), F.lit(0))
    broken = F.max((F.col("status") != "ok").cast("int")).over(order)
    marked = results.withColumns({"_ended": ended, "_broken": broken}).filter("_ended = 0")
    fine, first = F.col("status") == "ok", F.col("_broken") == 0
    some = fine & (F.col("rows") > 0)
    runs = marked.groupBy(TOKEN).agg(
        F.max(F.when(some & first, F.col("last_ts"))).alias("seen_first"),
        F.max(F.when(some, F.col("last_ts"))).alias("seen"),
        F.max(F.when(fine & first, F.col("window_end"))).alias("reached"),
        F.coalesce(F.sum(F.when(fine, F.col("rows"))), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("windows"),
        F.bool_or(F.col("status") == "error").alias("failed"),
        F.bool_or(F.col("status") == "permanent").alias("permanent"),
        F.max(F.when(F.col("status") == "permanent", F.col("message"))).alias("message"),
    )
    joined = plans.join(runs, TOKEN, "left").withColumns({
        "rows": F.coalesce("rows", F.lit(0).cast("long")),
        "windows": F.coalesce("windows", F.lit(0).cast("long")),
        "permanent": F.coalesce("permanent", F.lit(False)),
    }).withColumn("failed", F.coalesce("failed", F.lit(False)) & ~F.col("permanent"))
    failed, permanent, empty = F.col("failed"), F.col("permanent"), F.col("rows") == 0
    start, end = F.col("start_ts"), F.col("end_ts")
    cursor = (
        F.when(permanent, end)
        .when(failed, F.when(F.col("seen_first") > start, F.col("seen_first")).when(empty & (F.col("reached") > start), F.col("reached")))
        .when(empty, end)
        .otherwise(F.greatest("seen", start))
    )
    checked = F.coalesce("is_closed", F.lit(False)) & ~failed & ~permanent
    streak = F.when(empty & ~failed & ~permanent, F.coalesce("empty_run_streak", F.lit(0)) + 1).otherwise(0)
    made = joined.withColumns({"streak": streak.cast("int"), "fully_checked": checked})
    wait = F.when(failed, F.lit(max(0, rules.error))).when(empty, backoff("streak", rules.base, rules.most)).otherwise(F.lit(max(0, rules.routine)))
    return made.select(
        TOKEN,
        cursor.cast("long").alias("cursor"),
        end.cast("long").alias("checked_ts"),
        F.when(~permanent & ~checked, end + wait).cast("long").alias("next_check_ts"),
        F.col("streak").alias("empty_run_streak"),
        "fully_checked",
        "rows",
        "windows",
        (failed | permanent).alias("error"),
        F.col("permanent").alias("permanent_error"),
        F.when(permanent, F.col("message")).alias("skip_reason"),
    )


def run_totals(states: DataFrame, plans: DataFrame, seconds: float) -> DataFrame:
    """One row: what the runs of ``state_transitions`` add up to, and tokens and rows a second. ``plans`` names markets."""
    n = lambda c: F.count_if(c)
    run = max(0.001, seconds)
    return states.join(plans.select(TOKEN, "market_id"), TOKEN).agg(
        F.count("*").alias("processed_tokens"),
        F.countDistinct("market_id").alias("distinct_markets"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"),
        n(F.col("rows") == 0).alias("empty"),
        n("error").alias("error"),
        n("permanent_error").alias("permanent_error"),
        n("fully_checked").alias("fully_checked"),
        F.round(F.count("*") / run, 4).alias("token_rate"),
        F.round(F.coalesce(F.sum("rows"), F.lit(0)) / run, 4).alias("row_rate"),
    )


def merge_buffers(states: DataFrame) -> DataFrame:
    """One state for each token of buffered ones: the largest cursor, the last known checks, the last streak by
    ``arrival``, and the flag if any has it."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))
    return states.groupBy(TOKEN).agg(
        F.max("cursor").alias("cursor"),
        last("checked_at").alias("checked_at"),
        last("next_check_at").alias("next_check_at"),
        last("streak").alias("streak"),
        F.coalesce(F.bool_or("fully_checked"), F.lit(False)).alias("fully_checked"),
    )


def history_cursors(history: DataFrame) -> DataFrame:
    """The last observation of each token."""
    return history.groupBy(TOKEN).agg(F.max(EPOCH).alias("history_max"))


def cursor_snapshot(tokens: DataFrame, ledger: DataFrame, skips: DataFrame, history: DataFrame, reconcile: bool = False) -> DataFrame:
    """Cursor and state of some tokens. The ledger's cursor, if null (or, to reconcile, if smaller) the history's."""
    wanted = tokens.select(TOKEN).distinct()
    last = history_cursors(history.join(wanted, TOKEN, "left_semi"))
    joined = wanted.join(ledger, TOKEN, "left").join(skips.select(TOKEN, "reason"), TOKEN, "left").join(last, TOKEN, "left")
    both = F.greatest if reconcile else F.coalesce
    return joined.select(
        TOKEN,
        both("last_sync_timestamp", "history_max").alias("cursor"),
        F.coalesce("fully_checked", F.lit(False)).alias("fully_checked"),
        "next_check_at",
        F.coalesce("empty_run_streak", F.lit(0)).alias("empty_run_streak"),
        F.col("reason").isNotNull().alias("is_skipped"),
    )


def latest_cursors(ledger: DataFrame, history: DataFrame) -> DataFrame:
    """The later of each token's ledger cursor and last observation."""
    joined = ledger.select(TOKEN, "last_sync_timestamp").join(history_cursors(history), TOKEN, "full_outer")
    return joined.select(TOKEN, F.greatest("last_sync_timestamp", "history_max").alias("cursor"))


def reconcile_ledger(ledger: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with cursors no earlier than the history's, and counts ``scanned`` and ``repaired``."""
    last = history_cursors(history)
    behind = last.join(ledger.select(TOKEN, "last_sync_timestamp"), TOKEN, "left")
    stale = F.col("last_sync_timestamp").isNull() | (F.col("last_sync_timestamp") < F.col("history_max"))
    counts = behind.agg(F.count("*").alias("scanned"), F.count_if(stale).alias("repaired"))
    new = behind.filter(stale).select(TOKEN, F.col("history_max").alias("last_sync_timestamp"))
    new = new.select(TOKEN, *(F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in ledger.dtypes if c != TOKEN))
    return merge_monotonic(ledger, new, TOKEN, "last_sync_timestamp"), counts


def best_registry_rows(rows: DataFrame, priority: Sequence[str]) -> DataFrame:
    """One row for each market: of the source latest in ``priority``, of equals the first by ``row_order``."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    order = F.struct(rank.alias("r"), (-F.col("row_order")).alias("o"))
    rest = [c for c in rows.columns if c != "market_id"]
    best = rows.groupBy("market_id").agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select("market_id", "b.*").select(*rows.columns)


def event_markets(events: DataFrame) -> DataFrame:
    """The markets of event payloads, with their event's id and slug; of a market's payloads the first by ``row_order``."""
    rows = events.select("row_order", F.col("id").alias("event_id"), F.col("slug").alias("event_slug"), F.posexplode("markets").alias("place", "market"))
    rows = rows.filter(F.coalesce(F.trim("market.id") != "", F.lit(False)))
    first = rows.groupBy(F.col("market.id").alias("market_id")).agg(
        F.min_by(F.struct("event_id", "event_slug", "market"), F.struct("row_order", "place")).alias("f")
    )
    return first.select("market_id", "f.event_id", "f.event_slug", "f.market")


def tag_closure(edges: DataFrame, seeds: Sequence[str], rounds: int, most: int) -> DataFrame:
    """Tags reached from the seeds over (tag, other) pairs in at most so many rounds, ``most`` tags at most, with the
    round in which each was first reached. A tag vocabulary is small: the frontier, not the pairs, meets the driver."""
    spark = edges.sparkSession
    reached = dict.fromkeys(seeds, 0)
    frontier = list(reached)
    for n in range(1, rounds + 1):
        if not frontier or len(reached) >= most:
            break
        at = F.broadcast(spark.createDataFrame([(t,) for t in frontier], "tag string"))
        found = edges.join(at, "tag", "left_semi").select("other").filter("other is not null").distinct().orderBy("other").limit(most + len(reached))
        frontier = [r["other"] for r in found.collect() if r["other"] not in reached][: most - len(reached)]
        reached |= dict.fromkeys(frontier, n)
    return spark.createDataFrame(list(reached.items()), "tag string, round int")


def tag_crawl(pages: DataFrame, seeds: Sequence[str], rounds: int, most_tags: int, most_pages: int | None = None) -> tuple[DataFrame, bool]:
    """The tags of a search that follows what it finds, with their ``round``, ``place`` in the search and ``pages`` read, and
    whether it was cut short.

    ``pages``: ``tag``, ``page`` from 0, and ``found``, an array of the tags on it. A round reads the tags of its queue in
    order, all pages of each, and queues for the next round, in the order in which they were found, tags that weren't read.
    The search is cut where a tag beyond ``most_tags`` or a page beyond ``most_pages`` would be next; of the tag at the cut
    the first pages are still read. A vocabulary of tags is small: queue and costs, at most ``most_tags`` rows, meet the
    driver; pages never do.
    """
    spark, seen, queue, spent, cut = pages.sparkSession, {}, list(dict.fromkeys(seeds)), 0, False
    for n in range(rounds + 1):
        wanted = [t for t in queue if t not in seen]
        if not wanted:
            break
        cut = len(seen) + len(wanted) > most_tags
        wanted = wanted[: most_tags - len(seen)]
        asked = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "place int, tag string"))
        costs = {r["tag"]: r["n"] for r in pages.join(asked, "tag").groupBy("tag").agg(F.countDistinct("page").alias("n")).collect()}
        read = {}
        for tag in wanted:
            left = None if most_pages is None else most_pages - spent
            if left is not None and left <= 0:
                cut = True
                break
            read[tag] = costs.get(tag, 0) if left is None else min(costs.get(tag, 0), left)
            seen[tag] = (tag, n, len(seen), read[tag])
            spent += read[tag]
            if read[tag] < costs.get(tag, 0):
                cut = True
                break
        if cut or not read:
            break
        # Of each new tag where it was first found: at most as many rows as could still be read.
        got = pages.join(asked, "tag").select("place", "page", F.posexplode("found").alias("at", "other")).filter("other is not null")
        known = F.broadcast(spark.createDataFrame([(t,) for t in seen], "other string"))
        first = got.join(known, "other", "left_anti").groupBy("other").agg(F.min(F.struct("place", "page", "at")).alias("first"))
        queue = [r["other"] for r in first.orderBy("first").limit(most_tags - len(seen) + 1).collect()]
    return spark.createDataFrame(list(seen.values()), "tag string, round int, place int, pages long"), cut


def tag_sources(lists: dict[str, DataFrame], keywords: Sequence[str], trusted: Sequence[str] = ("seed",)) -> DataFrame:
    """Tags of several lists with the names of those they come from; only trusted lists may lack a keyword."""
    has = reduce(lambda a, b: a | b, (F.lower("tag").contains(k.lower()) for k in keywords), F.lit(False))
    parts = [
        (df.select("tag") if name in trusted else df.select("tag").filter(has)).withColumn("source", F.lit(name))
        for name, df in lists.items()
    ]
    both = reduce(DataFrame.unionByName, parts).filter("tag is not null")
    return both.groupBy("tag").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def missing_metadata(markets: DataFrame, unresolved: DataFrame, now: datetime) -> DataFrame:
    """Markets that lack tokens, a slug, an event slug or an end date, by field; fields that wait for a retry are out."""
    lacks = F.array(
        F.when(~json_list_guard("clob_token_ids"), "tokens"),
        F.when(F.coalesce(F.trim("slug"), F.lit("")) == "", "slug"),
        F.when(F.coalesce(F.trim("event_slug"), F.lit("")) == "", "event_slug"),
        F.when(F.col("end_date").isNull(), "end_date"),
    )
    wanted = markets.select("market_id", F.explode(F.array_compact(lacks)).alias("field_name"))
    waiting = unresolved.filter(F.col("next_retry_at") > F.lit(now).cast("timestamp_ntz")).select("market_id", "field_name")
    return wanted.join(waiting, ["market_id", "field_name"], "left_anti")


def volume_tiers(markets: DataFrame, edge: float) -> DataFrame:
    """Markets with their tier: ``hot`` from the edge on, ``cold`` below."""
    return markets.withColumn("tier", F.when(volume_band("volume", least=edge), "hot").otherwise("cold"))


def tuned_rate(
    rate: Column, requests: Column, throttled: Column, errors: Column, least: float, most: float,
    window: int = 200, throttled_above: float = 0.03, errors_above: float = 0.01,
) -> Column:
    """The next request rate from the requests since the last change: lower if a share above a threshold was throttled or
    failed, higher if none was throttled, within limits. It stays with fewer requests than ``window`` and if it would
    change by less than a half."""
    share = lambda x: x / F.greatest(requests, F.lit(1))
    target = (
        F.when(share(throttled) > max(0.0, throttled_above), F.greatest(F.lit(float(least)), rate * 0.8))
        .when(share(errors) > max(0.0, errors_above), F.greatest(F.lit(float(least)), rate * 0.9))
        .when(throttled == 0, F.least(F.lit(float(most)), rate * 1.1))
        .otherwise(rate)
    )
    moves = (requests >= max(1, window)) & (rate > 0) & (F.abs(target - rate) >= 0.5)
    return F.when(moves, target).otherwise(rate)


def created_epoch(created: Column | str) -> Column:
    """Epoch seconds of a time written as ``2024-01-02 03:04:05`` or with a ``T``; null for other text."""
    return epoch_of(plain_timestamp(created))
