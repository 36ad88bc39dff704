"""Exact-value cases of the operators, edge cases included."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import ohlc, planning, profile, quality, scope, upsert

OBS = "clob_token_id string, odds_timestamp_epoch bigint, price double"
LEDGER = "clob_token_id string, last_sync_timestamp bigint, fully_checked boolean, last_checked_at timestamp_ntz, next_check_at timestamp_ntz, empty_run_streak int"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_daily_ohlc(spark):
    seen = spark.createDataFrame([("tok", 1710000000, 0.4), ("tok", 1710000300, 0.6), ("tok", 1710086400, 0.2), ("tok", None, 0.1), ("tok", 1710086400, None)], OBS)
    got = rows(ohlc.daily_ohlc(seen).select("open_price", "high_price", "low_price", "close_price", "avg_price", "observed_points"), "first_timestamp")
    assert got == [(0.4, 0.6, 0.4, 0.6, 0.5, 2), (0.2, 0.2, 0.2, 0.2, 0.2, 1)]


def test_daily_average_stays_within_bounds(spark):
    seen = spark.createDataFrame([("t", 1710000000 + i, 0.9995) for i in range(3)], OBS)
    (low, mean, high), = rows(ohlc.daily_ohlc(seen).select("low_price", "avg_price", "high_price"))
    assert low <= mean <= high


def test_days_split_in_utc_in_any_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(ohlc.daily_ohlc(spark.createDataFrame([("t", 1710115199, 0.2), ("t", 1710115200, 0.8)], OBS)).select("odds_date_utc", "observed_points"), "odds_date_utc")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(date(2024, 3, 10), 1), (date(2024, 3, 11), 1)]


def test_equal_seconds_take_the_smaller_price_first(spark):
    seen = spark.createDataFrame([("t", 5, 0.3), ("t", 5, 0.1)], OBS)
    assert rows(ohlc.daily_ohlc(seen).select("open_price", "close_price")) == [(0.1, 0.3)]


def test_refresh_replaces_stale_days_only(spark):
    history = spark.createDataFrame([("bf", 1710000000, 0.1), ("bf", 1710000600, 0.9)], OBS)
    other = ohlc.daily_ohlc(spark.createDataFrame([("x", 1710000000, 0.5)], OBS))
    stale = ohlc.daily_ohlc(history).withColumn("observed_points", F.lit(99).cast("long")).unionByName(other)
    got = ohlc.refresh_days(stale, history, ohlc.dirty_days(history))
    assert rows(got.select("clob_token_id", "open_price", "high_price", "observed_points"), "clob_token_id") == [("bf", 0.1, 0.9, 2), ("x", 0.5, 0.5, 1)]


def test_gaps_count_the_first_day_as_zero_for_the_longest_only(spark):
    daily = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 2)), ("a", date(2024, 1, 5)), ("b", date(2024, 1, 1))], "clob_token_id string, odds_date_utc date")
    assert rows(ohlc.gap_diagnostics(daily), "clob_token_id") == [("a", 3, 2.0), ("b", 0, 0.0)]


def test_last_write_wins(spark):
    got = upsert.last_write_wins(spark.createDataFrame([("z", 1, 0.1, 0), ("z", 1, 0.2, 1), ("z", 2, 0.3, 2)], "k string, t int, p double, n int"), ["k", "t"], ["n"])
    assert rows(got, "t") == [("z", 1, 0.2, 1), ("z", 2, 0.3, 2)]


def _ledger(spark, *values):
    return spark.createDataFrame(list(values), LEDGER)


def test_monotonic_cursor(spark):
    old, new = (spark.createDataFrame([("t", n, "x")], "k string, c int, other string") for n in (100, 50))
    assert rows(upsert.merge_monotonic(old, new, "k", "c")) == [("t", 100, "x")]


def test_state_merge(spark):
    at = datetime(2024, 1, 1)
    old = _ledger(spark, ("t", 50, False, at, at, 2), ("n", None, False, None, None, None))
    new = _ledger(spark, ("t", 75, True, None, None, 0), ("n", None, False, None, None, None))
    assert rows(upsert.merge_state(old, new), "clob_token_id") == [("n", None, False, None, None, 0), ("t", 75, True, at, None, 0)]


def test_skip_keeps_its_creation_time(spark):
    schema = "k string, reason string, created_at timestamp_ntz"
    old, new = (spark.createDataFrame([("t", r, datetime(2024, 1, d))], schema) for r, d in (("first", 1), ("second", 2)))
    assert rows(upsert.merge_keep_created(old, new, "k")) == [("t", "second", datetime(2024, 1, 1))]


def test_registry_merge(spark):
    schema = "market_id string, event_slug string, event_id string, source string"
    old = spark.createDataFrame([("m1", "slug", "e1", "events_api")], schema)
    new = spark.createDataFrame([("m1", None, None, "seed")], schema)
    assert rows(upsert.merge_coalesce(old, new, ["market_id"], ["event_slug", "event_id"], ["source"])) == [("m1", "slug", "e1", "seed")]


def test_counter_and_history(spark):
    schema = "k string, reason string, attempts int, last_checked_at timestamp_ntz, next_retry_at timestamp_ntz"
    old = spark.createDataFrame([("a", "x", 2, None, None)], schema)
    got = upsert.merge_counter(old, spark.createDataFrame([("a", "y", None, None, None), ("b", "y", None, None, None)], schema), ["k"], datetime(2024, 1, 1), 0)
    assert rows(got.select("k", "reason", "attempts", "next_retry_at"), "k") == [("a", "y", 3, datetime(2024, 1, 1, 1)), ("b", "y", 1, datetime(2024, 1, 1, 1))]
    a, b = (spark.createDataFrame([("k", h)], "k string, h array<int>") for h in ([1, 2], [3, 4]))
    assert rows(upsert.append_history(a, b, "k", "h", 3)) == [("k", [2, 3, 4])]
    assert rows(upsert.append_history(a, b, "k", "h", 0)) == [("k", [1, 2, 3, 4])]


def test_symmetric_difference_counts_repeats(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [1, 3]))
    assert sorted(rows(upsert.symmetric_difference(a, b))) == [(1,), (2,), (3,)]


def _plan(spark, rules, *tokens):
    schema = "arrival long, clob_token_id string, created_ts long, cursor long, reason string, is_closed boolean, fully_checked boolean, empty_run_streak int, skip_budget int"
    got = planning.classify_plans(spark.createDataFrame(list(tokens), schema), rules)
    return rows(got.select("outcome", "start_ts"), "arrival")


OPEN = (None, False, False, 0, None)
DONE = ("why", True, True, 3, 2)


@pytest.mark.parametrize(
    ("rules", "token", "expected"),
    [
        (planning.PlanRules(200, overlap=20, recent=10), ("tok_1", 100, 150, *OPEN), ("plan", 130)),
        (planning.PlanRules(200, overlap=20, recent=10, force=True), ("tok_1", 100, 195, *DONE), ("plan", 175)),
        (planning.PlanRules(200, recent=10), ("tok_1", 100, 195, *OPEN), ("recent_skip", None)),
        (planning.PlanRules(200, recent=5), ("tok_1", 100, 195, *OPEN), ("plan", 100)),
        (planning.PlanRules(200, force=True), ("tok_1", 250, None, *OPEN), ("already_current", None)),
        (planning.PlanRules(200), ("tok_1", 100, None, None, False, False, 2, 2), ("empty_cache_skip", None)),
        (planning.PlanRules(200, skip_runs=0), ("tok_1", 100, None, None, False, False, 2, 2), ("plan", 100)),
        (planning.PlanRules(200), ("tok_1", 100, None, None, False, False, 9, 0), ("plan", 100)),
        (planning.PlanRules(200), ("tok_1", 100, None, "why", False, False, 0, None), ("persisted_skip", None)),
        (planning.PlanRules(200), ("tok_1", 100, None, None, True, True, 0, None), ("closed_done", None)),
        (planning.PlanRules(200), ("tok_1", 100, None, None, None, True, 0, None), ("plan", 100)),
        (planning.PlanRules(200, rebuild=True), ("tok_1", 100, 150, *DONE), ("plan", 100)),
        (planning.PlanRules(200, floor=160), ("tok_1", 100, 199, *DONE), ("plan", 160)),
        (planning.PlanRules(200, floor=60), ("tok_1", 100, None, *DONE), ("plan", 100)),
        (planning.PlanRules(200), ("bad token", 100, None, *OPEN), ("invalid_token", None)),
        (planning.PlanRules(200), ("123", 100, None, *OPEN), ("invalid_token", None)),
        (planning.PlanRules(200), (None,) * 8, ("invalid_token", None)),
    ],
)
def test_plan_rules(spark, rules, token, expected):
    assert _plan(spark, rules, (1, *token)) == [expected]


def test_later_arrivals_of_a_token_are_duplicates(spark):
    t = ("tok_1", 100, None, *OPEN)
    assert [o for o, _ in _plan(spark, planning.PlanRules(200), (1, *t), (2, *t))] == ["plan", "dup_token"]


def test_budgets_are_spent_one_by_one(spark):
    schema = "arrival long, clob_token_id string, created_ts long, cursor long, reason string, is_closed boolean, fully_checked boolean, empty_run_streak int, skip_budget int"
    budget, outcomes = 2, []
    for _ in range(3):
        df = spark.createDataFrame([(1, "tok_1", 100, None, None, False, False, 4, budget)], schema)
        (outcome, streak, budget), = rows(planning.classify_plans(df, planning.PlanRules(200)).select("outcome", "empty_run_streak", "skip_budget"))
        outcomes.append((outcome, streak, budget))
    assert outcomes == [("empty_cache_skip", 4, 1), ("empty_cache_skip", 4, 0), ("plan", 4, 0)]


def test_plan_stream(spark):
    schema = "arrival long, clob_token_id string, created_at string, cursor long, reason string, is_closed boolean, fully_checked boolean, empty_run_streak int, skip_budget int"
    made = [("tok_1", "2024-01-02T00:00:00.123456"), ("tok_2", "2024-01-02 00:00:00"), (" tok_3 ", "2023-12-31 23:59:59"), ("tok_4", None), ("tok_5", "soon"), ("  ", "2024-01-02 00:00:00"), ("tok_6", "2024-01-03 00:00:00"), ("bad!", "2024-01-03 00:00:00")]
    df = spark.createDataFrame([(i, t, c, None, *OPEN) for i, (t, c) in enumerate(made)], schema)
    allow, deny = (spark.createDataFrame([(t,) for t in x], "clob_token_id string") for x in (["tok_1", "tok_2"], ["tok_2"]))
    now = 1704153600 + 10 * 86400
    got = planning.plan_stream(df, planning.PlanRules(now), planning.cutoff_time("2024-01-01"), allow, deny)
    assert rows(got.select("clob_token_id", "outcome", "start_ts"), "arrival") == [
        ("tok_1", "plan", 1704153600), ("tok_2", "scope_skip", None), ("tok_3", "pre_clob_markets", None), ("tok_6", "scope_skip", None), ("bad!", "invalid_token", None),
    ]
    assert planning.plan_stream(df, planning.PlanRules(now), planning.cutoff_time("2024-01-01")).filter("outcome = 'plan'").count() == 3
    assert planning.cutoff_time("January") == datetime(2023, 1, 1)


def test_shortest_plans_come_first(spark):
    df = spark.createDataFrame([("a", "plan", 0, 9), ("b", "plan", 5, 9), ("c", "dup_token", None, None), ("d", "plan", 4, 8)], "clob_token_id string, outcome string, start_ts long, end_ts long")
    assert [r[0] for r in rows(planning.plan_order(df))] == ["d", "b", "a"]


def _transition(spark, results, closed=False, streak=1, start=10, end=200):
    r = spark.createDataFrame([("t", *x, "why") for x in results], "clob_token_id string, window_start long, window_end long, status string, rows long, last_ts long, message string")
    p = spark.createDataFrame([("t", start, end, closed, streak)], "clob_token_id string, start_ts long, end_ts long, is_closed boolean, empty_run_streak int")
    rules = planning.RetryRules(routine=600, error=30, base=60, most=3600)
    (got,) = planning.state_transitions(r, p, rules).collect()
    return got["cursor"], got["next_check_ts"], got["empty_run_streak"], got["fully_checked"], int(got["error"]), got["rows"]


@pytest.mark.parametrize(
    ("windows", "closed", "expected"),
    [
        ([(10, 21, "ok", 0, None), (21, 32, "error", 0, None)], False, (21, 230, 0, False, 1, 0)),  # empty, then an error
        ([(10, 21, "ok", 3, 20), (21, 32, "error", 0, None)], True, (20, 230, 0, False, 1, 3)),  # rows, then an error
        ([(10, 21, "error", 0, None), (21, 32, "ok", 5, 31)], False, (None, 230, 0, False, 1, 5)),  # rows after it don't move it
        ([(10, 21, "ok", 0, None), (21, 32, "error", 0, None), (32, 43, "ok", 5, 40)], False, (None, 230, 0, False, 1, 5)),
        ([(10, 21, "ok", 0, None)], False, (200, 200 + 120, 2, False, 0, 0)),  # nothing: the wait doubles
        ([(10, 21, "ok", 0, None)], True, (200, None, 2, True, 0, 0)),
        ([(10, 21, "ok", 2, 20)], False, (20, 200 + 600, 0, False, 0, 2)),  # rows: the routine wait
        ([(10, 21, "ok", 2, 20)], True, (20, None, 0, True, 0, 2)),
        ([(10, 21, "ok", 2, 5)], False, (10, 200 + 600, 0, False, 0, 2)),  # no earlier than the plan's start
        ([(10, 21, "ok", 2, 20), (21, 32, "permanent", 0, None), (32, 43, "ok", 9, 42)], True, (200, None, 0, False, 1, 2)),
        ([], False, (200, 320, 2, False, 0, 0)),
    ],
)
def test_state_transitions(spark, windows, closed, expected):
    assert _transition(spark, windows, closed) == expected


def test_permanent_errors_end_a_run_with_a_reason(spark):
    r = spark.createDataFrame([("t", 0, 5, "error", 0, None, "x"), ("t", 5, 9, "permanent", 0, None, "bad request"), ("t", 9, 12, "ok", 1, 10, None)],
                              "clob_token_id string, window_start long, window_end long, status string, rows long, last_ts long, message string")
    p = spark.createDataFrame([("t", "m", 0, 12, False, 0), ("u", "m", 3, 3, False, 0)], "clob_token_id string, market_id string, start_ts long, end_ts long, is_closed boolean, empty_run_streak int")
    states = planning.state_transitions(r, p, planning.RetryRules(most=0))
    assert rows(states.select("cursor", "windows", "permanent_error", "skip_reason", "rows"), "clob_token_id") == [(12, 2, True, "bad request", 0), (3, 0, False, None, 0)]
    assert rows(planning.run_totals(states, p, 0.0).select("processed_tokens", "distinct_markets", "windows", "empty", "error", "token_rate")) == [(2, 1, 2, 2, 1, 2000.0)]


@pytest.mark.parametrize(
    ("rate", "requests", "throttled", "errors", "expected"),
    [
        (10.0, 200, 10, 0, 8.0), (10.0, 200, 0, 10, 9.0), (10.0, 200, 0, 1, 11.0), (10.0, 200, 1, 1, 10.0), (10.0, 199, 50, 0, 10.0),
        (4.0, 200, 0, 0, 4.0), (19.8, 200, 0, 0, 19.8), (2.2, 200, 100, 0, 2.2), (10.0, 0, 0, 0, 10.0), (30.0, 300, 0, 0, 20.0),
    ],
)
def test_tuned_rate(spark, rate, requests, throttled, errors, expected):
    df = spark.createDataFrame([(rate, requests, throttled, errors)], "r double, n long, t long, e long")
    assert rows(df.select(planning.tuned_rate(F.col("r"), F.col("n"), F.col("t"), F.col("e"), 2, 20))) == [(pytest.approx(expected),)]


def test_markets_of_events(spark):
    events = spark.createDataFrame([(1, "e1", "s1", [("m1", "a"), (" ", "b")]), (2, "e2", "s2", [("m1", "c"), ("m2", "d"), (None, "e")]), (3, "e3", "s3", None)],
                                   "row_order long, id string, slug string, markets array<struct<id: string, question: string>>")
    assert rows(planning.event_markets(events).select("market_id", "event_id", "event_slug", "market.question"), "market_id") == [("m1", "e1", "s1", "a"), ("m2", "e2", "s2", "d")]


@pytest.mark.parametrize(
    ("token", "expected"),
    [("", False), (None, False), ("open_token_x", False), ("open_token_1", False), ("closed_no_data_7", False), ("bad!", False), ("a" * 64, True), ("f" * 32, True), ("f" * 29, False),
     ("t1", True), ("a-1", False), ("abc123", False), ("token", False), ("to_ken", True), ("0xdead", True), ("t1\n", False)],
)
def test_plausible_tokens(spark, token, expected):
    df = spark.createDataFrame([(token,)], "t string")
    assert rows(df.select(scalar.plausible_token("t"))) == [(expected,)]


def test_crawl_gate(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" World-Cup ",), ("denied-cup",), ("cup-final",), ("tennis",)], "t string")
    gate = lambda **k: [r[0] for r in df.select(scope.crawl_allowed("t", [" WORLD-cup"], ["Denied-Cup"], ["cup"], **k)).collect()]
    assert gate() == [True, False, True, False, True, False]
    assert gate(gate=False) == [True, False, True, False, True, True]


def test_discovery_ledger():
    a, b = scope.Scope(slugs=("a",)), scope.Scope(slugs=("b",))
    seen = scope.Discovery().after(a, whole=True, truncated=False)
    assert seen == scope.Discovery(True, scope.scope_hash(a))
    assert seen.after(a, whole=False, truncated=False) == seen
    assert seen.after(a, whole=True, truncated=True) == scope.Discovery(False, scope.scope_hash(a))
    assert seen.after(b, whole=False, truncated=False) == scope.Discovery(False, scope.scope_hash(b))
    assert seen.after(b, whole=True, truncated=False) == scope.Discovery(True, scope.scope_hash(b))
    assert scope.Discovery().after(a, whole=False, truncated=True) == scope.Discovery()


def test_due_tokens(spark):
    at, later = datetime(2024, 1, 1), datetime(2025, 1, 1)
    markets = spark.createDataFrame([("m", '["tok_due","tok_wait","tok_done","tok_skip"]', True, at), ("n", "not json", False, at), ("o", None, None, None)],
                                    "market_id string, clob_token_ids string, is_closed boolean, created_at timestamp_ntz")
    ledger = _ledger(spark, ("tok_wait", 1, False, at, later, 0), ("tok_done", 1, True, at, None, 0))
    skips = spark.createDataFrame([("tok_skip", "why")], "clob_token_id string, reason string")
    assert rows(planning.due_tokens(markets, ledger, skips, datetime(2024, 6, 1)).select("clob_token_id")) == [("tok_due",)]


def test_window_slices(spark):
    plans = spark.createDataFrame([(0, 25), (5, 5)], "start_ts long, end_ts long")
    assert rows(planning.window_slices(plans, 10).select("window_start", "window_end")) == [(0, 10), (10, 20), (20, 25)]


def test_scope_is_never_null(spark):
    markets = spark.createDataFrame([("a", "Brand-X"), ("b", None), ("c", "other-1"), ("d", "no")], "market_id string, event_slug string")
    registry = spark.createDataFrame([("b",), ("b",)], "market_id string")
    found = scope.with_scope(markets, registry, scope.Scope(slugs=["brand-x"], prefixes=["other-"]))
    assert rows(found.select("market_id", "in_scope"), "market_id") == [("a", True), ("b", True), ("c", True), ("d", False)]


def test_scope_settings_and_their_hash():
    got = scope.resolve_scope({}, {"slugs": "a-b, c"}, {"slugs": ["x"], "tags": ["t"]})
    assert (got.slugs, got.tags) == (("a-b", "c"), ("t",))
    assert scope.scope_hash(got) == scope.scope_hash(scope.Scope(slugs=("c", "a-b"), tags=("t",))) != scope.scope_hash(scope.Scope())
    assert len(scope.scope_hash(got)) == 16
    with pytest.raises(ValueError, match="slugs"):
        scope.resolve_scope({"slugs": ["Not A Slug"]})


def test_observations_must_be_probabilities(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 1.5), (1, float("nan")), (None, 0.5), (1, None)], "odds_timestamp_epoch long, price double")
    assert df.filter(scope.valid_observation()).count() == 1


def test_negative_volumes_are_refused():
    with pytest.raises(ValueError, match="negative"):
        scope.volume_band("volume", least=-1)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(scalar.backoff(F.lit(3), 60, 3600)) == 240
    assert get(scalar.backoff(F.lit(40), 60, 3600)) == 3600
    assert get(scalar.guarded_ratio(F.lit(1), F.lit(0))) is None
    assert get(scalar.guarded_ratio(F.lit(1), F.lit(3), 4)) == 0.3333
    assert get(scalar.json_field(F.lit('{"a": null}'), "$.a", "bigint")) is None
    assert get(scalar.json_field(F.lit("{broken"), "$.a", "bigint")) is None
    assert get(scalar.iso_timestamp(F.lit("2025-01-01T00:00:00.5Z"))) == datetime(2025, 1, 1)
    assert get(scalar.iso_timestamp(F.lit("never"))) is None
    assert get(scalar.json_text_list(F.array(F.lit("Yes"), F.lit("No \u00e9"), F.lit(None).cast("string"), F.lit('a"\\\n\x7f\U0001f642')))) == json.dumps(["Yes", "No \u00e9", None, 'a"\\\n\x7f\U0001f642'])
    assert get(scalar.json_text_list(F.array().cast("array<string>"))) == "[]"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for text, hour in (("2024-01-01T12:00:00Z", 12), ("2024-01-01T12:00:00", 12), ("2024-01-01 12:00:00+02:00", 10), ("2024-01-01", 0), ("2024-07-01T12:00:00.9", 12)):
            assert get(scalar.iso_timestamp(F.lit(text))).hour == hour, text
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert get(scalar.epoch_day(F.lit(-1))) == date(1969, 12, 31)


def test_profile_in_one_pass(spark):
    df = spark.createDataFrame([("x", 1.5, True), (None, None, None)], "id string, price double, active boolean")
    got = {r["column_name"]: r for r in profile.profile_table(df, "full").collect()}
    assert (got["price"]["n_nulls"], got["price"]["null_percent"], got["price"]["mean"]) == (1, 50.0, 1.5)
    assert (got["active"]["n_true"], got["active"]["n_false"]) == (1, 0)
    assert got["id"]["sample"] == "x"
    with pytest.raises(ValueError, match="level"):
        profile.profile_table(df, "deep")


def test_quality_passes_and_fails(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (None, None)], "k int, p double")
    assert rows(quality.unique(df, "k")) == [(1, 2)]
    assert quality.outside_unit(df, ["p"]).count() == 1
    assert quality.not_null(df, "k").count() == 1
    assert quality.freshness(spark.createDataFrame([], "t timestamp_ntz"), "t", datetime(2024, 1, 1), 1, 2).first()["status"] == "error"
    same = spark.createDataFrame([(None, 1)], "k string, v int")
    assert quality.rollup_mismatch(same, same, ["k"], ["v"]).count() == 0


def test_tag_closure_stops_at_its_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "tag string, other string")
    assert rows(planning.tag_closure(edges, ["a"], 2, 10), "tag") == [("a", 0), ("b", 1), ("c", 2)]
    assert planning.tag_closure(edges, ["a"], 9, 2).count() == 2
