"""Operators that work in rounds, by page, by budget or by sketch, and those that verify, against plain Python."""

import json
import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backfill, observe, ordered, planning, profile, rebuild, scope
from tidemark.plans import models
from tidemark.sources import testbed
from tidemark.sources.store import Store, StoreError


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module", autouse=True)
def parts_as_dealt(spark):
    """Else Spark would join these small parts to one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Windows --------------------------------------------------------------------------------------------------------------


def one_by_one(start, end, least, most):
    """The windows in the order in which a stack asks for them, left halves first, with whether each stays refused."""
    stack, out = [(start, end)], []
    while stack:
        s, e = stack.pop()
        if s >= e:
            continue
        if e - s > most and e - s > least:
            stack += [(s + (e - s) // 2, e), (s, s + (e - s) // 2)]
        else:
            out.append((s, e, e - s > most))
    return out


def longer_than(most):
    return lambda w: w.withColumn("refused", F.col("window_end") - F.col("window_start") > most)


@pytest.mark.parametrize(
    "start, end, least, most, expected",
    [
        (0, 11, 1, 2, [(0, 2), (2, 3), (3, 5), (5, 6), (6, 8), (8, 9), (9, 11)]),
        (0, 15, 10, 3, [(0, 7), (7, 15)]),
        (0, 10, 10, 3, [(0, 10)]),
        (5, 6, 0, 9, [(5, 6)]),
        (7, 7, 1, 1, []),
        (9, 7, 1, 1, []),
    ],
)
def test_windows_are_cut_where_they_are_refused(spark, start, end, least, most, expected):
    windows = spark.createDataFrame([(start, end)], "window_start long, window_end long")
    got = rows(planning.bisected_windows(windows, longer_than(most), least), "window_start")
    assert [g[:2] for g in got] == expected and [tuple(g) for g in got] == one_by_one(start, end, least, most)


def test_bisection_equals_asking_one_by_one(spark):
    r = random.Random(4)
    spans = [(i, s, s + r.choice([0, 1, 7, 50, 1000, 86_400]) + r.randrange(60), r.choice([1, 5, 40, 3_000])) for i in range(1000) for s in [r.randrange(10**6)]]
    windows = spark.createDataFrame(spans, "k int, window_start long, window_end long, most int").repartition(3)
    asked = []

    def refused(frontier):
        asked.append(frontier.count())
        return frontier.withColumn("refused", F.when(F.col("window_end") - F.col("window_start") > F.col("most"), True))

    got = defaultdict(list)
    for k, *window in rows(planning.bisected_windows(windows, refused, 20).select("k", "window_start", "window_end", "refused"), "k", "window_start"):
        got[k].append(tuple(window))
    want = {k: x for k, s, e, most in spans if (x := one_by_one(s, e, 20, most))}
    assert got == want and sum(asked) < 2 * sum(map(len, want.values()))


def test_plans_of_refused_windows_fail(spark):
    plans = spark.createDataFrame([("a",), ("b",), ("c",)], "clob_token_id string")
    windows = spark.createDataFrame([("a", 0, 8), ("b", 0, 40)], "clob_token_id string, window_start long, window_end long")
    asked = planning.bisected_windows(windows, longer_than(8), 30)
    assert rows(planning.bisected_plans(plans, asked), "clob_token_id") == [("a", 1, False), ("b", 2, True), ("c", 0, False)]


# Pages and budgets ----------------------------------------------------------------------------------------------------


def test_numbers_and_totals_over_many_parts(spark):
    r = random.Random(5)
    made = [(i, r.choice([0, 1, 2, None]), r.choice([None, 0, 3, 8])) for i in range(900)]
    df = spark.createDataFrame(made, "id int, k int, cost long").repartition(5)
    got = ordered.numbered(df, F.asc_nulls_first("k"), "id", total="cost")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    n = total = 0
    for i, k, cost in sorted(made, key=lambda x: (x[1] is not None, x[1] or 0, x[0])):
        n += 1
        made[i] = (i, k, cost, n, total)
        total += cost or 0
    assert rows(got.select("id", "k", "cost", "number", "cost_before"), "id") == made
    assert got.select("number").distinct().count() == 900


def test_pages(spark):
    df = spark.range(25).repartition(4)
    got = ordered.paged(df, 10, "id")
    assert rows(got, "id") == [(i, i // 10) for i in range(25)]
    assert ordered.paged(df.filter("id < 0"), 10, "id").count() == 0
    with pytest.raises(ValueError):
        ordered.paged(df, 0, "id")


def test_plans_by_page_the_shortest_first(spark):
    made = [(0, "a", "plan", 50, 0, 90), (1, "b", "dup_token", 50, None, None), (2, "c", "plan", 10, 80, 90), (3, "d", "plan", 5, 80, 90), (4, "e", "plan", 0, 89, 90), (5, "f", "plan", 0, 0, 90)]
    judged = spark.createDataFrame(made, "arrival long, clob_token_id string, outcome string, created_ts long, start_ts long, end_ts long").repartition(3)
    got = planning.plan_pages(judged, 4)
    assert rows(got.select("page", "place", "clob_token_id"), "page", "place") == [(0, 1, "d"), (0, 2, "c"), (0, 3, "a"), (1, 1, "e"), (1, 2, "f")]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_budget(spark):
    df = spark.createDataFrame([(1, 4), (2, 0), (3, 3), (4, None), (5, 9), (6, 0), (7, 1)], "id int, cost long")
    reached = lambda n: rows(ordered.within_budget(df, "cost", n, "id").select("id", "spent_before", "paid", "cut"), "id")
    assert reached(0) == [] and reached(4) == [(1, 0, 4, False)]
    assert reached(9) == [(1, 0, 4, False), (2, 4, 0, False), (3, 4, 3, False), (4, 7, 0, False), (5, 7, 2, True)]
    assert [x[0] for x in reached(100)] == [1, 2, 3, 4, 5, 6, 7]


def crawl(pages, seeds, rounds, most_tags, most_pages):
    """Tags read one by one, and whether the search was cut short."""
    seen, queue, spent, out = set(), list(dict.fromkeys(seeds)), 0, []
    for n in range(rounds + 1):
        if not queue:
            break
        following = []
        for tag in queue:
            if tag in seen:
                continue
            if len(seen) >= most_tags or (most_pages is not None and spent >= most_pages):
                return out, True
            seen.add(tag)
            own = pages.get(tag, [])
            read = own if most_pages is None else own[: most_pages - spent]
            out.append((tag, n, len(out), len(read)))
            spent += len(read)
            following += [t for page in read for t in page]
            if len(read) < len(own):
                return out, True
        queue = [t for t in dict.fromkeys(following) if t not in seen]
    return out, False


@pytest.mark.parametrize("seed", range(4))
def test_search_within_a_budget(spark, seed):
    r = random.Random(seed)
    tags = [f"t{i}" for i in range(14)]
    pages = {t: [r.sample(tags, r.randrange(4)) for _ in range(r.randrange(5))] for t in tags[:12]}
    df = spark.createDataFrame([(t, i, found) for t, p in pages.items() for i, found in enumerate(p)], "tag string, page int, found array<string>").repartition(3)
    for rounds, most_tags, most_pages in ((9, 99, None), (1, 99, None), (9, 4, None), (9, 99, 7), (9, 99, sum(map(len, pages.values()))), (9, 99, 0), (0, 5, 3)):
        got, cut = planning.tag_crawl(df, ["t0", "t3", "t0"], rounds, most_tags, most_pages)
        assert (rows(got, "place"), cut) == crawl(pages, ["t0", "t3", "t0"], rounds, most_tags, most_pages), (rounds, most_tags, most_pages)
    ledger = scope.Discovery().after(scope.Scope(), True, planning.tag_crawl(df, ["t0"], 9, 99)[1])
    assert ledger.fully_checked and not ledger.after(scope.Scope(), True, planning.tag_crawl(df, ["t0", "t1", "t2"], 9, 1)[1]).fully_checked


# Plans in full --------------------------------------------------------------------------------------------------------


def test_full_plans_take_tokens_as_they_are(spark):
    schema = "market_id string, arrival long, clob_token_id string, created_at string, cursor long, reason string, is_closed boolean, fully_checked boolean, empty_run_streak int, skip_budget int"
    made = [("m1", "tok_1", "2024-01-02 00:00:00"), ("m1", " tok_1", "2024-01-02 00:00:00"), ("m1", None, "2024-01-02 00:00:00"), ("m1", "", "2024-01-02 00:00:00")]
    made += [("m2", "tok_2", "2023-01-01 00:00:00"), ("m2", "tok_3", "2023-01-01 00:00:00"), ("m3", "tok_4", None)]
    df = spark.createDataFrame([(m, i, t, c, None, None, False, False, 0, 0) for i, (m, t, c) in enumerate(made)], schema)
    of = lambda full: [tuple(r) for r in planning.plan_stream(df, planning.PlanRules(1_710_000_000), datetime(2024, 1, 1), full=full).orderBy("arrival").select("clob_token_id", "outcome").collect()]
    assert of(True) == [("tok_1", "plan"), (" tok_1", "invalid_token"), ("", "invalid_token"), (None, "pre_clob_markets")]
    assert of(False) == [("tok_1", "plan"), ("tok_1", "dup_token"), ("tok_2", "pre_clob_markets"), ("tok_3", "pre_clob_markets")]


def test_markets_with_tokens(spark):
    at = datetime(2024, 1, 5)
    markets = spark.createDataFrame([(m, at, False, v) for m, v in (("a", 1.0), ("b", 9.0), ("c", 9.0), ("d", 9.0), ("e", None))] + [("f", None, True, 9.0)], "market_id string, created_at timestamp_ntz, is_closed boolean, volume double")
    tokens = spark.createDataFrame([("a", '["x"]'), ("b", " [1]"), ("c", "[]"), ("d", "text"), ("e", '["y"]'), ("f", '["z"]'), ("g", '["w"]'), ("a", None)], "market_id string, clob_token_ids string")
    ids = lambda **how: [r[0] for r in rows(planning.markets_with_tokens(markets, tokens, **how), "market_id")]
    assert ids() == ["a", "b", "e", "f"] and ids(lists_only=False) == ["a", "b", "d", "e", "f"]
    assert ids(created_from=datetime(2024, 1, 1)) == ["a", "b", "e"] and ids(admitted=F.col("volume") > 5) == ["b", "f"]


# Backfill -------------------------------------------------------------------------------------------------------------

PAYLOAD = "id string, clobTokenIds array<string>, slug string, endDate string, endDateIso string, events array<struct<id:string,slug:string>>"
MARKET = "market_id string, clob_token_ids string, slug string, event_slug string, end_date timestamp_ntz, note string"
EVENT = "row_order long, id string, slug string, markets array<struct<id:string,question:string>>"
MARK = "market_id string, field_name string, reason string, attempts int, last_checked_at timestamp_ntz, next_retry_at timestamp_ntz"


def test_backfill(spark):
    now, end = datetime(2024, 5, 1), datetime(2024, 6, 1)
    markets = [("whole", '["t"]', "s", "e", end), ("by_id", None, None, None, None), ("late", '["t"]', "s", None, end), ("lost", '["t"]', "s", " ", end)]
    markets += [("silent", None, None, None, None), ("waits", '["t"]', "s", None, end), ("again", '["t"]', "s", None, end)]
    markets = spark.createDataFrame([(*m, "n") for m in markets], MARKET)
    made = [("by_id", ["a", "b"], "new", None, "2024-07-01", [("1", "ev")]), ("late", [], "", None, None, [("1", "")]), ("lost", None, None, None, None, None)]
    made += [("waits", ["x"], "x", None, None, [("1", "x")]), ("whole", ["x"], "x", None, None, [("1", "x")]), ("again", None, None, "bad", None, [])]
    payloads = spark.createDataFrame([*made, made[0]], PAYLOAD)
    events = spark.createDataFrame([(1, "9", "found", [("late", "q"), ("by_id", "q"), ("silent", "q")]), (2, "9", " ", [("lost", "q")])], EVENT)
    waiting = [("waits", "event_slug", "old", 3, now, datetime(2024, 5, 2)), ("again", "event_slug", "old", 3, now, datetime(2024, 4, 30))]
    got = backfill.backfill(markets, payloads, events, spark.createDataFrame(waiting, MARK), now)
    assert {r[0]: r[1:] for r in rows(got.markets)} == {
        "whole": ('["t"]', "s", "e", end, "n"), "by_id": ('["a", "b"]', "new", "ev", datetime(2024, 7, 1), "n"), "late": ('["t"]', "s", "found", end, "n"),
        "lost": ('["t"]', "s", " ", end, "n"), "silent": (None, None, None, None, "n"), "waits": ('["t"]', "s", None, end, "n"), "again": ('["t"]', "s", None, end, "n"),
    }
    retry = datetime(2024, 5, 8)
    marks = {r["market_id"]: (r["reason"], r["attempts"], r["next_retry_at"]) for r in got.unresolved.collect()}
    assert marks == {"waits": ("old", 3, datetime(2024, 5, 2)), "again": (backfill.REASON, 4, retry), "lost": (backfill.REASON, 1, retry)}
    assert got.counts().first().asDict() == {"eligible": 5, "tokens": 1, "slug": 1, "event_slug": 2, "end_date": 1, "fallback": 1, "unresolved": 2}
    again = backfill.backfill(got.markets, payloads, events, got.unresolved, now)
    assert rows(again.found.select("market_id")) == [("silent",)]  # what was marked waits


# Rebuilds and retention -----------------------------------------------------------------------------------------------


def test_each_kind_of_damage_is_found(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    found = lambda new, key=("k", "v"), required=(): sorted(rows(rebuild.rebuild_violations(old, new, key, required)))
    make = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    whole = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    assert found(make(*whole), ["k"]) == [("duplicate", "k", 1)]
    assert found(make(*whole), [], ["v"]) == [("null", "v", 1)]
    assert found(make(*whole[1:]), []) == [("lost", "rows", 1)]
    assert found(make(*whole, (9, "z"), (1, "a")), []) == [("added", "rows", 2)]
    assert found(make((1, "a"), (2, "b"), (3, "x"), (3, None)), []) == [("added", "rows", 1), ("lost", "rows", 1)]
    assert found(make((None, "a"), *whole[1:3], (3, None)), [], ["k"]) == [("added", "rows", 1), ("lost", "rows", 1), ("null", "k", 1)]
    assert found(spark.createDataFrame([(1, 2.0)], "k long, w double"), ["v"]) == [("schema", "k", 1), ("schema", "v", 1), ("schema", "w", 0)]
    assert found(make(*reversed(whole)), []) == []


def test_only_a_sound_rebuild_is_exchanged(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.overwrite("x.t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    rebuild.exchange(store, "x.t", store.read("x.t").repartition(2), ["k"])
    with pytest.raises(StoreError, match="lost"):
        rebuild.exchange(store, "x.t", store.read("x.t").filter("k = 1"), ["k"])
    assert sorted(rows(store.read("x.t"))) == [(1, "a"), (2, "b")]


def test_retention_with_a_dry_run(spark, tmp_path):
    now, day = datetime(2024, 2, 1), 86_400
    limit = 1_706_745_600 - 30 * day
    made = [("t", limit - 400 * day), ("t", limit - 1), ("t", limit), ("t", limit + 5), ("u", limit + 9 * day)]
    df = spark.createDataFrame([(t, e, 0.5) for t, e in made], "clob_token_id string, odds_timestamp_epoch long, price double")
    df = df.withColumn("day", F.floor(F.col("odds_timestamp_epoch") / day + 0.5))  # parts that the cut goes through
    store = Store(spark, str(tmp_path))
    store.overwrite("x.h", df, by="day")
    want = {"cutoff_epoch": limit, "total_before": 5, "deleted": 2}
    assert rebuild.prune(store, "x.h", now, 30, "day", dry_run=True) == {**want, "remaining": 5} and store.read("x.h").count() == 5
    assert rebuild.prune(store, "x.h", now, 30, "day") == {**want, "remaining": 3}
    assert sorted(r[1] for r in rows(store.read("x.h"))) == [limit, limit + 5, limit + 9 * day]
    assert rebuild.prune(store, "x.h", now, 30, "day")["deleted"] == 0
    with pytest.raises(ValueError):
        rebuild.cutoff_epoch(now, 0)


# Sketches, snapshots, runs --------------------------------------------------------------------------------------------


def test_sketches_are_united_and_made_anew_by_day(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 20_011).alias("user"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))
    df.write.partitionBy("day").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    profile.distinct_sketches(stored, "day", "user", "half").write.parquet(str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    about = profile.united_distinct(kept, "user", "half").first()
    bound = 4 * 0.83 / 2 ** (profile.SKETCH_BITS / 2)
    assert abs(about["user"] - 20_011) < bound * 20_011 and abs(about["half"] - 30_000) < bound * 30_000
    assert profile.united_distinct(kept, "user", by="day").count() == 6
    anew = profile.refreshed_sketches(kept, stored.withColumn("user", F.lit(1)), "day", [0, 1], "user", "half")
    assert "PartitionFilters: [day" in anew._jdf.queryExecution().executedPlan().toString()  # no other day's files
    assert {r["day"]: r["user"] for r in profile.united_distinct(anew, "user", by="day").collect()}.get(0) == 1
    assert profile.united_distinct(kept.filter("day > 9"), "user").first()["user"] == 0


def test_snapshots_read_no_column(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "a"))
    got = observe.model_snapshot(spark, {"a": "a", "b": "b"}, lambda r: spark.read.parquet(str(tmp_path / r)))
    assert rows(got, "model") == [("a", "a", True, 50, None), ("b", "b", False, None, "AnalysisException")]
    assert "ReadSchema: struct<>" in got._jdf.queryExecution().executedPlan().toString()


def test_snapshot_of_all_models(spark):
    raw = testbed.raw_tables(spark, "/root/testdata/sf0.001")
    frames = models.build(raw, testbed.SCOPE)
    del frames["stg_odds"]
    got = {r["model"]: (r["exists"], r["row_count"]) for r in models.snapshot(spark, frames, testbed.SCOPE).collect()}
    assert len(got) == 19 and got.pop("stg_odds") == (False, None)
    assert all(there and n is not None for there, n in got.values())
    assert got["stg_markets"][1] == frames["stg_markets"].count()


def test_runs_are_kept_and_read_back(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert observe.last_run(store, "sync") is None
    for i in range(4):
        observe.record_run(store, f"r{i}", "sync", datetime(2024, 1, 1 + i), {"rows": i}, limit=3)
    observe.record_run(store, "x", "other", datetime(2024, 1, 9), {"rows": 99})
    assert observe.last_run(store, "sync") == {"rows": 3, "timestamp": "2024-01-04T00:00:00"}
    assert store.read(observe.RUNS).count() == 5 and store.read(observe.LAST_RUNS).count() == 2
    history = json.loads(store.read(observe.LAST_RUNS).filter("task_name = 'sync'").first()["history_json"])
    assert [h["rows"] for h in history] == [1, 2, 3]
    broken = store.read(observe.LAST_RUNS).withColumn("metrics_json", F.lit("[1"))
    store.overwrite(observe.LAST_RUNS, broken)
    assert observe.last_run(store, "sync")["rows"] == 3  # from the note
    store.overwrite(observe.NOTES, store.read(observe.NOTES).withColumn("value", F.lit("7")))
    assert observe.last_run(store, "sync") is None


def test_audit_by_source(spark):
    markets = spark.createDataFrame([("1", "in"), ("2", "out"), ("3", "in"), ("4", None)], "market_id string, event_slug string")
    registry = spark.createDataFrame([("1", "seed"), ("1", "seed"), ("1", None), ("2", "seed"), ("9", "seed")], "market_id string, source string")
    got = observe.scope_audit_by_source(markets, registry, scope.Scope(slugs=["in"]))
    assert rows(got, "source") == [("none", 2, 0, 1, 1), ("seed", 2, 1, 1, 0), ("unknown", 1, 0, 1, 0)]
    assert rows(observe.count_by_source(registry), "source") == [("seed", 4, 3), ("unknown", 1, 1)]
