"""Landing, the store, the layered build and streaming, end to end on small tables."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intake, ohlc, profile
from tidemark.operators.scope import Scope
from tidemark.plans import models
from tidemark.sources import landing
from tidemark.sources.schemas import TABLES
from tidemark.sources.store import ContractError, Store, StoreError, checked, export
from tidemark.streaming import ingest

NOW = datetime(2025, 6, 1)
MARKET = {
    "id": "m1", "question": "Q?", "outcomes": ["Yes", "No"], "volumeNum": "12345.67", "active": True, "closed": False, "createdAt": "2025-01-01T00:00:00Z",
    "clobTokenIds": ["tok_1", "tok_2"], "slug": "q", "events": [{"id": "99", "slug": "ev"}], "extra": 1,
}


def _landed(spark, folder, *payloads):
    (folder / "part.json").write_text("\n".join(map(json.dumps, payloads)) + "\nnot json\n")
    return landing.read_markets(spark, str(folder))


def test_payloads_become_markets_and_tokens(spark, tmp_path):
    shaped = landing.shape_markets(_landed(spark, tmp_path, MARKET, {"id": "m2", "volumeNum": None, "clobTokenIds": []}), NOW)
    markets, tokens = landing.split_tokens(shaped, NOW)
    one = markets.filter("id = 'm1'").first()
    assert (one["volume"], one["created_at"], one["event_id"], json.loads(one["outcomes"])) == (12345.67, datetime(2025, 1, 1), "99", ["Yes", "No"])
    two = markets.filter("id = 'm2'").first()
    assert (two["volume"], two["active"], two["created_at"], two["event_slug"]) == (0.0, False, None, None)
    assert [r["market_id"] for r in tokens.collect()] == ["m1"]
    assert checked(markets, TABLES["raw.markets"]).columns == [f.name for f in TABLES["raw.markets"].fields]


def test_texts_are_read_like_files(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(MARKET),), ("not json",), ("[1]",), ("null",), (None,), (json.dumps({"slug": "x"}),)], "value string")
    from_files = landing.shape_markets(_landed(spark, tmp_path, MARKET), NOW).collect()
    assert landing.shape_markets(landing.parsed_markets(lines), NOW).collect() == from_files


def test_stages_are_replaced_and_never_emptied(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    made = landing.bootstrap(store)
    assert set(made) == set(TABLES) == set(store.tables()) and landing.bootstrap(store) == []
    assert store.read("ops.scrape_metadata").count() == 0
    make = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    landing.load_stage(store, "ops.scrape_metadata", make(("a", "1"), ("b", "2")))
    landing.load_stage(store, "ops.scrape_metadata", make(("c", "3")))
    with pytest.raises(ContractError, match="no rows"):
        landing.load_stage(store, "ops.scrape_metadata", make(("c", "3")).filter("key = 'x'"))
    with pytest.raises(ContractError):
        landing.load_stage(store, "ops.scrape_metadata", spark.createDataFrame([(1,)], "key int"))
    assert [tuple(r) for r in store.read("ops.scrape_metadata").collect()] == [("c", "3")]


def test_contract_refuses_other_columns_and_types(spark):
    with pytest.raises(ContractError):
        checked(spark.createDataFrame([("a", 1)], "key string, value int"), TABLES["ops.scrape_metadata"])


def test_store_reads_the_version_that_it_replaces(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("ops.scrape_metadata").count() == 0
    with pytest.raises(LookupError):
        store.read("no.where")
    store.overwrite("ops.scrape_metadata", spark.createDataFrame([("a", "1")], "key string, value string"))
    store.overwrite("ops.scrape_metadata", store.read("ops.scrape_metadata").withColumn("value", F.lit("2")))
    store.append("ops.scrape_metadata", spark.createDataFrame([("b", "3")], "key string, value string"))
    assert {tuple(r) for r in store.compact("ops.scrape_metadata", 1).collect()} == {("a", "2"), ("b", "3")}
    assert store.tables() == ["ops.scrape_metadata"]


PAIR = "key string, value string"


def _files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("part-*.parquet")}


def test_a_table_that_lost_its_manifests_is_an_error(spark, tmp_path):
    """Not an empty table, which the next merge would make of it."""
    store, name = Store(spark, str(tmp_path)), "ops.scrape_metadata"
    store.overwrite(name, spark.createDataFrame([("a", "1")], PAIR))
    for f in (tmp_path / "ops/scrape_metadata/_versions").iterdir():
        f.unlink()
    with pytest.raises(StoreError):
        store.read(name)
    with pytest.raises(StoreError):
        store.append(name, spark.createDataFrame([("b", "2")], PAIR))


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    store, name = Store(spark, str(tmp_path)), "ops.scrape_metadata"
    store.overwrite(name, spark.createDataFrame([("a", "1")], PAIR))
    monkeypatch.setattr(store, "_name", lambda *_: 1 / 0)
    for write in (store.overwrite, store.append):
        with pytest.raises(ZeroDivisionError):
            write(name, spark.createDataFrame([("b", "2")], PAIR))
    assert [tuple(r) for r in Store(spark, str(tmp_path)).read(name).collect()] == [("a", "1")]


def test_the_slower_of_two_writers_fails(spark, tmp_path):
    store, name = Store(spark, str(tmp_path)), "ops.scrape_metadata"
    store.overwrite(name, spark.createDataFrame([("a", "1")], PAIR))
    parts = store._written(name, spark.createDataFrame([("b", "2")], PAIR), None)
    store.append(name, spark.createDataFrame([("c", "3")], PAIR))
    with pytest.raises(StoreError):
        store._name(name, 1, parts)
    assert {r["key"] for r in store.read(name).collect()} == {"a", "c"}


def test_appends_and_replaced_parts_leave_other_files_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(list(rows), "day string, n int").coalesce(1)
    store.overwrite("x.t", make(("a/b", 1), ("c", 2), ("c", 3)), by="day")
    before = _files(tmp_path)
    store.replace("x.t", make(("c", 9)), "day", ["c", "d"])
    assert before < _files(tmp_path) and len(_files(tmp_path) - before) == 1
    assert sorted(map(tuple, store.read("x.t").collect())) == [("a/b", 1), ("c", 9)]
    assert [tuple(r) for r in store.read("x.t", parts=["a/b"]).collect()] == [("a/b", 1)]
    assert store.read("x.t", parts=["nowhere"]).count() == 0
    with pytest.raises(StoreError):
        store.replace("x.t", make(("e", 9)), "day", ["c"])
    before = _files(tmp_path)
    store.append("x.t", make(("f", 5)), by="day")
    assert len(_files(tmp_path) - before) == 1 and store.read("x.t").count() == 3
    assert store.compact("x.t", 1, by="day").count() == 3


def test_what_would_hide_rows_of_a_table_in_parts_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    make = lambda *rows: spark.createDataFrame(list(rows), "day string, n int").coalesce(1)
    store.overwrite("x.t", make(("a", 1), ("b", 2)), by="day")
    store.overwrite("x.whole", make(("a", 1)))
    for refused in (
        lambda: store.append("x.t", make(("a", 5))), lambda: store.compact("x.t", 1), lambda: store.overwrite("x.t", make(("a", 5))),
        lambda: store.compact("x.t", 1, by="n"), lambda: store.append("x.whole", make(("a", 5)), by="day"),
        lambda: store.replace("x.whole", make(("a", 5)), "day", ["a"]), lambda: store.read("x.whole", parts=["a"]),
    ):
        with pytest.raises(StoreError):
            refused()
    assert sorted(map(tuple, store.read("x.t").collect())) == [("a", 1), ("b", 2)] and store.read("x.whole").count() == 1
    store.append("x.t", make(("a", 5)), by="day")
    assert sorted(map(tuple, store.read("x.t", parts=["a"]).collect())) == [("a", 1), ("a", 5)]
    assert sorted(map(tuple, store.replace("x.t", make(("a", 7)), "day", ["a"]).collect())) == [("a", 7), ("b", 2)]


def test_compaction_between_batches_changes_nothing(spark, tmp_path):
    """Ingest, compact, ingest equals ingest, ingest; late rows replace those before the compaction."""
    make = lambda *rows: spark.createDataFrame(list(rows), ingest.OBSERVATIONS)
    first = [("t_1", 1710000000, 0.1, 0), ("t_1", 1710000300, 0.9, 1), ("t_2", 1710000000 + 86_400, 0.4, 2)]
    second = [("t_1", 1710000300, 0.5, 3), ("t_3", 1710000000, 0.2, 4)]
    got = []
    for compacted in (False, True):
        store = Store(spark, str(tmp_path / str(compacted)))
        ingest.ingest_batch(store, make(*first))
        if compacted:
            store.compact(ingest.HISTORY, 1, by=ingest.DAY)
            store.compact(ingest.DAILY, 2, by=ingest.DAY)
        ingest.ingest_batch(store, make(*second))
        got.append([sorted(map(tuple, store.read(t).collect())) for t in (ingest.HISTORY, ingest.DAILY)])
    assert got[0] == got[1] and len(got[0][0]) == 4


def test_refused_rows_are_counted_and_kept_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("t", 1710000000, 0.5, 0), ("t", 1710000000, 0.6, 1), (None, 1710000000, 0.5, 2), ("t", 0, 7.0, 3), ("t", None, 0.5, 4)]
    rows += [("t", 1710000000, p, 5) for p in (-0.1, 1.1, None, float("nan"))]
    counts = ingest.ingest_batch(store, spark.createDataFrame(rows, ingest.OBSERVATIONS).repartition(3))
    assert counts == {"rows": 9, "kept": 2, "no_token": 1, "invalid_ts": 2, "invalid_price": 4, "deduped": 1}
    refused = store.read(ingest.REFUSED)
    by = {r["reason"]: r["count"] for r in refused.groupBy("reason").count().collect()}
    assert by == {"no_token": 1, "invalid_ts": 2, "invalid_price": 4}
    assert ingest.ingest_batch(store, spark.createDataFrame(rows[2:3], ingest.OBSERVATIONS)) == {"rows": 1, "kept": 0, "no_token": 1, "invalid_ts": 0, "invalid_price": 0, "deduped": 0}
    assert store.read(ingest.REFUSED).count() == 8 and store.read(ingest.HISTORY).count() == 1


def test_drops_are_counted_in_the_write_itself(spark, tmp_path):
    """One scan of the source in the plan that writes, and counts equal to a second pass."""
    rows = [(f"t{i % 9}", i - 50, i / 700, i) for i in range(1000)]
    spark.createDataFrame(rows, ingest.OBSERVATIONS).write.parquet(str(tmp_path / "in"))
    judged = intake.judged(spark.read.parquet(str(tmp_path / "in")))
    drops = intake.Drops(judged)
    assert drops.kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    drops.kept.write.parquet(str(tmp_path / "out"))
    second = {r["reason"]: r["count"] for r in judged.groupBy("reason").count().collect()}
    assert drops.counts() == {"rows": 1000, "kept": second[None], "no_token": 0, "invalid_ts": second["invalid_ts"], "invalid_price": second["invalid_price"]}
    assert spark.read.parquet(str(tmp_path / "out")).count() == second[None] and drops.refused.count() == 1000 - second[None]


def test_orphans_are_counted_in_the_write_itself(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 7), i) for i in range(50)] + [(None, 99)], "market_id string, n int")
    parents = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "market_id string")
    found = intake.Referred(rows, parents, "market_id")
    found.kept.write.parquet(str(tmp_path / "out"))
    want = sum(i % 7 in (1, 2) for i in range(50))
    assert found.counts() == {"rows": 51, "kept": want, "orphans": 51 - want} and found.refused.count() == 51 - want
    for n, (some, known) in enumerate(((rows, parents.filter("market_id > 'x'")), (rows.filter("n > 1000"), parents))):
        found = intake.Referred(some, known, "market_id")
        found.kept.write.parquet(str(tmp_path / f"out{n}"))
        assert found.counts() == ({"rows": 51, "kept": 0, "orphans": 51} if n == 0 else {"rows": 0, "kept": 0, "orphans": 0})


def test_old_files_are_removed_in_time(spark, tmp_path, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "STALE_MS", -10_000)
    store = Store(spark, str(tmp_path))
    for i in range(5):
        store.overwrite("x.t", spark.createDataFrame([(i,)], "n int").coalesce(1))
    assert len(_files(tmp_path)) == 2 and [r[0] for r in store.read("x.t").collect()] == [4]


def test_a_batch_writes_only_its_days_again(spark, tmp_path):
    store, day = Store(spark, str(tmp_path)), 86_400
    make = lambda *rows: spark.createDataFrame(list(rows), ingest.OBSERVATIONS).coalesce(1)
    ingest.ingest_batch(store, make(*((f"tok_{d}", 1710000000 + d * day, 0.5, d) for d in range(20))))
    before = _files(tmp_path)
    ingest.ingest_batch(store, make(("tok_3", 1710000000 + 3 * day, 0.7, 99), ("tok_x", 1710000000 + 3 * day, 0.1, 100)))
    assert len(_files(tmp_path) - before) == 2  # a day of the history, and its prices
    assert store.read(ingest.HISTORY).count() == 21 and store.read(ingest.DAILY).count() == 21
    assert store.read(ingest.DAILY).filter("clob_token_id = 'tok_3'").first()["close_price"] == 0.7
    ingest.ingest_batch(store, make(("tok_3", -1, 0.7, 99)))


def test_report_of_profiles(spark, tmp_path):
    good = spark.createDataFrame([("x", 1.5, True), (None, None, None)], "id string, price double, active boolean")
    bad = good.select("id", F.raise_error(F.lit("broken")).alias("oops"))
    found = profile.report({"good": good, "bad": bad}, NOW)
    assert [t["n_rows"] for t in found["tables"]] == [2, 2] and "error" in found["tables"][1]["columns"][1]
    text = profile.as_markdown(found)
    assert "## good: 2 rows, 3 columns" in text and "`price` (double): null_percent 50.0" in text and "`oops`: error" in text
    profile.write_report(spark, found, str(tmp_path))
    assert json.loads(spark.read.text(f"{tmp_path}/json").first()[0])["tables"][0]["table"] == "good"
    assert spark.read.text(f"{tmp_path}/markdown").first()[0] == "# Profile"
    assert "No tables" in profile.as_markdown(profile.report({}, NOW))


def test_metadata_is_filled_in(spark):
    markets = spark.createDataFrame([("m1", None, "ev", None), ("m2", None, None, None)], "id string, slug string, event_slug string, end_date timestamp_ntz")
    payloads = spark.createDataFrame([("m1", "s", [("9", "other")], "2025-01-02T00:00:00Z", None)], "id string, slug string, events array<struct<id: string, slug: string>>, endDate string, endDateIso string")
    assert sorted(map(tuple, landing.resolve_metadata(markets, payloads).collect())) == [("m1", "s", "ev", datetime(2025, 1, 2)), ("m2", None, None, None)]


def test_last_run_of_a_task(spark):
    from tidemark.operators import observe

    runs = spark.createDataFrame([("a", datetime(2025, 1, d), t) for d, t in ((1, '{"rows": 1}'), (2, '{"rows": 2, "x": "y"}'), (3, "{"))] + [("b", NOW, '{"rows": 9}')], "task_name string, recorded_at timestamp_ntz, metrics_json string")
    assert [tuple(r) for r in observe.read_run(runs.filter("recorded_at < '2025-01-03'"), "a", {"rows": "bigint", "x": "bigint"}).collect()] == [("a", datetime(2025, 1, 2), 2, None)]
    assert observe.read_run(runs, "a", {"rows": "bigint"}).first()["rows"] is None


def _raw(spark):
    make = lambda name, rows: spark.createDataFrame(rows, TABLES[name])
    history = [("tok_1", 1710000000, 0.4, NOW), ("tok_1", 1710000300, 0.6, NOW), ("tok_2", 1710000000, 0.6, NOW)]
    daily = ohlc.daily_ohlc(models.stg_odds(make("raw.odds_history", history))).withColumnRenamed("clob_token_id", "clobTokenId")
    return {
        "raw.markets": make("raw.markets", [("m1", "Q?", "c", "d", '["Yes","No"]', 150000.0, True, False, NOW, NOW, None, "q", "ev-1", "1")]),
        "raw.market_tokens": make("raw.market_tokens", [("m1", '["tok_1","tok_2","tok_3"]', NOW), ("m9", "broken", NOW)]),
        "raw.odds_history": make("raw.odds_history", history),
        "raw.token_odds_daily": daily.withColumn("refreshed_at", F.lit(NOW).cast("timestamp_ntz")),
        "ops.token_sync_ledger": make("ops.token_sync_ledger", [("tok_1", 1710000300, True, NOW, None, None)]),
        "ops.token_sync_skips": make("ops.token_sync_skips", [("tok_3", None, NOW)]),
        "ops.pipeline_run_events": make("ops.pipeline_run_events", [("r1", "sync_odds", NOW, '{"tokens": 0, "rows": 5}'), ("r2", "other", NOW, "{")]),
        "ops.market_registry": make("ops.market_registry", []),
    }


def test_build_and_its_checks(spark, tmp_path):
    store, limits = Store(spark, str(tmp_path)), Scope(prefixes=["ev-"])
    frames = models.build(_raw(spark), limits, publish=lambda name, rows: store.overwrite(f"marts.{name}", rows))
    tokens = {r["clob_token_id"]: r for r in frames["token_coverage"].collect()}
    assert (tokens["tok_1"]["token_days_observed"], tokens["tok_1"]["has_daily_odds"], tokens["tok_3"]["has_daily_odds"]) == (1, 1, 0)
    assert (tokens["tok_3"]["has_persisted_skip"], tokens["tok_1"]["market_fully_checked"], tokens["tok_1"]["market_token_count"]) == (False, False, 3)
    assert {(r["outcome_index"], r["outcome_label"]) for r in frames["int_token_universe"].collect()} == {(0, "Yes"), (1, "No"), (2, None)}
    assert frames["whale_minutely_odds"].count() == 3
    assert frames["int_token_timeseries"].filter("price is null").count() == 1
    run = frames["run_observability"].collect()
    assert [(r["run_id"], r["rows_per_processed_token"]) for r in run] == [("r1", None)]
    assert models.violations(frames, limits).filter("n_violations > 0").count() == 0


def test_export_describes_what_it_wrote(spark, tmp_path):
    frames = models.build(_raw(spark), Scope(prefixes=["ev-"]))
    spec = export(frames["scoped_minutely_odds"], str(tmp_path), {"price": "probability"}, "outcome_label")
    assert spec["statistics"]["n_rows"] == 3 and spec["top_labels"][0] == ["Yes", 2]
    assert {"name": "price", "type": "double", "about": "probability"} in spec["columns"]


def _observed(n, seed):
    r = random.Random(seed)
    return [(f"tok_{r.randrange(3)}", 1710000000 + r.randrange(40) * 9000, r.random(), i) for i in range(n)]


def test_stream_in_any_order_equals_a_batch(spark, tmp_path):
    rows = _observed(60, 1)
    batches = [rows[i : i + 15] for i in range(0, 60, 15)]
    expected = None
    for order in ([0, 1, 2, 3], [0, 1, 1, 2, 3]):  # with a batch delivered twice
        folder = tmp_path / f"run{len(order)}"
        for i, b in enumerate(order):
            spark.createDataFrame(batches[b], ingest.OBSERVATIONS).coalesce(1).write.mode("append").parquet(str(folder / "landed"))
            store = Store(spark, str(folder / "store"))
            stream = ingest.landed(spark, str(folder / "landed"))
            query = ingest.ingest(store, stream, str(folder / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
        daily = sorted(map(tuple, store.read(ingest.DAILY).collect()))
        last = {}
        for t, e, p, n in rows:
            last[t, e] = (n, p)
        whole = ohlc.daily_ohlc(spark.createDataFrame([(t, e, p) for (t, e), (_, p) in last.items()], "clob_token_id string, odds_timestamp_epoch bigint, price double"))
        expected = expected or sorted(map(tuple, whole.collect()))
        assert daily == expected


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("t", 1710000000, 0.2, 0), ("t", 1710000060, 0.4, 1), ("t", 1710090000, 0.3, 2)], ingest.OBSERVATIONS).write.parquet(str(tmp_path / "in"))
    out = ingest.windowed_ohlc(ingest.landed(spark, str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("windows").orderBy("window_start").select("open_price", "close_price", "observed_points").collect()] == [(0.2, 0.4, 2), (0.3, 0.3, 1)]
