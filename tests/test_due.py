"""Due times of a stream against the batch operator, run after run."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import planning
from tidemark.streaming import due

RULES = planning.RetryRules(routine=600, error=30, base=60, most=3600)
WINDOW = "clob_token_id string, window_start long, window_end long, status string, rows long, last_ts long, message string"
PLAN = "clob_token_id string, start_ts long, end_ts long, is_closed boolean, empty_run_streak int"


def made(seed, tokens=12, runs=6):
    """Runs by batch: (token, start, end, closed, windows)."""
    r, out = random.Random(seed), []
    for n in range(runs):
        batch = []
        for t in range(tokens):
            if r.random() < 0.4:
                continue  # no run of this token
            start, windows = 10_000 * n + r.randrange(50), []
            for w in range(r.randrange(4)):
                status = r.choice(["ok"] * 6 + ["error", "permanent"])
                rows = r.choice([0, 0, 3]) if status == "ok" else 0
                windows.append((start + 100 * w, start + 100 * w + 100, status, rows, start + 100 * w + r.randrange(100) if rows else None, "why"))
            batch.append((f"t{t}", start, start + 500, r.random() < 0.2, windows))
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_run_equals_the_batch_operator(spark, seed):
    names = ("window_start", "window_end", "status", "rows", "last_ts", "message")
    flat = [(f"{b}-{t}", s, e, c, w) for b, batch in enumerate(made(seed)) for t, s, e, c, w in batch]
    results = spark.createDataFrame([(t, *w) for t, *_, windows in flat for w in windows], WINDOW)
    plans = spark.createDataFrame([(t, s, e, c, 2) for t, s, e, c, _ in flat], PLAN)
    want = {r["clob_token_id"]: r.asDict() for r in planning.state_transitions(results, plans, RULES).collect()}
    for t, s, e, c, windows in flat:
        got = due.after_run(s, e, c, [dict(zip(names, w)) for w in windows], 2, RULES)
        assert got == {k: want[t][k] for k in got}, (windows, got, want[t])


def test_states_outlive_batches_and_timers_fire(spark, tmp_path):
    batches = made(9)
    last, streaks = {}, {}
    for batch in batches:
        results = spark.createDataFrame([(t, *w) for t, *_, windows in batch for w in windows], WINDOW)
        plans = spark.createDataFrame([(t, s, e, c, streaks.get(t, 0)) for t, s, e, c, _ in batch], PLAN)
        for r in planning.state_transitions(results, plans, RULES).collect():
            streaks[r["clob_token_id"]] = r["empty_run_streak"]
            last[r["clob_token_id"]] = (r["cursor"], r["checked_ts"], r["next_check_ts"], r["empty_run_streak"], r["fully_checked"])
    old = spark.conf.get(due.STATE_STORE[0])
    spark.conf.set(*due.STATE_STORE)
    try:
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, due.RUNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(due.RUNS).parquet(str(tmp_path / "in"))
            keep = lambda df, _, n=n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))
            out = due.due_times(stream, RULES, "10 seconds").writeStream.foreachBatch(keep).outputMode("update")
            query = out.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(due.STATE_STORE[0], old)
    out = spark.read.parquet(str(tmp_path / "out"))
    states = out.filter(F.col("kind") == "state").orderBy("n").collect()  # over all restarts
    got = {r["clob_token_id"]: (r["cursor"], r["checked_ts"], r["next_check_ts"], r["empty_run_streak"], r["fully_checked"]) for r in states}
    assert got == last
    fired = out.filter("kind = 'due'").collect()
    assert fired and len({(r["clob_token_id"], r["next_check_ts"]) for r in fired}) == len(fired)
    for r in fired:  # the stream has passed each token's next check
        assert r["next_check_ts"] <= max(e for batch in batches[: r["n"] + 1] for _, _, e, *_ in batch)
