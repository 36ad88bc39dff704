"""Due times of tokens in a stream of finished runs: state for each token, and timers that say when to check it again.

``RUNS`` are the columns of a run: the token, its plan's start and end in epoch seconds, whether its market is closed, and its
windows as ``planning.state_transitions`` takes them. The state of a token outlives batches and restarts, so a streak of empty
runs, and with it the wait, grows over all of them; the batch operator, run after run, gives the same states.

Time is that of the runs' ends. A timer fires once the stream has passed a token's next check by the watermark's delay; runs
that come later than that are dropped, as by any watermark. A new run of a token takes its earlier timer back. A token that a
permanent error ended, or that is closed and fully checked, has no next check. Rows without a token are left out. State
needs the store that keeps it on disk (``STATE_STORE``), one row for each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ohlc import TOKEN
from tidemark.operators.planning import RetryRules

RUNS = (
    f"{TOKEN} string, start_ts bigint, end_ts bigint, is_closed boolean, "
    "windows array<struct<window_start:bigint,window_end:bigint,status:string,rows:bigint,last_ts:bigint,message:string>>"
)
#: ``kind`` is ``state`` after a run and ``due`` when a timer fires.
STATES = (
    f"{TOKEN} string, kind string, cursor bigint, checked_ts bigint, next_check_ts bigint, empty_run_streak int, fully_checked boolean, "
    "rows bigint, error boolean, skip_reason string"
)
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_KEPT = "cursor bigint, checked_ts bigint, next_check_ts bigint, empty_run_streak int, fully_checked boolean"


def after_run(start: int, end: int, closed: bool, windows: list[dict], streak: int, rules: RetryRules) -> dict:
    """A token's state after one run, by the rules of ``planning.state_transitions``."""
    seen = seen_first = reached = None
    rows, failed, message = 0, False, None
    permanent = False
    for w in sorted(windows, key=lambda w: w["window_start"]):
        if w["status"] == "permanent":
            permanent, message = True, w["message"]
            break
        if w["status"] != "ok":
            failed = True
            continue
        n = int(w["rows"] or 0)
        rows += n
        if n > 0 and w["last_ts"] is not None:
            seen = max(seen if seen is not None else w["last_ts"], w["last_ts"])
            seen_first = seen if not failed else seen_first
        reached = max(reached or 0, w["window_end"]) if not failed else reached
    failed, empty = failed and not permanent, rows == 0
    if permanent:
        cursor = end
    elif failed:
        cursor = seen_first if seen_first is not None and seen_first > start else reached if empty and reached is not None and reached > start else None
    else:
        cursor = end if empty else max(x for x in (seen, start) if x is not None)
    checked = bool(closed) and not failed and not permanent
    streak = streak + 1 if empty and not failed and not permanent else 0
    if failed:
        wait = max(0, rules.error)
    elif empty:
        wait = max(0, rules.base) * 2 ** min(62, max(0, streak - 1))
        wait = min(wait, rules.most) if rules.most > 0 else wait
    else:
        wait = max(0, rules.routine)
    return {
        "cursor": cursor, "checked_ts": end, "next_check_ts": None if permanent or checked else end + wait, "empty_run_streak": streak,
        "fully_checked": checked, "rows": rows, "error": failed or permanent, "skip_reason": message,
    }


class DueTimes(StatefulProcessor):
    """Keeps each token's state and its one timer."""

    def __init__(self, rules: RetryRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs = [r for part in rows for r in part.to_dict("records")]  # of one token in one batch
        old = self.state.get() if self.state.exists() else None
        streak, timer, out = (old[3], old[2], []) if old else (0, None, [])
        for run in sorted(runs, key=lambda r: (r["end_ts"], r["start_ts"])):
            windows = [dict(w) if isinstance(w, dict) else w.asDict() for w in (run["windows"] if run["windows"] is not None else [])]
            new = after_run(int(run["start_ts"]), int(run["end_ts"]), bool(run["is_closed"]), windows, streak, self.rules)
            streak = new["empty_run_streak"]
            out.append({TOKEN: key[0], "kind": "state", **new})
        if timer is not None:
            self.handle.deleteTimer(int(timer) * 1000)
        self.state.update(tuple(new[c.split()[0]] for c in _KEPT.split(", ")))
        if new["next_check_ts"] is not None:
            self.handle.registerTimer(new["next_check_ts"] * 1000)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cursor, checked, due, streak, whole = self.state.get()
        if due is not None and due * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            row = {"cursor": cursor, "checked_ts": checked, "next_check_ts": due, "empty_run_streak": streak, "fully_checked": whole}
            yield _frame([{TOKEN: key[0], "kind": "due", **row, "rows": 0, "error": False, "skip_reason": None}])

    def close(self) -> None:
        """Nothing is open."""


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in STATES.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("cursor", "checked_ts", "next_check_ts", "rows")} | {"empty_run_streak": "Int32"})


def due_times(runs: DataFrame, rules: RetryRules = RetryRules(), late: str = "10 minutes") -> DataFrame:
    """The states after each run of a stream, and the tokens that fall due."""
    timed = runs.filter(F.col(TOKEN).isNotNull() & F.col("end_ts").isNotNull()).withColumn("ended_at", F.timestamp_seconds("end_ts"))
    keyed = timed.withWatermark("ended_at", late).groupBy(TOKEN)
    return keyed.transformWithStateInPandas(DueTimes(rules), STATES, outputMode="Update", timeMode="EventTime")
