"""The live trial loop and event-time vote rates as Structured Streaming.

Both batch replay and stream run operators.adaptive.Loop, so what a stream shows is what a replay expects.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.adaptive import Loop

SHOWN = "rater string, step int, trial_id string, axis string, a double, b double, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrialLoop(StatefulProcessor):
    """One rater's study as state: its answers as a list that is only added to, its posterior as a value, and a timer.

    An answer costs one step of the policy, however many came before. Without a timeout (milliseconds of event time after
    the last answer) a study stays open; with one, the timer closes it: a closed or completed study keeps only that mark.
    """

    def __init__(self, pool: list[dict], most: int, timeout: int | None):
        self.pool, self.most, self.timeout = pool, most, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = Loop(self.pool, self.most)
        self.answers = handle.getListState("answers", "place int, choice string")
        self.posterior = handle.getValueState("posterior", "x array<double>, y array<double>")
        self.ended = handle.getValueState("ended", "step int, status string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values("step", kind="stable")
        out = []
        if not self.ended.exists():
            given = [(p, c) for p, c in self.answers.get()]
            self.loop.resume(given, dict(zip("xy", map(np.array, self.posterior.get()), strict=True)) if self.posterior.exists() else None)
            before = len(given)
            for step, choice in zip(batch["step"].tolist(), batch["choice"].tolist(), strict=True):
                now = self.loop.next()
                if step != len(self.loop.history) or now is None:
                    out.append((key[0], int(step), None, None, None, None, "mismatch"))
                    continue
                self.loop.answer(now[0], choice)
                after = self.loop.next()
                if after is None:
                    out.append((key[0], int(step), None, None, None, None, "complete"))
                else:
                    t, repeat = self.loop.pool[after[0]], after[1]
                    out.append((key[0], int(step), t["repeat_id"] if repeat else t["trial_id"], t["axis"], float(t["b"] if repeat else t["a"]), float(t["a"] if repeat else t["b"]), "repeat" if repeat else "next"))
            added = self.loop.history[before:]
            if self.loop.next() is None:
                self.end(len(self.loop.history), "complete")
            elif added:
                self.answers.appendList(added)
                self.posterior.update(tuple(self.loop.post[a].tolist() for a in "xy"))
            if self.timeout is not None and not self.ended.exists():
                self.stop_timers()
                self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.timeout)
        else:
            out += [(key[0], int(step), None, None, None, None, "mismatch") for step in batch["step"].tolist()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOWN.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        steps = sum(1 for _ in self.answers.get())
        self.end(steps, "timeout")
        yield pd.DataFrame([(key[0], steps, None, None, None, None, "timeout")], columns=[c.split()[0] for c in SHOWN.split(", ")])

    def end(self, step: int, status: str) -> None:
        self.answers.clear()
        self.posterior.clear()
        self.stop_timers()
        self.ended.update((step, status))

    def stop_timers(self) -> None:
        if self.timeout is not None:  # without one a query has no timers to ask for
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)

    def close(self) -> None:
        pass


def live_trials(answers: DataFrame, pool: list[dict], most: int = 16, timeout: str | None = None) -> DataFrame:
    """For each answer of a rater the trial that comes next; status is next, repeat, complete, mismatch or timeout.

    answers: rater, step (0 for the first answer), choice, and with a timeout (such as "30 minutes") ts. An answer out of
    step, or to a study that has ended, isn't applied and is reported. Write the result in append mode. State is kept in
    RocksDB, which this sets for the session's next queries.
    """
    spark = answers.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    milliseconds = None
    if timeout is not None:
        milliseconds = int(spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00+00:00' + INTERVAL {timeout}) AS t").first()["t"])
        answers = answers.withWatermark("ts", "0 seconds")
    return answers.groupBy("rater").transformWithStateInPandas(TrialLoop(pool, most, milliseconds), SHOWN, "append", "None" if timeout is None else "EventTime")


def vote_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; on a stream, windows close once the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "event_type", "n", "total")


def rater_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of one rater's events, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_timestamp(F.col("w.start")).alias("session_start"), "n")
