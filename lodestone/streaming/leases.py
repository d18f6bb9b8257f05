"""Leases on jobs as a stream: who holds a job, under which fencing token, and what a late holder may no longer do.

Each event is a worker's word on a job: the first claims it; the holder's later ones renew the lease; another worker's are fenced off while the lease lives; after it has run out,
the next word takes the job over under a new token. A job that has been taken over so often is quarantined, and nobody gets it. The state of a job is one small row in the state store, so
it outlives executors and restarts; a timer at the end of a lease says, once the watermark has passed it, that the job may be taken over.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds, which no session's time zone touches.
OUTCOMES = "job long, event_id long, ts long, worker string, outcome string, token int, lease_until long"
STATE = "worker string, token int, until long, recoveries int, quarantined boolean"
#: Recoveries of a job at most, and how long a lease lasts.
RECOVERIES, LEASE = 3, timedelta(seconds=120)
#: The state store that keeps values and timers of such processors.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(state: tuple | None, worker: str, now: int, lease: int, recoveries: int) -> tuple[str, tuple]:
    """The outcome of a word at a time (microseconds), and the state after it: (worker, token, until, recoveries, quarantined)."""
    if state is None:
        return "claimed", (worker, 1, now + lease, 0, False)
    holder, token, until, taken, quarantined = state
    if quarantined:
        return "refused", state
    if now <= until:
        return ("renewed", (holder, token, now + lease, taken, False)) if worker == holder else ("fenced", state)
    if taken >= recoveries:
        return "quarantined", (holder, token, until, taken, True)
    return "recovered", (worker, token + 1, now + lease, taken + 1, False)


class _Leases(StatefulProcessor):
    def __init__(self, lease: timedelta, recoveries: int):
        self.lease, self.recoveries = lease // timedelta(microseconds=1), recoveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["event_id", "ts", "worker", "outcome", "token", "lease_until"])
        out["event_id"] = out["event_id"].astype("Int64")
        out.insert(0, "job", key[0])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "event_id"])
        state = self.state.get() if self.state.exists() else None
        state = None if state is None else tuple(state)
        out = []
        for event_id, ts, worker in zip(own["event_id"], own["at"], own["worker"]):
            outcome, state = decide(state, worker, int(ts), self.lease, self.recoveries)
            out.append((event_id, ts, worker, outcome, state[1], state[2]))
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not state[4]:
            self.handle.registerTimer(state[2] // 1000 + 1)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        worker, token, until, _, _ = self.state.get()
        yield self._rows(key, [(None, until, worker, "expired", token, until)])

    def close(self) -> None:
        pass


def lease_outcomes(words: DataFrame, lease: timedelta = LEASE, recoveries: int = RECOVERIES, late: str = "1 day") -> DataFrame:
    """OUTCOMES of a stream of words (job, event_id, ts, worker): one row a word, and one (outcome expired, no event_id) for a lease that the watermark has passed. Words of a job are taken in the
    order of ts inside a batch; a word that comes in a later batch than younger ones is judged by what is known then."""
    words.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = words.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy("job").transformWithStateInPandas(_Leases(lease, recoveries), OUTCOMES, "append", "EventTime")
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("ts", "lease_until")})
