"""Lockout by event time: attempts wait in state until the watermark has passed them, and are then taken in the order of their times.

So an attempt that comes late, within the stream's delay, counts where it belongs, and the batches in which attempts came make no
difference. Each anchor's state is a list of waiting attempts, the failures of the window (fewer than the limit, as a lock ends
counting), and the lock; a timer at each waiting attempt's time empties the list. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.verify import FAILURES, WINDOW_HOURS
from .lockout import OUTPUT, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lockout(StatefulProcessor):
    def __init__(self, hours: int, limit: int):
        self.hours, self.limit = hours, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, attempt_id bigint, failed boolean, succeeded boolean")
        self.held = handle.getListState("held", "us bigint")
        self.lock = handle.getValueState("lock", "locked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples():
                us = int(pd.Timestamp(r.ts).value // 1000)
                self.waiting.appendValue((us, int(r.attempt_id), bool(r.failed), bool(r.succeeded)))
                self.handle.registerTimer(us // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        all_ = [tuple(x) for x in self.waiting.get()]
        due = sorted(x for x in all_ if x[0] < upto)
        if not due:  # an earlier timer of the batch has taken them
            return
        rest = [x for x in all_ if x[0] >= upto]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        stamps = [x[0] for x in self.held.get()]
        locked = bool(self.lock.get()[0]) if self.lock.exists() else False
        out = []
        for us, attempt, failed, succeeded in due:
            stamps, now, found = step(stamps, locked, us, failed, succeeded, self.hours, self.limit)
            out.append((key[0], pd.Timestamp(us * 1000), attempt, len(stamps), found))
            locked = now
        if stamps:
            self.held.put([(x,) for x in stamps])
        else:
            self.held.clear()
        self.lock.update((locked,))
        yield pd.DataFrame(out, columns=["anchor", "ts", "attempt_id", "failures", "locked"])

    def close(self) -> None:
        pass


def timed_lockout(attempts: DataFrame, delay: str, hours: int = WINDOW_HOURS, limit: int = FAILURES) -> DataFrame:
    """attempts (anchor, ts, attempt_id, failed, succeeded) as a stream: a row per attempt once the watermark, `delay` behind, has passed it.

    Attempts later than that are dropped, as the watermark says. Attempts of one time go by their id.
    """
    return attempts.withWatermark("ts", delay).groupBy("anchor").transformWithStateInPandas(Lockout(hours, limit), OUTPUT, "Append", "EventTime")
