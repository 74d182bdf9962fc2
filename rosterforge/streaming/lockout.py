"""Lockout as a stream, replay caches, idempotent consumption, fan-out of audit events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verify import FAILURES, WINDOW_HOURS

OUTPUT = "anchor long, ts timestamp, attempt_id long, failures int, locked boolean"
STATE = "stamps array<long>, locked boolean"


def step(stamps: list[int], locked: bool, us: int, failed: bool, succeeded: bool, hours: int, limit: int) -> tuple[list[int], bool, bool]:
    """One attempt: failures held, the lock after it, and whether it found the lock. Success clears failures, not the lock."""
    if locked:
        return stamps, True, True
    if succeeded:
        return [], False, False
    stamps = [t for t in stamps if t >= us - hours * 3_600_000_000]
    if failed:
        stamps = [*stamps, us]
    return stamps, failed and len(stamps) >= limit, False


def lockout_stream(attempts: DataFrame, hours: int = WINDOW_HOURS, limit: int = FAILURES) -> DataFrame:
    """attempts (anchor, ts, attempt_id, failed, succeeded) as a stream: one row per attempt, in order within a batch.

    State per anchor is at most `limit` stamps and the lock. It has no time-out, as locks never end.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stamps, locked = ([], False) if not state.exists else (list(state.get[0]), bool(state.get[1]))
        rows = pd.concat(list(batches)).sort_values(["ts", "attempt_id"])
        out = []
        for r in rows.itertuples():
            stamps, locked_now, found = step(stamps, locked, int(pd.Timestamp(r.ts).value // 1000), r.failed, r.succeeded, hours, limit)
            out.append((key[0], r.ts, r.attempt_id, len(stamps), found))
            locked = locked_now
        state.update((stamps[-limit:], locked))
        yield pd.DataFrame(out, columns=["anchor", "ts", "attempt_id", "failures", "locked"])

    return attempts.groupBy("anchor").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")


def once_within(events: DataFrame, key: str, ts: str, hold: str = "24 hours") -> DataFrame:
    """A replay cache: ids seen within the time held pass once."""
    return events.withWatermark(ts, hold).dropDuplicatesWithinWatermark([key])


def fan_out(write: dict[str, Callable[[DataFrame, int], None]], tier_of: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each tier its classes of events; the batch is kept while the tiers read it."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        for tier, sink in write.items():
            sink(batch.filter(F.col("event_class").isin(*[c for c, t in tier_of.items() if t == tier])), epoch)
        batch.unpersist()

    return each


def ordered_by_key(events: DataFrame, key: str, ts: str, partitions: int) -> DataFrame:
    """All events of a key in one partition, in order."""
    return events.repartition(partitions, key).sortWithinPartitions(key, ts)
