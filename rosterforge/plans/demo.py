"""Both days, a deletion between them, the chain and the scan in one run, with the figures of the report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import audit
from ..sources import feeds
from . import pipeline

DAY1, DELETED, DAY2 = "2024-01-01", "2024-01-10", "2024-02-01"


def records_per_second(records: int, seconds: float) -> float:
    return records / seconds if seconds > 0 else 0.0


def feed_rows(day: pipeline.Day, raw: dict[str, int]) -> dict[str, tuple[int, int, int, str]]:
    """Per feed: raw, deduplicated and quarantined records, drift."""
    return {k: (raw[k], g.passed.count() + g.quarantined.count(), g.quarantined.count(), g.drift) for k, g in day.gates.items()}


def tiers(day: pipeline.Day) -> dict[str, int]:
    return {r.tier: r["count"] for r in day.decisions.groupBy("tier").count().collect()}


def write_chain(events: DataFrame, path: str) -> int:
    """The day's events at the end of a file's chain; as many as feeds, requests and suppressed records."""
    rows = [r.asDict() for r in events.orderBy("timestamp", "event_class", "target_token").toLocalIterator()]
    feeds.append_chain(path, [r | {"timestamp": r["timestamp"].isoformat()} for r in rows])
    return len(rows)


def run(spark: SparkSession, chain: str, count: int = 300, seed: int = 42, target: str = "A00040") -> dict:
    """The figures of a whole run over generated feeds. chain: the file that the audit chain is written to."""
    started = time.perf_counter()
    a, b = fixtures.mappings()
    make = lambda day: {"A": (fixtures.feed_a(spark, day, count, seed), a), "B": (fixtures.feed_b(spark, day, count, seed), b)}
    raw = lambda fs: {k: r.count() for k, (r, _) in fs.items()}
    store, first, second = pipeline.Store(spark, b"demo-key", "demo-salt"), make(1), make(2)
    one = pipeline.run_day(store, first, DAY1)
    store.add("audit", pipeline.resolution_event(one.decisions, one.suppressed, DAY1, "day1"))
    gone = pipeline.delete_member(store, one.publishable, "request-1", "PARTNER_A", target, DELETED)
    columns = {k: [c for c in r.columns if c != "_line"] for k, (r, _) in first.items()}
    two = pipeline.run_day(store, second, DAY2, one.gates, columns, label="day2")
    store.add("audit", pipeline.resolution_event(two.decisions, two.suppressed, DAY2, "day2"))
    n_events = write_chain(store.tables["audit"], chain)
    verdict = audit.validate_log(spark, chain)
    findings = feeds.scan_files(spark, chain).count()
    out = {
        "day1": feed_rows(one, raw(first)), "day2": feed_rows(two, raw(second)), "tiers1": tiers(one), "tiers2": tiers(two), "suppressed": two.suppressed.count(),
        "states": {r.state: r["count"] for r in store.tables["members"].groupBy("state").count().collect()}, "ledger": store.tables["ledger"].count(), "decisions": store.tables["decisions"].count(),
        "enrollments": store.tables["enrollments"].count(), "reviews": store.tables["review_queue"].count(), "history": store.tables["history"].count(), "events": n_events, "chain_valid": verdict["valid"], "findings": findings, "deleted": gone,
    }
    out["passed"] = criteria(one, out)
    out["seconds"] = time.perf_counter() - started
    out["records_per_second"] = records_per_second(out["decisions"], out["seconds"])
    return out


def criteria(one: pipeline.Day, out: dict) -> int:
    """How many of the six criteria hold."""
    merged = sum(t.get("TIER_2_PROBABILISTIC_HIGH", 0) for t in (out["tiers1"], out["tiers2"]))
    return sum([not any(g.feed_quarantined for g in one.gates.values()), out["history"] >= 1, merged >= 1, out["chain_valid"], out["findings"] == 0, out["suppressed"] >= 1])
