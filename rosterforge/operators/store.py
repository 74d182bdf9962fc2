"""The member store: inserts, constraints, states, histories, snapshots, versions."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import uuid5

STATES = ("PENDING_RESOLUTION", "ELIGIBLE_ACTIVE", "ELIGIBLE_GRACE", "INELIGIBLE", "DELETED")
#: Fixed pairs of states that may follow each other; None: a member's first state.
TRANSITIONS = (
    (None, "PENDING_RESOLUTION"),
    (None, "ELIGIBLE_ACTIVE"),
    ("PENDING_RESOLUTION", "ELIGIBLE_ACTIVE"),
    ("PENDING_RESOLUTION", "DELETED"),
    ("ELIGIBLE_ACTIVE", "ELIGIBLE_GRACE"),
    ("ELIGIBLE_ACTIVE", "DELETED"),
    ("ELIGIBLE_GRACE", "ELIGIBLE_ACTIVE"),
    ("ELIGIBLE_GRACE", "INELIGIBLE"),
    ("ELIGIBLE_GRACE", "DELETED"),
    ("INELIGIBLE", "ELIGIBLE_ACTIVE"),
    ("INELIGIBLE", "DELETED"),
)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target and those rows whose key it lacks, one per key."""
    return target.unionByName(new_rows(target, rows, key), allowMissingColumns=True)


def new_rows(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    own = W.partitionBy(*key).orderBy(*[F.col(c) for c in rows.columns if dict(rows.dtypes)[c][:3] not in ("map",)])
    first = rows.withColumn("_k", F.row_number().over(own)).filter("_k = 1").drop("_k")
    return first.join(target.select(*key), key, "left_anti")


def violations(table: DataFrame, key: list[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n) of a key that isn't unique and of checks that don't hold: one pass for all checks."""
    out = table.groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique").alias("rule"), "n")
    if checks:
        names = list(checks)
        counts = table.agg(*[F.count_if(~checks[name]).alias(f"_{i}") for i, name in enumerate(names)])
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("n")) for i, name in enumerate(names)]))
        out = out.unionByName(counts.select(each.alias("x")).select("x.rule", "x.n"))
    return out.filter("n > 0")


def transition_table(spark: SparkSession, pairs=TRANSITIONS) -> DataFrame:
    return spark.createDataFrame(pairs, "from_state string, to_state string")


def mark_transitions(changes: DataFrame, allowed: DataFrame) -> DataFrame:
    """changes (from_state, to_state, ...) with `allowed`; `allowed` holds the pairs of states that may follow each other."""
    a = allowed.select(F.col("from_state").alias("_f"), F.col("to_state").alias("_t"), F.lit(True).alias("allowed")).distinct()
    x = changes.join(a, F.col("from_state").eqNullSafe(F.col("_f")) & (F.col("to_state") == F.col("_t")), "left").drop("_f", "_t")
    return x.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def assert_transitions(changes: DataFrame, allowed: DataFrame) -> None:
    bad = mark_transitions(changes, allowed).filter("NOT allowed").limit(1).collect()
    if bad:
        raise ValueError(f"a state {bad[0].from_state} can't become {bad[0].to_state}")


def scd2(changes: DataFrame, key: list[str], state: str, order: list[str], since: str) -> DataFrame:
    """Periods from ordered states: equal neighbours merged, each closed by the next one's start."""
    w = W.partitionBy(*key).orderBy(*order)
    x = changes.withColumn("_before", F.lag(state).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    x = x.filter(F.col("_first") | ~F.col(state).eqNullSafe(F.col("_before")))
    return x.select(*key, state, F.col(since).alias("effective_from"), F.lead(since).over(w).alias("effective_to"))


def as_of(history: DataFrame, moments: DataFrame, moment: str = "moment", days: int = 32) -> DataFrame:
    """The periods that hold at each moment: from <= moment < to. An equi-join on spans of `days` days, whatever the number of moments.

    A period is repeated for each span that it touches and that holds a moment: the list of these spans, a number for each
    `days` days of the calendar at most, is one row.
    """
    span = lambda c: F.floor(F.unix_date(c.cast("date")) / days)
    m = moments.withColumn("_span", span(F.col(moment)))
    spans = m.agg(F.array_sort(F.collect_set("_span")).alias("_spans"))
    first, last = span(F.col("effective_from")), span(F.col("effective_to"))
    h = history.crossJoin(spans)  # one row
    h = h.withColumn("_span", F.explode(F.filter("_spans", lambda s: (s >= first) & (last.isNull() | (s <= last))))).drop("_spans")
    x = h.join(m, "_span").drop("_span")
    return x.filter((F.col("effective_from") <= F.col(moment)) & (F.col("effective_to").isNull() | (F.col(moment) < F.col("effective_to"))))


def row_hash(columns: list[str]) -> Column:
    """A hash of values and of which are null."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def snapshot_diff(before: DataFrame, now: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and change ADDED, CHANGED or REMOVED; equal rows are unchanged. Null keys are a key; one shuffle for both sides."""
    side = lambda df, old: df.select(*key, F.lit(old).alias("_old"), row_hash(columns).cast("decimal(38,0)").alias("_h"))
    n, h = (lambda old: F.count_if(F.col("_old") == old)), (lambda old: F.sum(F.when(F.col("_old") == old, F.col("_h"))))
    x = side(before, True).unionByName(side(now, False)).groupBy(*key).agg(n(True).alias("_nb"), n(False).alias("_nn"), h(True).alias("_b"), h(False).alias("_n"))
    change = F.when(F.col("_nb") == 0, "ADDED").when(F.col("_nn") == 0, "REMOVED").when((F.col("_b") != F.col("_n")) | (F.col("_nb") != F.col("_nn")), "CHANGED")
    return x.withColumn("change", change).filter("change IS NOT NULL").select(*key, "change")


def stale_feeds(arrivals: DataFrame, by: list[str], day: str, cadence_days: int) -> DataFrame:
    """Arrivals whose gap to the one before is over the cadence."""
    w = W.partitionBy(*by).orderBy(day)
    return arrivals.withColumn("gap_days", F.datediff(F.col(day), F.lag(day).over(w))).filter(F.col("gap_days") > cadence_days)


def late_files(files: DataFrame, by: list[str], effective: str, arrival: str) -> DataFrame:
    """files with `late`: one of a later effective day has arrived before. The rebuild then orders by effective day, not arrival.

    Files that arrive together are taken by effective day, so only those of other arrivals count: the running maximum
    goes over one row of each arrival, not over files. A null arrival is the first.
    """
    w = W.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_arrival").rowsBetween(W.unboundedPreceding, -1)
    keys = [(f"_by{i}", k) for i, k in enumerate(by)] + [("_arrival", arrival)]
    days = files.groupBy(*[F.col(k).alias(name) for name, k in keys]).agg(F.max(effective).alias("_latest"))
    days = days.withColumn("_before", F.max("_latest").over(w)).drop("_latest")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(name)) for name, k in keys])
    return files.join(days, same, "left").withColumn("late", F.coalesce(F.col(effective) < F.col("_before"), F.lit(False))).drop("_before", *[name for name, _ in keys])


def rebuild(changes: DataFrame, key: list[str], state: str, effective: str, arrival: str, tie: str) -> DataFrame:
    """The history as it is once all files are in: changes by effective day, whenever they came; of one day the last to arrive counts."""
    w = W.partitionBy(*key, effective).orderBy(F.desc(arrival), F.desc(tie))
    x = changes.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return scd2(x, key, state, [effective], effective)


def enrollments_per_member(members: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Members that aren't deleted, each with its open enrollments (partner_id, partner_member_id), sorted."""
    e = enrollments.filter("effective_to IS NULL").groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("partner_id", "partner_member_id"))).alias("enrollments"))
    return members.filter("state <> 'DELETED'").join(e, "member_id")


def deletion_target(members: DataFrame, enrollments: DataFrame, partner_id: str, partner_member_id: str) -> DataFrame:
    """The member behind an open enrollment."""
    e = enrollments.filter((F.col("partner_id") == partner_id) & (F.col("partner_member_id") == partner_member_id) & F.col("effective_to").isNull())
    return members.filter("state <> 'DELETED'").join(e.select("member_id").distinct(), "member_id", "left_semi")


def history_rows(members: DataFrame, touched: DataFrame, trigger: str, as_of: str) -> DataFrame:
    """An opening row for each member that a batch has touched, with its state and tokens as they are now."""
    event = uuid5(F.concat_ws("|", F.lit(trigger), F.lit(as_of), F.col("member_id")))
    own = members.join(touched.select("member_id").distinct(), "member_id", "left_semi")
    return own.select("member_id", "state", F.lit(as_of).cast("timestamp").alias("state_effective_from"), "name_token", "dob_token", F.lit(trigger).alias("change_trigger"), event.alias("change_event_id"))


def ledger_listing(ledger: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The ledger, the last entry first."""
    x = ledger.orderBy(*[F.desc(c) for c in order])
    return x if n is None else x.limit(n)


def first_match(rows: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row, in order, that meets the condition; no row if none does."""
    return rows.filter(condition).orderBy(*order).limit(1)


def survivorship(updates: DataFrame, key: list[str], order: list[str], mutable: list[str], locked: list[str]) -> DataFrame:
    """The last stated value of mutable attributes, the first of locked ones, and whether a locked one ever differed."""
    at = F.struct(*order)
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in mutable] + [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in locked]
    conflict = F.lit(False)
    for c in locked:
        conflict = conflict | (F.coalesce(F.min(F.col(c)) != F.max(F.col(c)), F.lit(False)))
    return updates.groupBy(*key).agg(*aggs, conflict.alias("conflict"))


def identity_conflicts(updates: DataFrame, key: list[str], order: list[str], locked: list[str]) -> DataFrame:
    """Review rows (queue_id, key, conflict_class, attribute, kept, proposed, times) for values that differ from the first stated one.

    A row for each key, attribute and other value, however often it was stated. The first value of each key comes from partial
    minima; updates meet it by a join on the key, so nothing of a key is gathered.
    """
    at = F.struct(*order)
    first = updates.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).cast("string").alias(f"_{c}") for c in locked])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"_{c}").alias("kept"), F.col(c).cast("string").alias("proposed")) for c in locked]))
    x = updates.join(first, key).select(*key, each.alias("x")).select(*key, "x.*").filter("proposed <> kept")
    x = x.groupBy(*key, "attribute", "kept", "proposed").agg(F.count(F.lit(1)).alias("times"))
    name = F.concat_ws("|", F.lit("conflict"), *[F.col(k).cast("string") for k in key], "attribute", "proposed")
    return x.select(uuid5(name).alias("queue_id"), *key, F.lit("IDENTITY_CONFLICT").alias("conflict_class"), "attribute", "kept", "proposed", "times")


def without_conflicts(edges: DataFrame, conflicts: DataFrame, uid: str) -> DataFrame:
    """edges (uid_l, uid_r) of which no end has an open conflict: merges of the others wait for their review."""
    held = conflicts.select(F.col(uid).alias("_u")).distinct()
    x = edges.join(held, F.col("uid_l") == F.col("_u"), "left_anti")
    return x.join(held, F.col("uid_r") == F.col("_u"), "left_anti")


def grace(last_seen: DataFrame, seen: str, today: Column, grace_days: int) -> DataFrame:
    """status ELIGIBLE_ACTIVE on the last day seen, ELIGIBLE_GRACE up to grace_days after, then INELIGIBLE."""
    d = F.datediff(today, F.col(seen))
    return last_seen.withColumn("status", F.when(d <= 0, "ELIGIBLE_ACTIVE").when(d <= grace_days, "ELIGIBLE_GRACE").otherwise("INELIGIBLE"))


def reenrollment_gaps(periods: DataFrame, key: list[str], day: str, longer_than: int) -> DataFrame:
    w = W.partitionBy(*key).orderBy(day)
    return periods.withColumn("gap_days", F.datediff(F.col(day), F.lag(day).over(w))).filter(F.col("gap_days") > longer_than)


def reconcile(counts: DataFrame, reported: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """counts (key, n) against reported (key, reported): variance and status OK, VARIANCE or MISSING, which is an alert too."""
    x = counts.join(reported, key, "left")
    v = F.when(F.col("reported") > 0, (F.col("n") - F.col("reported")) / F.col("reported"))
    return x.withColumn("variance", v).withColumn("status", F.when(F.col("variance").isNull(), "MISSING").when(F.abs("variance") > tolerance, "VARIANCE").otherwise("OK"))


def table_checksum(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row count and an order-free sum of row hashes, for comparing two copies: repeated rows and nulls count."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash(df.columns).cast("decimal(38,0)")).alias("checksum"))


class VersionedTable:
    """Versions of a table in one folder and a log of pointers, the last of which holds; older versions stay for replay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, df: DataFrame, version: int) -> None:
        """Write a version beside the others, then point to it."""
        df.write.mode("errorifexists").parquet(f"{self.path}/v{version}")
        self.point(version)

    def point(self, version: int) -> None:
        """Add a pointer; readers see the one before until its file is there, and there is never none."""
        row = [(time.time_ns(), version)]
        self.spark.createDataFrame(row, "moment long, version int").coalesce(1).write.mode("append").json(f"{self.path}/current")

    def replay(self, build: Callable[[], DataFrame], accept: Callable[[DataFrame, DataFrame], bool]) -> int:
        """Fill a parallel version from a replay, and point to it if accept(its rows, the current rows) says so; the version that holds.

        Readers keep the current version meanwhile. A replay that isn't accepted stays beside the others, for a look at it.
        """
        now = self.current()
        version = max(int(name[1:]) for name in self.names() if name[0] == "v") + 1
        build().write.mode("errorifexists").parquet(f"{self.path}/v{version}")
        if not accept(self.read(version), self.read(now)):
            return now
        self.point(version)
        return version

    def names(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return [s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)]

    def current(self) -> int:
        return self.spark.read.schema("moment long, version int").json(f"{self.path}/current").agg(F.max_by("version", "moment")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.current() if version is None else version}")
