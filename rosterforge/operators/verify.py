"""Batch verification: latest member by anchor, a collapsed answer, lockout after failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_HOURS, FAILURES = 24, 3


def latest(rows: DataFrame, anchor: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*anchor).orderBy(*[c.desc() for c in order]))).filter("_k = 1").drop("_k")


def collapse(state: Column) -> Column:
    """Two answers for the outside; an unknown member gets the same as an ineligible one."""
    return F.when(F.coalesce(state, F.lit("")) == "ELIGIBLE_ACTIVE", "VERIFIED").otherwise("NOT_VERIFIED")


def verify_claims(claims: DataFrame, members: DataFrame, anchor: list[str], order: list[Column]) -> DataFrame:
    """claims with `status`; members need `state`."""
    m = latest(members, anchor, order).select(*anchor, F.col("state").alias("_state"))
    return claims.join(m, anchor, "left").withColumn("status", collapse(F.col("_state"))).drop("_state")


def verify_rotating(claims: DataFrame, key: str, versions: list[list[str]], members: DataFrame, anchor: list[str], order: list[str]) -> DataFrame:
    """claims with `status` while keys are being rotated: members' anchor tokens are of one version, a claim has all of them.

    versions: for each key version the claims' columns that stand for the anchor. One equi-join serves all versions; of
    several members the latest counts.
    """
    each = F.explode(F.array(*[F.struct(*[F.col(c).alias(a) for c, a in zip(v, anchor, strict=True)]) for v in versions]))
    asked = claims.select(key, each.alias("_a")).select(key, *[F.col(f"_a.{a}").alias(a) for a in anchor]).distinct()
    found = members.select(*anchor, F.col("state").alias("_state"), F.struct(*order).alias("_o"))
    hit = asked.join(found, anchor).groupBy(key).agg(F.max_by("_state", "_o").alias("_state"))
    return claims.join(hit, key, "left").withColumn("status", collapse(F.col("_state"))).drop("_state")


def padded(answer: Column, length: int = 64) -> Column:
    """Answers of one length, so that size tells nothing."""
    return F.rpad(answer, length, " ")


def lockout(attempts: DataFrame, anchor: str, ts: str, tie: str, failed: Column, succeeded: Column, hours: int = WINDOW_HOURS, failures: int = FAILURES) -> DataFrame:
    """attempts with `failures` and `locked`.

    Failures since the last success in the trailing window, both ends included. The attempt that reaches the limit
    locks; all later ones find the lock, which never ends. Locked attempts don't count, but nothing after the first lock
    can change it, so counting all rows is right up to there.
    """
    order = W.partitionBy(anchor).orderBy(ts, tie)
    x = attempts.withColumn("_segment", F.coalesce(F.sum(succeeded.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    inside = W.partitionBy(anchor, "_segment").orderBy("_us").rangeBetween(-hours * 3_600_000_000, 0)
    same = W.partitionBy(anchor, "_segment", "_us").orderBy(F.col(tie).desc())
    # Rows of one moment after this one are in the range but not before it.
    after = F.coalesce(F.sum(failed.cast("int")).over(same.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("failures", F.sum(failed.cast("int")).over(inside) - after)
    x = x.withColumn("_trip", (failed & (F.col("failures") >= failures)).cast("int"))
    x = x.withColumn("locked", F.coalesce(F.max("_trip").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1)
    return x.withColumn("friction", ~F.col("locked") & (F.col("failures") == failures - 1)).drop("_segment", "_us", "_trip")


def locks(attempts: DataFrame, anchor: str, ts: str, tie: str, failed: Column, succeeded: Column, **kw) -> DataFrame:
    """(anchor, locked_at, id of the attempt) of each anchor that is locked."""
    x = lockout(attempts, anchor, ts, tie, failed, succeeded, **kw)
    trip = x.filter(failed & (F.col("failures") >= kw.get("failures", FAILURES)))
    return trip.groupBy(anchor).agg(F.min(F.struct(ts, tie)).alias("m")).select(anchor, F.col(f"m.{ts}").alias("locked_at"), F.col(f"m.{tie}").alias("lock_id"))


def latency_percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The values at place n * p / 100 (from 0) of each sorted group: by counts of values, not by a list."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by)
    x = n.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    return x.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{p}") for p in points])
