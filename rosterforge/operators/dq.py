"""Data quality gates: required fields, feed thresholds, schema drift, profiles and profile drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import PartnerMapping

REJECT_ABOVE, DRIFT_ABOVE = 0.05, 0.20


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def quarantine_reason(fields: list[str], errors: Column | None = None) -> Column:
    """The first failing field's reason, in the order given; a field's parse error comes before its absence."""
    out = []
    for f in fields:
        if errors is not None:
            out.append(F.when(errors[f].isNotNull(), F.concat(F.lit(f"REQUIRED_FIELD_INVALID:{f}:"), errors[f])))
        out.append(F.when(blank(F.col(f)), F.lit(f"REQUIRED_FIELD_MISSING:{f}")))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def tier_flags(rows: DataFrame, m: PartnerMapping) -> DataFrame:
    """Whether all verification fields are there, and which enrichment fields are missing; neither blocks a record."""
    of = lambda t: [f for f, x in m.field_tiers.items() if x == t and f in rows.columns]
    whole = F.lit(True)
    for f in of("verification"):
        whole = whole & ~blank(F.col(f))
    missing = F.filter(F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in of("enrichment")] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    return rows.withColumns({"verification_complete": whole, "enrichment_missing": missing})


def rejection_rates(rows: DataFrame, feed: list[str], threshold: float = REJECT_ABOVE) -> DataFrame:
    """Per feed: total, rejected, rate, and whether the feed is quarantined (strictly above the threshold). Needs `reason`."""
    x = rows.groupBy(*feed).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    rate = F.when(F.col("total") > 0, F.col("rejected") / F.col("total")).otherwise(F.lit(0.0))
    return x.withColumn("rejection_rate", rate).withColumn("feed_quarantined", F.col("rejection_rate") > threshold)


def schema_drift(before: list[str] | None, now: list[str]) -> tuple[str, list[str], list[str]]:
    """(NONE, ADDITIVE or SUBTRACTIVE_QUARANTINE, added, removed)."""
    if before is None:
        return "NONE", [], []
    added, removed = sorted(set(now) - set(before)), sorted(set(before) - set(now))
    return ("SUBTRACTIVE_QUARANTINE" if removed else "ADDITIVE" if added else "NONE"), added, removed


def field_profile(rows: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Per field: count, null_count (nulls and blanks), null_rate, exact distinct_count of the others; one pass."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        aggs += [F.count_if(blank(F.col(f))).alias(f"_b_{f}"), F.count_distinct(F.when(~blank(F.col(f)), F.col(f).cast("string"))).alias(f"_d_{f}")]
    x = rows.groupBy(*by).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("_n").alias("count"), F.col(f"_b_{f}").alias("null_count"), F.col(f"_d_{f}").alias("distinct_count")) for f in fields]))
    x = x.select(*by, each.alias("p")).select(*by, "p.*")
    return x.withColumn("null_rate", F.when(F.col("count") > 0, F.col("null_count") / F.col("count")).otherwise(F.lit(0.0)))


def profiled_fields(m: PartnerMapping) -> list[str]:
    """Fields with a tier and those that mapping makes, the last four digits of a number among them."""
    return sorted({*m.field_tiers, *m.mapping, *(["ssn_last4"] if "ssn" in m.mapping else [])})


def cardinality_drift(now: DataFrame, base: DataFrame, threshold: float = DRIFT_ABOVE) -> DataFrame:
    """Fields of both profiles whose number of distinct values moved by more than the threshold, as a part of the baseline's."""
    b = base.select("field", F.col("distinct_count").alias("base_distinct"))
    x = now.select("field", "distinct_count").join(b, "field")
    x = x.withColumn("change", (F.col("distinct_count") - F.col("base_distinct")) / F.greatest(F.col("base_distinct"), F.lit(1)))
    return x.filter(F.abs("change") > threshold)


def value_profile(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def profile_drift(now: DataFrame, base: DataFrame, threshold: float = DRIFT_ABOVE) -> DataFrame:
    """Fields of both whose null rate moved by more than the threshold."""
    b = base.select("field", F.col("null_rate").alias("base_null_rate"))
    x = now.select("field", "null_rate").join(b, "field").withColumn("delta", F.col("null_rate") - F.col("base_null_rate"))
    return x.filter(F.abs("delta") > threshold)


@dataclass(frozen=True)
class DQResult:
    """passed and quarantined rows, the verdict and the profile of one feed."""

    passed: DataFrame
    quarantined: DataFrame
    feed_quarantined: bool
    drift: str
    added: list[str]
    removed: list[str]
    profile: DataFrame
    drifted_fields: DataFrame | None
    reason: str | None = None


def run_dq(rows: DataFrame, m: PartnerMapping, columns: list[str], prior_columns: list[str] | None = None, baseline: DataFrame | None = None, threshold: float = REJECT_ABOVE, drift_above: float = DRIFT_ABOVE) -> DQResult:
    """Gate a mapped and deduplicated feed. Subtractive drift passes and quarantines nothing, and no job runs.

    The profile is of all fields that have a tier or that mapping makes; a field that no row has is blank in all.
    """
    drift, added, removed = schema_drift(prior_columns, columns)
    fields = profiled_fields(m)
    for f in fields:
        if f not in rows.columns:
            rows = rows.withColumn(f, F.lit(None).cast("string"))
    marked = rows.withColumn("reason", quarantine_reason(m.required, F.col("parse_errors")))
    profile = field_profile(rows, fields, ["partner_id"])
    if drift == "SUBTRACTIVE_QUARANTINE":
        none = marked.limit(0)
        return DQResult(none.drop("reason"), none, True, drift, added, removed, profile, None, f"SCHEMA_DRIFT_SUBTRACTIVE: removed columns {removed}")
    r = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("bad")).first()
    rate = r.bad / r.n if r.n else 0.0
    over = rate > threshold
    why = f"REJECTION_RATE_EXCEEDED: {rate:.4f} > {threshold:.4f}" if over else None
    passed = marked.filter("reason IS NULL").drop("reason")
    moved = profile_drift(profile, baseline, drift_above) if baseline is not None else None
    return DQResult(passed.limit(0) if over else passed, marked.filter("reason IS NOT NULL"), over, drift, added, removed, profile, moved, why)


# profiles that merge


def sketch_profile(rows: DataFrame, fields: list[str], by: list[str], lg_k: int = 12) -> DataFrame:
    """(by, field, count, null_count, sketch): a profile that merges with others of the same field. One pass; a row isn't repeated for its fields.

    sketch: of the distinct values that aren't blank (HyperLogLog, a relative error of about 1.04 / sqrt(2**lg_k)).
    """
    text = lambda f: F.col(f"`{f}`").cast("string")
    blank = lambda f: F.coalesce(text(f), F.lit("")) == ""
    aggs = [x for i, f in enumerate(fields) for x in (F.count_if(blank(f)).alias(f"_n{i}"), F.hll_sketch_agg(F.when(~blank(f), text(f)), F.lit(lg_k)).alias(f"_s{i}"))]
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("null_count"), F.col(f"_s{i}").alias("sketch")) for i, f in enumerate(fields)]))
    return own.select(*by, "count", each.alias("x")).select(*by, "x.field", "count", "x.null_count", "x.sketch")


def merge_profiles(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Profiles of days, feeds or partners as one for each of `by` and field, with the estimated distinct count."""
    x = profiles.groupBy(*by, "field").agg(F.sum("count").alias("count"), F.sum("null_count").alias("null_count"), F.hll_union_agg("sketch").alias("sketch"))
    return x.withColumns({"null_rate": F.col("null_count") / F.col("count"), "distinct_count": F.hll_sketch_estimate("sketch")})


def value_counts(rows: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """(by, field, value, n): histograms of fields of few values; nulls and blanks are a value."""
    out = None
    for f in fields:
        x = rows.groupBy(*by, F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        x = x.select(*by, F.lit(f).alias("field"), "value", "n")
        out = x if out is None else out.unionByName(x)
    return out


def distribution_drift(baseline: DataFrame, now: DataFrame, key: list[str], least: float = 1e-4) -> DataFrame:
    """(key, psi, js): how far the histograms of now are from those of baseline (key, value, n).

    psi: sum of (q - p) * ln(q / p), shares below `least` taken as that, so that a new value counts; js: the Jensen-Shannon divergence in
    bits, from 0 to 1. A field that only one side has is not compared.
    """
    share = lambda x, name: x.join(x.groupBy(*key).agg(F.sum("n").alias("_t")), key).select(*key, "value", (F.col("n") / F.col("_t")).alias(name))
    both = baseline.select(*key).distinct().join(now.select(*key).distinct(), key)
    x = share(baseline, "p").join(share(now, "q"), [*key, "value"], "full").join(both, key).fillna(0.0, ["p", "q"])
    p, q = F.greatest("p", F.lit(least)), F.greatest("q", F.lit(least))
    mid = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    return x.groupBy(*key).agg(F.sum((q - p) * F.log(q / p)).alias("psi"), (F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("js"))
