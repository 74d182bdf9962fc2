"""The audit trail: hash chains, scanning, catalogues, retention."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import redact
from ..scratch import Scratch

GENESIS = "0" * 64
#: Years that each class of events is kept.
RETENTION_YEARS = {"VERIFICATION": 2, "DELETION": 7, "IDENTITY": 7, "FEED": 3, "ACCESS": 6}


def canonical_json(entry: dict) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in entry.items() if k != "self_hash"}).encode()).hexdigest()


def append(head: str, entries: Iterable[dict]) -> list[dict]:
    """Entries linked to a head hash and to each other. A chain has one writer, which keeps the head in memory."""
    out = []
    for e in entries:
        e = e | {"prior_event_hash": head}
        head = entry_hash(e)
        out.append(e | {"self_hash": head})
    return out


@F.pandas_udf(T.StringType())
def hash_of_line(lines: pd.Series) -> pd.Series:
    """Each JSON line's own hash, made anew; null where it isn't a JSON object."""

    def one(x: str) -> str | None:
        try:
            return entry_hash(json.loads(x))
        except (ValueError, AttributeError):
            return None

    return lines.map(one)


def check_links(rows: DataFrame, chain: list[str], order: list[str], own: str, prior: str, made: Column, genesis: str | Column = GENESIS) -> DataFrame:
    """rows with `reason`: why a row breaks its chain, else null. Hashes are checked in parallel, links by a look at the row before."""
    w = W.partitionBy(*chain).orderBy(*order)
    before = F.coalesce(F.lag(own).over(w), genesis if isinstance(genesis, Column) else F.lit(genesis))
    return rows.withColumn("reason", F.when(~F.col(prior).eqNullSafe(before), "prior_event_hash mismatch").when(~made.eqNullSafe(F.col(own)), "self_hash mismatch"))


def chain_verdicts(checked: DataFrame, chain: list[str], line: str) -> DataFrame:
    """Per chain: entries_checked (up to the break), first_broken (null if valid). Lost last entries can't be seen; an empty chain is valid.

    line: the entry's number in its chain, from 1.
    """
    x = checked.groupBy(*chain).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("reason").isNotNull(), F.col(line))).alias("first_broken"))
    return x.select(*chain, F.coalesce("first_broken", "_n").alias("entries_checked"), "first_broken")


def numbered_lines(spark: SparkSession, path: str, by_file: bool = True, **options) -> DataFrame:
    """(path, block, line, value) of text files; line counts from 1, in each file or through all of them in order.

    A block is the part of a file that one task reads. Its first number comes from the counts of the blocks before it, so
    that neither a file nor its lines are sorted or gathered.
    """
    meta = F.col("_metadata")
    x = spark.read.options(**options).text(path).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("_id"))
    heads = x.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy("path").orderBy("block") if by_file else W.orderBy("path", "block")  # a row per block
    heads = heads.select("path", "block", (F.sum("_n").over(w) - F.col("_n") - F.col("_first")).alias("_shift"))
    return x.join(heads, ["path", "block"]).select("path", "block", (F.col("_id") + F.col("_shift") + 1).alias("line"), "value")


def validate_log(spark: SparkSession, path: str, head: str | None = None) -> dict:
    """A JSONL chain's verdict. Blank lines are skipped but counted, and counting ends at the break; with the head that an anchor has kept, lost entries show.

    Hashes are made anew where the lines lie; links are checked block by block, each with the last hash before it.
    """
    tmp = Scratch(spark, "chain")
    text = numbered_lines(spark, path, by_file=False)
    own = F.get_json_object("value", "$.self_hash")
    made = F.when(F.trim("value") != "", hash_of_line("value"))
    rows = tmp.write(text.select("path", "block", "line", (F.trim("value") == "").alias("blank"), own.alias("self_hash"), F.get_json_object("value", "$.prior_event_hash").alias("prior"), made.alias("made")), "rows")
    full = rows.filter("NOT blank")
    last = tmp.write(full.groupBy("path", "block").agg(F.max_by("self_hash", "line").alias("last")), "last")
    start = last.select("path", "block", F.coalesce(F.lag("last").over(W.orderBy("path", "block")), F.lit(GENESIS)).alias("start"))  # a row per block
    checked = check_links(full.join(start, ["path", "block"]), ["path", "block"], ["line"], "self_hash", "prior", F.col("made"), F.col("start"))
    checked = checked.withColumn("reason", F.when(F.col("made").isNull(), "json decode error").otherwise(F.col("reason")))
    bad = checked.filter("reason IS NOT NULL").agg(F.min_by(F.struct("line", "reason"), "line").alias("x")).first().x
    out = {"valid": bad is None, "entries_checked": rows.count(), "first_broken": None, "reason": None}
    if bad is not None:
        out |= {"entries_checked": bad.line, "first_broken": bad.line, "reason": bad.reason}
    elif head is not None:
        end = last.agg(F.max_by("last", F.struct("path", "block")).alias("x")).first().x
        if (end or GENESIS) != head:
            out |= {"valid": False, "reason": "head mismatch"}
    return out


def recent_links(rows: DataFrame, chain: list[str], order: list[str], own: str, prior: str, made: Column, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """check_links() of the last hours: the job that runs each hour. The first entry of the window is held against the one before it."""
    start = now - F.make_interval(hours=F.lit(hours))
    inside = (F.col(ts) >= start) & (F.col(ts) < now)
    last = rows.filter(F.col(ts) < start).groupBy(*chain).agg(F.max_by(own, F.struct(*order)).alias("_anchor"))
    x = rows.filter(inside).join(last, chain, "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(GENESIS)))
    return check_links(x, chain, order, own, prior, made, F.col("_anchor")).drop("_anchor")


def scan(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pattern, value) of each finding."""
    return rows.select(*key, F.explode(redact.findings(F.col(text))).alias("f")).select(*key, "f.pattern", "f.value")


def scan_sample(rows: DataFrame, key: list[str], text: str, share: float) -> DataFrame:
    """scan() of a seeded share of the rows: a sampling operator for routine checks."""
    return scan(rows.filter(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(share * 1_000_000)), key, text)


def findings_summary(found: DataFrame, key: list[str]) -> DataFrame:
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(*key).alias("rows_with_findings"))


def inspect(events: DataFrame, event_class: str | None, order: list[Column], last: int) -> DataFrame:
    """The last events of a class; last <= 0 means all."""
    x = events if event_class is None else events.filter(F.col("event_class") == event_class)
    return x.orderBy(*[c.desc() for c in order]).limit(last) if last > 0 else x


def class_catalogue(spark: SparkSession, years: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((years or RETENTION_YEARS).items()), "event_class string, years int")


def retention(events: DataFrame, classes: DataFrame, today: Column, ts: str = "ts") -> DataFrame:
    """events with keep_until and `expired`; a class that isn't in the catalogue is kept."""
    x = events.join(classes, "event_class", "left")
    x = x.withColumn("keep_until", F.add_months(F.col(ts).cast("date"), F.col("years") * 12))
    return x.withColumn("expired", F.coalesce(F.col("keep_until") < today, F.lit(False)))


def overdue(requests: DataFrame, received: str, today: Column, days: int) -> DataFrame:
    return requests.withColumn("age_days", F.datediff(today, F.col(received))).filter(F.col("age_days") > days)


def breach_flags(people: DataFrame, state: str, contact: Column) -> DataFrame:
    """Thresholds of a breach's population: 500 overall, 500 in a state, 10 without contact data."""
    return people.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.count_if(~contact).alias("no_contact")).withColumns({"state_notice": F.col("n") >= 500, "substitute_notice": F.col("no_contact") >= 10})


def breach_total(people: DataFrame, contact: Column) -> DataFrame:
    """One row: the whole population against its thresholds."""
    return people.agg(F.count(F.lit(1)).alias("n"), F.count_if(~contact).alias("no_contact")).withColumns({"notice": F.col("n") >= 500, "substitute_notice": F.col("no_contact") >= 10})


def query_rate_anomalies(access: DataFrame, actor: str, day: str, factor: float = 3.0, days: int = 7) -> DataFrame:
    """Days on which an actor made more than `factor` times the mean of the days before."""
    n = access.groupBy(actor, day).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(actor).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, -1)
    return n.withColumn("trailing_mean", F.avg("n").over(w)).filter(F.col("n") > factor * F.col("trailing_mean"))


def disclosures(events: DataFrame, subject: str, ts: str, since: Column) -> DataFrame:
    """Each subject's disclosures in the look-back, in order."""
    x = events.filter((F.col("event_class") == "DISCLOSURE") & (F.col(ts) >= since))
    return x.groupBy(subject).agg(F.sort_array(F.collect_list(F.struct(ts, "event_id"))).alias("disclosures"))


def replay_scope(rows: DataFrame, partner: str, member: str) -> DataFrame:
    return rows.agg(F.count_distinct(partner).alias("partners"), F.count_distinct(member).alias("members"), F.count(F.lit(1)).alias("rows"))


def consume_once(incoming: DataFrame, processed: DataFrame, key: str = "event_id") -> DataFrame:
    """Incoming events that haven't been processed, one per id."""
    return incoming.dropDuplicates([key]).join(processed.select(key), key, "left_anti")


def outbox_batch(outbox: DataFrame, n: int) -> DataFrame:
    """The n oldest unpublished rows."""
    return outbox.filter("published_at IS NULL").orderBy("created_at", "event_id").limit(n)


def page_after(queue: DataFrame, score: float | None, key: str | None, n: int) -> DataFrame:
    """The n open rows after a cursor (score, queue_id), by falling score."""
    x = queue.filter("resolution IS NULL")
    if score is not None:
        x = x.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col("queue_id") > key)))
    return x.orderBy(F.desc("score"), "queue_id").limit(n)


def resolve_config(load: dict, contract: dict, partner: dict, default: dict) -> dict:
    """Each parameter from the narrowest scope that states it."""
    return {k: next(s[k] for s in (load, contract, partner, default) if k in s) for k in {*load, *contract, *partner, *default}}
