"""Deletion ledger: suppress, delete, override."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import broad_hash, strict_hash
from ..scratch import Scratch
from ..sources.snapshots import Snapshots, Transaction
from .store import insert_if_absent

UUID = r"^\{?(urn:uuid:)?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def with_hashes(rows: DataFrame, salt: str, nfc: bool = True) -> DataFrame:
    """rows (last_name, dob, ssn_last4, partner_id, partner_member_id) with suppression_hashes: the strict and, with digits, the broad one."""
    c = F.col
    strict = strict_hash(salt, c("last_name"), c("dob"), c("partner_id"), c("partner_member_id"), nfc)
    return rows.withColumn("suppression_hashes", F.array_compact(F.array(strict, broad_hash(salt, c("dob"), c("ssn_last4")))))


def request_hashes(requests: DataFrame, enrollments: DataFrame, salt: str, nfc: bool = True) -> DataFrame:
    """requests (request_id, member_id, last_name, dob, ssn_last4) with suppression_hashes: a strict one for each enrollment of the member, and the broad one."""
    own = requests.join(enrollments.select("member_id", "partner_id", "partner_member_id"), "member_id", "left")
    each = with_hashes(own, salt, nfc).withColumn("suppression_hashes", F.when(F.col("partner_id").isNull(), F.array_compact(F.array(broad_hash(salt, F.col("dob"), F.col("ssn_last4"))))).otherwise(F.col("suppression_hashes")))
    return each.groupBy("request_id", "member_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("suppression_hashes")))).alias("suppression_hashes"))


def mark_suppressed(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows (with suppression_hashes) and `suppressed`: any of a row's hashes is in the ledger and not overridden.

    The hashes alone decide, so rows without keys are held against the ledger as well, and rows that share a key each by their
    own hashes. Only distinct sets of hashes are looked up: one join for all rows, whatever the ledger's size.
    """
    live = ledger.filter("override_count = 0").select(F.col("suppression_hash").alias("_h")).distinct()
    own = F.coalesce("suppression_hashes", F.array().cast("array<string>"))
    sets = rows.select(own.alias("_set")).distinct()
    hit = sets.select("_set", F.explode("_set").alias("_h")).join(live, "_h", "left_semi").select("_set").distinct()
    marked = rows.withColumn("_set", own).join(hit.withColumn("suppressed", F.lit(True)), "_set", "left").drop("_set")
    return marked.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def split_suppressed(rows: DataFrame, ledger: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Publishable rows and suppressed rows. key: only names the rows for the reader; it doesn't decide."""
    x = mark_suppressed(rows, ledger)
    return x.filter(~F.col("suppressed")).drop("suppressed"), x.filter("suppressed").drop("suppressed")


def override(ledger: DataFrame, hashes: DataFrame) -> DataFrame:
    """override_count + 1 for the given hashes; each must be known. Strict and broad are overridden one by one."""
    unknown = hashes.join(ledger, "suppression_hash", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"no such suppression hash: {unknown[0][0]}")
    add = hashes.groupBy("suppression_hash").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return ledger.join(add, "suppression_hash", "left").withColumn("override_count", F.col("override_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def execute_deletions(members: DataFrame, enrollments: DataFrame, ledger: DataFrame, requests: DataFrame, as_of: str, close_enrollments: bool = True) -> dict[str, DataFrame]:
    """requests (request_id, member_id, suppression_hashes): tombstoned members, ledger, closed enrollments, history and events.

    Every request must name a known member that isn't deleted yet, and no two requests the same one. A hash that is in the ledger with overrides starts
    anew, so that a second deletion takes effect.
    """
    if requests.filter(~F.col("member_id").rlike(UUID)).limit(1).count():
        raise ValueError("a request's member_id isn't a UUID")
    twice = requests.groupBy("member_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].member_id} is asked to be deleted {twice[0]['count']} times")
    known = requests.join(members.select("member_id", "state"), "member_id", "left")
    bad = known.filter("state IS NULL OR state = 'DELETED'").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].member_id} is {'unknown' if bad[0].state is None else 'deleted already'}")
    ts = F.lit(as_of).cast("timestamp")
    gone = requests.select("member_id").distinct().withColumn("_gone", F.lit(True))
    m = members.join(gone, "member_id", "left")
    tokens = {c: F.when(F.col("_gone"), F.lit("" if c in ("name_token", "dob_token") else None).cast("string")).otherwise(F.col(c)) for c in members.columns if c.endswith("_token")}
    m = m.withColumns(tokens | {"state": F.when(F.col("_gone"), "DELETED").otherwise(F.col("state"))} | {c: F.when(F.col("_gone"), ts).otherwise(F.col(c)) for c in ("state_effective_from", "tombstoned_at", "last_updated_at") if c in members.columns})
    new = requests.select(F.explode("suppression_hashes").alias("suppression_hash"), ts.alias("deleted_at"), F.col("request_id").alias("deletion_request_id"), F.lit(0).alias("override_count"))
    again = new.select("suppression_hash").distinct().withColumn("_again", F.lit(True))
    old = ledger.join(again, "suppression_hash", "left").withColumn("override_count", F.when(F.col("_again"), 0).otherwise(F.col("override_count"))).drop("_again")
    e = enrollments
    if close_enrollments:
        e = enrollments.join(gone, "member_id", "left").withColumn("effective_to", F.when(F.col("_gone") & F.col("effective_to").isNull(), ts.cast("date")).otherwise(F.col("effective_to"))).drop("_gone")
    history = known.select("member_id", F.lit("DELETED").alias("state"), ts.alias("state_effective_from"), F.lit("DELETION").alias("change_trigger"), F.col("request_id").alias("change_event_id"))
    events = deletion_events(known, ts)
    return {"members": m.drop("_gone"), "ledger": insert_if_absent(old, new, ["suppression_hash"]), "enrollments": e, "history": history, "events": events}


def deletion_events(known: DataFrame, ts: Column) -> DataFrame:
    """Two events of each request (request_id, member_id, suppression_hashes, and the member's state before)."""
    asked = F.to_json(F.struct(F.col("state").alias("prior_state"), "request_id"))
    done = F.to_json(F.struct(F.size("suppression_hashes").alias("suppression_hash_count"), "request_id"))
    event = lambda name, outcome, context: F.struct(F.lit(name).alias("event_class"), F.lit(outcome).alias("outcome"), context.alias("context"))
    both = F.explode(F.array(event("DELETION_REQUESTED", "ACCEPTED", asked), event("DELETION_EXECUTED", "SUCCESS", done)))
    x = known.select("member_id", both.alias("e"))
    return x.select("e.event_class", F.lit("deletion_operator").alias("actor_role"), F.col("member_id").alias("target_token"), "e.outcome", F.lit("right_to_deletion_request").alias("trigger"), "e.context", ts.alias("timestamp"))


def override_events(hashes: DataFrame, reason: str, as_of: str) -> DataFrame:
    """A DELETION_OVERRIDE event for each hash that is overridden."""
    context = F.to_json(F.struct(F.lit(reason).alias("reason")))
    return hashes.select(F.lit("DELETION_OVERRIDE").alias("event_class"), F.lit("deletion_operator").alias("actor_role"), F.col("suppression_hash").alias("target_token"), F.lit("SUCCESS").alias("outcome"), F.lit("operator_override").alias("trigger"), context.alias("context"), F.lit(as_of).cast("timestamp").alias("timestamp"))


class Vault:
    """Plaintext by token in a restricted folder: rows that are appended, and a log of the tokens that are erased.

    Every change is a commit of the folder's log, so another session sees it whole or not at all; a transaction's changes are
    one commit. Without a path the vault lies in a scratch folder of its own.
    """

    SCHEMA = "token string, field_class string, plaintext string, created_at timestamp, tombstoned_at timestamp"
    ERASED = "token string, at timestamp"

    def __init__(self, spark, path: str | None = None):
        self.spark, self._tx = spark, None
        self.log = Snapshots(spark, path or Scratch(spark, "vault").path("log"))
        if not self.log.version():
            with self.log.transaction() as tx:
                tx.create("rows", self.SCHEMA)
                tx.create("erased", self.ERASED)

    @contextmanager
    def _within(self) -> Iterator[Transaction]:
        """The open transaction, or one of its own."""
        if self._tx is not None:
            yield self._tx
        else:
            with self.log.transaction() as tx:
                yield tx

    @property
    def erased(self) -> list:
        """The files of the erased tokens' log."""
        return self.log.files("erased")

    @property
    def table(self) -> DataFrame:
        """All rows as they are now: an erased token has no plaintext, and the moment at which it was first erased."""
        return self._now(self.log.read if self._tx is None else self._tx.read)

    @staticmethod
    def _now(read) -> DataFrame:
        gone = read("erased").groupBy("token").agg(F.min("at").alias("_at"))
        x = read("rows").join(gone, "token", "left")
        x = x.withColumns({"plaintext": F.when(F.col("_at").isNull(), F.col("plaintext")), "tombstoned_at": F.coalesce("tombstoned_at", "_at")})
        return x.select("token", "field_class", "plaintext", "created_at", "tombstoned_at")

    def store(self, values: DataFrame, as_of: str) -> DataFrame:
        """values (field_class, plaintext) with new random tokens, which are returned."""
        new = values.select(F.concat(F.lit("vt_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("token"), "field_class", "plaintext", F.lit(as_of).cast("timestamp").alias("created_at"))
        new = Scratch(self.spark, "vault").write(new, "new")  # the tokens are drawn once
        with self._within() as tx:
            tx.append("rows", new)
        return new.select("token", "field_class", "plaintext")

    def reveal(self, tokens: DataFrame) -> DataFrame:
        """(token, plaintext); null for unknown and tombstoned tokens."""
        return tokens.join(self.table.select("token", "plaintext"), "token", "left")

    def tombstone(self, tokens: DataFrame, as_of: str) -> None:
        """Erase plaintexts; doing it again changes nothing."""
        with self._within() as tx:
            tx.append("erased", tokens.select("token", F.lit(as_of).cast("timestamp").alias("at")).distinct())

    def compact(self, keep: int = 1) -> None:
        """Write the rows as they are now, and drop the folders that only older versions name, so that erased plaintexts are gone."""
        with self._within() as tx:
            tx.replace("rows", self._now(tx.read))
            tx.create("erased", self.ERASED)
        if self._tx is None:
            self.log.vacuum(keep)

    @contextmanager
    def transaction(self) -> Iterator[Vault]:
        """A vault whose changes are taken over when the block ends, or not at all if it raises."""
        with self.log.transaction() as tx:
            inner = Vault(self.spark, self.log.path)
            inner._tx = tx
            yield inner
