"""Day 1, a deletion, day 2: feeds to decisions and a store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import dob_token, name_token, normalize, ssn_last4_token, token, uuid5
from ..operators import dq, identity, suppression
from ..operators.dedup import last_wins
from ..operators.mapping import PartnerMapping, map_feed
from ..operators.resolve import merge_edges, resolve_edges, resolve_review, review_queue
from ..operators.store import deletion_target, enrollments_per_member, history_rows, new_rows, scd2
from ..scratch import Scratch
from ..sources.snapshots import Snapshots, Tables, Transaction

TOKENS = "name_token string, dob_token string, address_token string, phone_token string, email_token string, ssn_token string"
MEMBERS = f"member_id string, state string, state_effective_from timestamp, {TOKENS}, first_seen_at timestamp, last_updated_at timestamp, tombstoned_at timestamp"
ENROLLMENTS = "enrollment_id string, member_id string, partner_id string, partner_member_id string, effective_from date, effective_to date, last_seen_in_feed_at timestamp"
LEDGER = "suppression_hash string, deleted_at timestamp, deletion_request_id string, override_count int"
AUDIT = "event_class string, actor_role string, target_token string, outcome string, trigger string, context string, timestamp timestamp"
HISTORY = "member_id string, state string, state_effective_from timestamp, name_token string, dob_token string, change_trigger string, change_event_id string"
#: Records with the member that they belong to and the one that they came to first; the edges that hold members together; merged members' rows.
RECORDS = f"uid string, member_id string, born_as string, {TOKENS}, since timestamp"
EDGES = "member_id string, uid_l string, uid_r string, match_weight double, origin string, since timestamp"
RETIRED = f"{MEMBERS}, merged_into string, retired_at timestamp"
SCHEMAS = {"members": MEMBERS, "enrollments": ENROLLMENTS, "ledger": LEDGER, "audit": AUDIT, "history": HISTORY, "records": RECORDS, "edges": EDGES, "retired": RETIRED}
#: Tables that are bucketed by member_id: all of a member's rows lie in the same bucket of each.
BY_MEMBER = ("members", "enrollments", "history", "records", "edges", "retired")
ACTOR = "rosterforge-pipeline"


@dataclass
class Store:
    """Tables of the store in a folder with a log of commits: a day, a deletion or a ruling is one commit.

    path: the store's folder; one that holds a store already is opened as its last commit has left it. Without a path a
    scratch folder is taken. buckets: of the tables that lie by member, when the store is made.
    """

    spark: SparkSession
    key: bytes
    salt: str
    path: str | None = None
    buckets: int = 8
    _tx: Transaction | None = None

    def __post_init__(self) -> None:
        self.log = Snapshots(self.spark, self.path or Scratch(self.spark, "store").path("log"))
        if not self.log.version():
            self.reset()

    @property
    def tables(self) -> Tables:
        """Tables as the open transaction sees them, or as the last commit has left them."""
        if self._tx is not None:
            return Tables(lambda: self._tx.tables, self._tx.read)
        return Tables(lambda: sorted(self.log.manifest()["tables"]), self.log.read)

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """What is written inside is seen by others when the outermost block has ended, or never if it raises."""
        if self._tx is not None:
            yield self._tx
            return
        with self.log.transaction() as tx:
            self._tx = tx
            try:
                yield tx
            finally:
                self._tx = None

    def reset(self) -> None:
        """Drop all tables and make empty ones."""
        with self.transaction() as tx:
            for name in tx.tables:
                tx.drop(name)
            for name, schema in SCHEMAS.items():
                by = ["member_id"] if name in BY_MEMBER else None
                tx.create(name, schema, by, self.buckets if by else None)

    def put(self, name: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """Put df's rows in place of a table's, or of some of its buckets'."""
        with self.transaction() as tx:
            if name not in tx.tables:
                tx.create(name, df.schema)
            tx.replace(name, df, buckets)

    def add(self, name: str, df: DataFrame) -> None:
        """Append rows; columns that they lack are null."""
        with self.transaction() as tx:
            if name not in tx.tables:
                tx.create(name, df.schema)
            tx.append(name, df)

    def periods(self) -> DataFrame:
        """Each member's states with their beginnings and ends, from the opening rows of the history."""
        x = scd2(self.tables["history"], ["member_id"], "state", ["state_effective_from", "change_event_id"], "state_effective_from")
        return x.filter("state IS NOT NULL")  # a merged member's last row has none

    def candidates(self) -> DataFrame:
        """Open enrollments of members that aren't deleted."""
        m = enrollments_per_member(self.tables["members"], self.tables["enrollments"])
        return m.select("member_id", F.explode("enrollments").alias("e"), "name_token", "dob_token").select("member_id", "e.*", "name_token", "dob_token")


@dataclass
class Day:
    gates: dict[str, dq.DQResult]
    suppressed: DataFrame
    publishable: DataFrame
    decisions: DataFrame
    groups: DataFrame


def run_day(store: Store, feeds: dict[str, tuple[DataFrame, PartnerMapping]], as_of: str, prior: dict[str, dq.DQResult] | None = None, prior_columns: dict[str, list[str]] | None = None, check_suppression: bool = True, label: str = "day1", reopen: bool = False, u: dict | None = None) -> Day:
    """Map, deduplicate, gate, suppress, resolve and persist the feeds of a day (id to rows with _line, and mapping), in one commit.

    reopen: open an enrollment again on each day on which it is seen, as a plain insert by partner, member and day would.
    """
    with store.transaction():
        return _run_day(store, feeds, as_of, prior, prior_columns, check_suppression, label, reopen, u)


def _run_day(store: Store, feeds: dict, as_of: str, prior: dict | None, prior_columns: dict | None, check_suppression: bool, label: str, reopen: bool, u: dict | None) -> Day:
    spark, tmp = store.spark, Scratch(store.spark, "day")
    gates, passed = {}, []
    for name, (rows, m) in feeds.items():
        columns = [c for c in rows.columns if not c.startswith("_")]
        mapped = map_feed(rows, m)
        one = last_wins(mapped, ["partner_id", "partner_member_id"], [F.col("_line")])
        one = tmp.write(one, f"{name}-mapped")
        gates[name] = dq.run_dq(one, m, columns, (prior_columns or {}).get(name), prior[name].profile if prior and name in prior else None)
        passed.append(gates[name].passed)
    rows = passed[0]
    for x in passed[1:]:
        rows = rows.unionByName(x)
    rows = suppression.with_hashes(rows, store.salt)
    if check_suppression:
        keep, gone = suppression.split_suppressed(rows, store.tables["ledger"], ["partner_id", "partner_member_id"])
    else:
        keep, gone = rows, rows.limit(0)
    keep, gone = tmp.write(keep, "publishable"), tmp.write(gone, "suppressed")
    store.add("audit", ingest_events(spark, gates, as_of, label))
    store.add("audit", suppressed_events(gone, as_of, label))
    decisions, groups, edges = resolve_edges(keep, store.candidates(), store.key, u=u)
    persist(store, keep, decisions, groups, as_of, label, reopen, edges)
    return Day(gates, gone, keep, decisions, groups)


def event(rows: DataFrame, name: str, target: Column, outcome: Column, trigger: str, context: Column, as_of: str) -> DataFrame:
    return rows.select(F.lit(name).alias("event_class"), F.lit(ACTOR).alias("actor_role"), target.alias("target_token"), outcome.alias("outcome"), F.lit(trigger).alias("trigger"), F.to_json(context).alias("context"), F.lit(as_of).cast("timestamp").alias("timestamp"))


def ingest_events(spark: SparkSession, gates: dict[str, dq.DQResult], as_of: str, label: str = "day1") -> DataFrame:
    """A FEED_INGESTED event for each feed, with its drift, its quarantined records and the columns that are new."""
    rows = [(name, "QUARANTINED" if g.feed_quarantined else "ACCEPTED", g.drift, g.quarantined.count(), g.added) for name, g in gates.items()]
    x = spark.createDataFrame(rows, "feed string, outcome string, schema_drift string, quarantined_records long, drift_columns_added array<string>")
    return event(x, "FEED_INGESTED", F.col("feed"), F.col("outcome"), f"{label}_ingest", F.struct("schema_drift", "quarantined_records", "drift_columns_added"), as_of)


def suppressed_events(gone: DataFrame, as_of: str, label: str = "day1") -> DataFrame:
    """A SUPPRESSED_DELETED event for each suppressed record."""
    target = F.concat(F.coalesce("partner_id", F.lit("")), F.lit(":"), F.coalesce("partner_member_id", F.lit("")))
    return event(gone, "SUPPRESSED_DELETED", target, F.lit("SUPPRESSED"), f"{label}_pre_publication", F.struct(F.lit("deletion_ledger_hit").alias("reason")), as_of)


def resolution_event(decisions: DataFrame, gone: DataFrame, as_of: str, label: str) -> DataFrame:
    """One event of a day's resolution, with the histogram of tiers."""
    tiers = decisions.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tier_histogram"))  # a row per tier
    x = tiers.crossJoin(gone.agg(F.count(F.lit(1)).alias("suppressed_count")))  # one row each
    return event(x, f"{label.upper()}_RESOLUTION_COMPLETE", F.lit(f"{label}-batch"), F.lit("SUCCESS"), "ingest", F.struct("suppressed_count", "tier_histogram"), as_of)


def persist(store: Store, rows: DataFrame, decisions: DataFrame, groups: DataFrame, as_of: str, label: str = "day1", reopen: bool = False, edges: DataFrame | None = None) -> None:
    """Insert members, records and enrollments that aren't there; append edges, decisions, reviews, and a history row for each member of the batch."""
    ts, k = F.lit(as_of).cast("timestamp"), store.key
    c = F.col
    uid = F.concat_ws(":", "partner_id", "partner_member_id")
    maybe = lambda name: F.when(normalize(c(name)) != "", token(name, normalize(c(name)), k))
    tok = rows.select(uid.alias("uid"), "partner_id", "partner_member_id", name_token(c("first_name"), c("last_name"), k).alias("name_token"), dob_token(c("dob"), k).alias("dob_token"), maybe("street").alias("address_token"), maybe("phone").alias("phone_token"), maybe("email").alias("email_token"), ssn_last4_token(c("ssn_last4"), k).alias("ssn_token"))
    tmp = Scratch(store.spark, "new")
    each = tmp.write(groups.select("member_id", F.posexplode("uids").alias("k", "uid")).join(tok, "uid"), "each")
    first = each.filter("k = 0").drop("k", "uid", "partner_id", "partner_member_id")
    members = first.withColumns({"state": F.lit("ELIGIBLE_ACTIVE"), "state_effective_from": ts, "first_seen_at": ts, "last_updated_at": ts, "tombstoned_at": F.lit(None).cast("timestamp")})
    with store.transaction():
        store.add("members", new_rows(store.tables["members"], members, ["member_id"]))
        records = each.drop("k", "partner_id", "partner_member_id").withColumns({"born_as": c("member_id"), "since": ts})
        store.add("records", new_rows(store.tables["records"], records, ["uid"]))
        if edges is not None:
            of = each.select(c("uid").alias("uid_l"), "member_id")
            store.add("edges", edges.join(of, "uid_l").select("member_id", "uid_l", "uid_r", "match_weight", F.lit("SCORED").alias("origin"), ts.alias("since")))
        day = ts.cast("date")
        enrollments = each.select(uuid5(F.concat_ws("|", F.lit("enrollment"), "uid", day.cast("string"))).alias("enrollment_id"), "member_id", "partner_id", "partner_member_id", day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), ts.alias("last_seen_in_feed_at"))
        open_now = store.tables["enrollments"].filter("effective_to IS NULL").select("partner_id", "partner_member_id", "member_id")
        fresh = enrollments if reopen else enrollments.join(open_now, ["partner_id", "partner_member_id", "member_id"], "left_anti")
        store.add("enrollments", new_rows(store.tables["enrollments"], fresh, ["partner_id", "partner_member_id", "effective_from"]))
        store.add("decisions", decisions.withColumn("decided_at", ts))
        store.add("review_queue", review_queue(decisions, as_of))
        store.add("history", history_rows(store.tables["members"], groups, f"{label.upper()}_INGEST", as_of))


def delete_member(store: Store, rows: DataFrame, request_id: str, partner_id: str, partner_member_id: str, as_of: str) -> str:
    """Delete the member behind an open enrollment, whose id is returned; rows are the feed's mapped rows, for the person's name and numbers.

    The ledger gets a strict hash for each of the member's open enrollments, and the broad one. Only the member's buckets are rewritten.
    """
    with store.transaction() as tx:
        target = deletion_target(store.tables["members"], store.tables["enrollments"], partner_id, partner_member_id).select("member_id")
        person = rows.filter((F.col("partner_id") == partner_id) & (F.col("partner_member_id") == partner_member_id)).select("last_name", "dob", "ssn_last4").limit(1)
        asked = target.crossJoin(person).select(F.lit(request_id).alias("request_id"), "member_id", "last_name", "dob", "ssn_last4")  # one row each
        tmp = Scratch(store.spark, "request")
        asked = tmp.write(asked, "asked")
        own = tx.touched("members", asked.select("member_id"))
        members, enrollments = tx.read("members", own), tx.read("enrollments", own)
        req = tmp.write(suppression.request_hashes(asked, enrollments.filter("effective_to IS NULL"), store.salt), "request")
        out = suppression.execute_deletions(members, enrollments, store.tables["ledger"], req, as_of)
        store.add("history", out["history"])
        store.add("audit", out["events"])
        store.put("ledger", out["ledger"])
        for name in ("members", "enrollments"):
            store.put(name, out[name], own)
        gone = req.select("member_id", F.lit(True).alias("_gone"))
        blank = lambda c: F.when(F.col("_gone").isNull(), F.col(c))
        records = tx.read("records", own).join(gone, "member_id", "left")
        store.put("records", records.withColumns({c: blank(c) for c in records.columns if c.endswith("_token")}), own)
        return req.first().member_id


def override_member(store: Store, hashes: DataFrame, reason: str, as_of: str) -> None:
    """Let the hashes pass from now on, with an event for each."""
    with store.transaction():
        store.put("ledger", suppression.override(store.tables["ledger"], hashes))
        store.add("audit", suppression.override_events(hashes, reason, as_of))


def two_people(approvers: tuple[str, ...]) -> None:
    if len({a.strip().lower() for a in approvers if a.strip()}) < 2:
        raise PermissionError("two people must approve")


def identity_events(moves: DataFrame, name: str, target: Column, other: Column, approvers: tuple[str, ...], as_of: str) -> DataFrame:
    """An event of high criticality for each member that is merged away or split off."""
    who = F.lit(",".join(sorted(approvers)))
    return event(moves, name, target, F.lit("SUCCESS"), "review_ruling", F.struct(other.alias("other_member_id"), who.alias("approved_by")), as_of)


def merge_members(store: Store, edges: DataFrame, approvers: tuple[str, ...], as_of: str) -> DataFrame:
    """Make one member of those that edges (uid_l, uid_r) between their records join, as reviewers have ruled. (member_id, survivor)

    The survivor gets the others' records, edges and enrollments; their rows go to `retired`, their periods end, and the survivor has
    a row of history. Only the buckets of these members are rewritten. Two people must approve.
    """
    two_people(approvers)
    ts, c = F.lit(as_of).cast("timestamp"), F.col
    tmp = Scratch(store.spark, "merge")
    edges = tmp.write(edges.select("uid_l", "uid_r").filter("uid_l <> uid_r").distinct(), "edges")
    with store.transaction() as tx:
        moves = tmp.write(identity.merge_moves(store.tables["records"], store.tables["members"], edges), "moves")
        both = moves.select(F.explode(F.array("member_id", "survivor")).alias("member_id")).distinct()
        own = tx.touched("members", both)
        to = moves.select("member_id", c("survivor").alias("_to"))
        moved = lambda table: tx.read(table, own).join(to, "member_id", "left").withColumn("member_id", F.coalesce("_to", "member_id")).drop("_to")
        records = tmp.write(moved("records"), "records")
        ruled = edges.join(records.select(c("uid").alias("uid_l"), "member_id"), "uid_l").join(records.select(c("uid").alias("uid_r")), "uid_r", "left_semi")
        ruled = ruled.join(both, "member_id", "left_semi").withColumns({"match_weight": F.lit(None).cast("double"), "origin": F.lit("RULING"), "since": ts})
        old = tx.read("members", own).join(to, "member_id", "left")
        gone = tmp.write(old.filter("_to IS NOT NULL").withColumnRenamed("_to", "merged_into").withColumn("retired_at", ts), "gone")
        kept = old.filter("_to IS NULL").drop("_to").join(moves.select(c("survivor").alias("member_id"), F.lit(True).alias("_s")).distinct(), "member_id", "left")
        kept = tmp.write(kept.withColumn("last_updated_at", F.when(c("_s"), ts).otherwise(c("last_updated_at"))), "kept")
        store.put("records", records, own)
        store.put("enrollments", moved("enrollments"), own)
        store.put("edges", moved("edges").unionByName(ruled.select("member_id", "uid_l", "uid_r", "match_weight", "origin", "since")), own)
        store.put("members", kept.drop("_s"), own)
        store.add("retired", gone)
        closed = history_rows(gone.withColumn("state", F.lit(None).cast("string")), moves, "IDENTITY_MERGE", as_of)
        store.add("history", closed.unionByName(history_rows(kept, moves.select(c("survivor").alias("member_id")), "IDENTITY_MERGE", as_of)))
        store.add("audit", identity_events(moves, "IDENTITY_MERGE", c("member_id"), c("survivor"), approvers, as_of))
    return moves


def rule_on_queue(store: Store, rulings: DataFrame, approvers: tuple[str, ...], as_of: str) -> DataFrame:
    """Close queue rows by rulings (queue_id, resolution, merge_with), and merge what MERGE rulings join, in one commit."""
    with store.transaction():
        queue = Scratch(store.spark, "queue").write(store.tables["review_queue"], "queue")
        moves = merge_members(store, merge_edges(queue, rulings), approvers, as_of)
        if "resolved_at" not in queue.columns:
            with store.transaction() as tx:
                tx.create("review_queue", resolve_review(queue, rulings, as_of).schema)
        store.put("review_queue", resolve_review(queue, rulings, as_of))
    return moves


def split_members(store: Store, cut: DataFrame, approvers: tuple[str, ...], as_of: str) -> DataFrame:
    """Take the edges of cut (uid_l, uid_r) out, and let members that fall apart be several. (uid, member_id, new_member_id)

    A part that was a member of its own before a merge is that member again, with its row of then; other parts have the tokens
    of their first record. Only the buckets of these members are read and rewritten. Two people must approve.
    """
    two_people(approvers)
    ts, c = F.lit(as_of).cast("timestamp"), F.col
    tmp = Scratch(store.spark, "split")
    cut = tmp.write(cut.select(F.least("uid_l", "uid_r").alias("uid_l"), F.greatest("uid_l", "uid_r").alias("uid_r")).distinct(), "cut")
    with store.transaction() as tx:
        ends = cut.select(F.explode(F.array("uid_l", "uid_r")).alias("uid"))
        concerned = tx.touched("members", store.tables["records"].join(ends, "uid", "left_semi").select("member_id"))
        moves = tmp.write(identity.split_moves(tx.read("records", concerned), tx.read("edges", concerned), cut), "moves")
        parted = tmp.write(moves.select("member_id", "new_member_id").distinct(), "parted")
        own = sorted({*concerned, *tx.touched("members", parted.select(c("new_member_id").alias("member_id")))})
        to = moves.select("uid", c("new_member_id").alias("_to"))
        records = tx.read("records", own).join(to, "uid", "left").withColumn("member_id", F.coalesce("_to", "member_id")).drop("_to")
        records = tmp.write(records, "records")
        uid = F.concat_ws(":", "partner_id", "partner_member_id")
        e = tx.read("enrollments", own).withColumn("uid", uid).join(to, "uid", "left").withColumn("member_id", F.coalesce("_to", "member_id")).drop("_to", "uid")
        both = cut.unionByName(cut.select(c("uid_r").alias("uid_l"), c("uid_l").alias("uid_r")))
        edges = tx.read("edges", own).join(both, ["uid_l", "uid_r"], "left_anti").join(to.withColumnRenamed("uid", "uid_l"), "uid_l", "left")
        old = tmp.write(tx.read("members", own), "members")
        retired = tx.read("retired", own)
        back = retired.join(parted.select(c("new_member_id").alias("member_id"), c("member_id").alias("merged_into")), ["member_id", "merged_into"], "left_semi")
        back = tmp.write(back.drop("merged_into", "retired_at").withColumn("last_updated_at", ts), "back")
        first = records.join(parted.select(c("new_member_id").alias("member_id"), c("member_id").alias("_from")), "member_id").join(back, "member_id", "left_anti")
        tokens = [x for x in records.columns if x.endswith("_token")]
        first = first.groupBy("member_id", "_from").agg(F.min_by(F.struct(*tokens), F.struct("since", "uid")).alias("_t"), F.min("since").alias("first_seen_at"))
        made = first.join(old.select(c("member_id").alias("_from"), "state"), "_from").select("member_id", "state", ts.alias("state_effective_from"), "_t.*", "first_seen_at", ts.alias("last_updated_at"), F.lit(None).cast("timestamp").alias("tombstoned_at"))
        new = tmp.write(made.unionByName(back), "new")
        store.put("records", records, own)
        store.put("enrollments", e, own)
        store.put("edges", edges.withColumn("member_id", F.coalesce("_to", "member_id")).drop("_to"), own)
        store.put("members", old.unionByName(new), own)
        store.put("retired", retired.join(back, "member_id", "left_anti"), own)
        opened = history_rows(new, new, "IDENTITY_SPLIT", as_of)
        store.add("history", opened.unionByName(history_rows(old, parted, "IDENTITY_SPLIT", as_of)))
        store.add("audit", identity_events(parted, "IDENTITY_SPLIT", c("new_member_id"), c("member_id"), approvers, as_of))
    return moves
