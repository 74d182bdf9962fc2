"""The store's commit log, merges and splits, the history in batches, readers that lose nothing, and suppression by hashes."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from rosterforge import fixtures
from rosterforge.functions import dates, tokens
from rosterforge.operators import anchors, audit, dq, history, identity, resolve, rules, store, suppression
from rosterforge.plans import pipeline
from rosterforge.sources import capture, feeds, stages
from rosterforge.sources.snapshots import Conflict, Snapshots
from rosterforge.streaming import lockout, timed


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id int")


# commits


def test_a_transaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    s, other = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    with s.transaction() as tx:
        tx.create("a", "id int")
        tx.create("b", "id int, v string")
        tx.append("a", ids(spark, 1, 2))
        assert tx.read("a").count() == 2 and other.version() == 0
    with pytest.raises(RuntimeError), s.transaction() as tx:  # a writer that dies between two tables
        tx.append("a", ids(spark, 3))
        raise RuntimeError
    assert other.version() == 1 and other.read("a").count() == 2 and other.read("b").count() == 0
    with s.transaction() as tx:
        tx.append("b", ids(spark, 7))
        tx.replace("a", ids(spark, 9))
    assert [r.id for r in other.read("a").collect()] == [9] and tuple(other.read("b").first()) == (7, None)
    assert sorted(r.id for r in other.read("a", version=1).collect()) == [1, 2]
    assert len(s.vacuum(keep=1)) == 2 and s.versions() == [2] and other.read("a").count() == 1


def test_writers_that_meet(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    with s.transaction() as tx:
        tx.create("a", "id int", ["id"], 4)
        tx.create("b", "id int")
        tx.append("a", ids(spark, *range(40)))
    with s.transaction() as one, s.transaction() as two:  # both append: the one that commits later takes the next number
        one.append("b", ids(spark, 1))
        two.append("b", ids(spark, 2))
    assert s.version() == 3 and sorted(r.id for r in s.read("b").collect()) == [1, 2]
    with pytest.raises(Conflict), s.transaction() as one:
        one.read("b")
        with s.transaction() as two:
            two.append("b", ids(spark, 3))
        one.append("a", ids(spark, 99))
    assert s.read("a").count() == 40
    buckets = {b: ids(spark, *[r.id for r in s.read("a", buckets=[b]).collect()]) for b in range(4)}
    with s.transaction() as one, s.transaction() as two:  # other buckets of one table
        one.replace("a", buckets[0].filter("id > 20"), [0])
        two.replace("a", buckets[1].filter("id > 20"), [1])
    assert s.read("a", buckets=[0, 1]).filter("id <= 20").count() == 0 and s.read("a", buckets=[2, 3]).count() == buckets[2].count() + buckets[3].count()
    with pytest.raises(Conflict), s.transaction() as one:
        one.replace("a", buckets[2], [2])
        with s.transaction() as two:
            two.replace("a", buckets[2].limit(0), [2])
    with pytest.raises(ValueError), s.transaction() as one:
        one.replace("a", buckets[2], [3])


def test_a_second_session_opens_the_store_and_runs_the_next_day(spark, tmp_path):
    a, b = fixtures.mappings()
    path, n = str(tmp_path / "store"), 40
    first = pipeline.Store(spark, b"key", "salt", path)
    day = lambda k: {"A": (fixtures.feed_a(spark, k, n), a), "B": (fixtures.feed_b(spark, k, n), b)}
    one = pipeline.run_day(first, day(1), "2024-01-01")
    members, version = first.tables["members"].count(), first.log.version()
    assert members and version == 2
    with pytest.raises(ZeroDivisionError), first.transaction():
        first.add("audit", first.tables["audit"])
        first.put("members", first.tables["members"].limit(1))
        1 / 0
    again = pipeline.Store(spark.newSession(), b"key", "salt", path)
    assert again.log.version() == version and again.tables["members"].count() == members
    gone = pipeline.delete_member(again, one.publishable, "r1", "PARTNER_A", one.publishable.filter("partner_id = 'PARTNER_A'").agg(F.min("partner_member_id")).first()[0], "2024-01-10")
    two = pipeline.run_day(again, day(2), "2024-02-01", label="day2")
    tiers = {r.tier: r["count"] for r in two.decisions.groupBy("tier").count().collect()}
    assert tiers["TIER_1_DETERMINISTIC"] >= 60 and first.tables["members"].filter(F.col("member_id") == gone).first().state == "DELETED"
    assert first.tables["records"].filter((F.col("member_id") == gone) & F.col("name_token").isNotNull()).count() == 0
    assert pipeline.Store(spark, b"key", "salt", path).tables["decisions"].filter("decided_at > '2024-01-15'").count() == two.decisions.count()


# merges and splits


def brute_components(nodes, edges):
    of = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            low = min(of[a], of[b])
            of = {k: low if v in (of[a], of[b]) else v for k, v in of.items()}
    return of


def test_merge_moves(spark):
    records = spark.createDataFrame([(f"r{i}", f"m{i // 2}") for i in range(12)], "uid string, member_id string")
    members = spark.createDataFrame([(f"m{i}", "DELETED" if i == 5 else "ELIGIBLE_ACTIVE", f"2024-01-0{9 - i}") for i in range(6)], "member_id string, state string, first_seen_at string")
    edges = spark.createDataFrame([("r0", "r1"), ("r1", "r2"), ("r3", "r4"), ("r0", "r11"), ("r6", "none"), ("r9", "r8")], "uid_l string, uid_r string")
    assert sorted(map(tuple, identity.merge_moves(records, members, edges).collect())) == [("m0", "m2"), ("m1", "m2")]
    assert identity.merge_moves(records, members, edges.limit(0)).count() == 0


def test_split_moves(spark):
    own = [("a", "M", "M"), ("b", "M", "M"), ("c", "M", "M"), ("d", "M", "N"), ("e", "M", "N"), ("f", "M", "O"), ("z", "Z", "Z")]
    records = spark.createDataFrame(own, "uid string, member_id string, born_as string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "uid_l string, uid_r string")
    cut = lambda *x: spark.createDataFrame(list(x), "uid_l string, uid_r string")
    go = lambda *x: {r.uid: r.new_member_id for r in identity.split_moves(records, edges, cut(*x)).collect()}
    assert go(("a", "b")) == {} and go(("a", "z")) == {}  # still one piece
    assert go(("d", "c"), ("e", "f")) == {"d": "N", "e": "N", "f": "O"}
    mixed = go(("c", "d"))
    assert set(mixed) == {"d", "e", "f"} and len(set(mixed.values())) == 1 and not set(mixed.values()) & {"M", "N", "O"}
    alone = go(("a", "b"), ("c", "a"))
    assert set(alone) == {"a"} and alone["a"] != "M"


def state_of(s):
    return {name: sorted(map(str, s.tables[name].collect())) for name in ("members", "enrollments", "records", "edges")}


def test_a_ruling_merges_members_and_a_split_undoes_it(spark, tmp_path):
    a, b = fixtures.mappings()
    s = pipeline.Store(spark, b"key", "salt", str(tmp_path / "s"), buckets=16)
    pipeline.run_day(s, {"A": (fixtures.feed_a(spark, 1, 60), a), "B": (fixtures.feed_b(spark, 1, 60), b)}, "2024-01-01")
    before = {r.uid: r.member_id for r in s.tables["records"].collect()}
    assert len(before) == s.tables["enrollments"].count() and s.tables["edges"].count() >= 1
    single = sorted(u for u, m in before.items() if list(before.values()).count(m) == 1)
    x, y, z = single[0], single[7], single[11]
    edges = spark.createDataFrame([(x, y), (z, y)], "uid_l string, uid_r string")
    with pytest.raises(PermissionError):
        pipeline.merge_members(s, edges, ("ann", "Ann "), "2024-03-01")
    was, files = state_of(s), dict((b, p) for p, b in s.log.files("members"))
    pipeline.merge_members(s, edges, ("ann", "bob"), "2024-03-01")
    keep = min(before[u] for u in (x, y, z))
    own = {r.uid: r.member_id for r in s.tables["records"].collect()}
    assert own == {u: keep if u in (x, y, z) else m for u, m in before.items()}
    enrolled = {f"{r.partner_id}:{r.partner_member_id}": r.member_id for r in s.tables["enrollments"].collect()}
    assert enrolled == own and {r.member_id for r in s.tables["members"].collect()} == set(own.values())
    assert {r.merged_into for r in s.tables["retired"].collect()} == {keep} and s.tables["retired"].count() == 2
    untouched = [b for b, p in s.log.files("members") if (b, p) in files.items()] or [b for p, b in s.log.files("members") if files.get(b) == p]
    assert len(untouched) >= len(files) - 3
    ends = {r.member_id: r.effective_to for r in s.periods().filter("effective_to IS NOT NULL").collect()}
    assert set(ends) == {before[u] for u in (x, y, z)} - {keep} and all(e.month == 3 for e in ends.values())
    pipeline.merge_members(s, edges, ("ann", "bob"), "2024-03-02")  # once more: nothing moves
    assert {r.uid: r.member_id for r in s.tables["records"].collect()} == own

    with pytest.raises(PermissionError):
        pipeline.split_members(s, edges, ("ann",), "2024-04-01")
    moves = pipeline.split_members(s, edges, ("ann", "bob"), "2024-04-01")
    assert moves.count() == 2
    now = state_of(s)
    assert now["records"] == was["records"] and now["enrollments"] == was["enrollments"] and now["edges"] == was["edges"]
    drop = lambda rows: sorted(r.split("last_updated_at")[0] for r in rows)
    assert drop(now["members"]) == drop(was["members"]) and s.tables["retired"].count() == 0
    events = [r.event_class for r in s.tables["audit"].collect()]
    assert events.count("IDENTITY_MERGE") == 2 and events.count("IDENTITY_SPLIT") == 2
    open_ = s.periods().filter("effective_to IS NULL").groupBy("member_id").count().collect()
    assert {r.member_id for r in open_} == set(before.values()) and all(r["count"] == 1 for r in open_)


def test_a_scored_edge_that_is_cut_parts_a_member(spark, tmp_path):
    a, b = fixtures.mappings()
    s = pipeline.Store(spark, b"key", "salt", str(tmp_path / "s"))
    pipeline.run_day(s, {"A": (fixtures.feed_a(spark, 1, 60), a), "B": (fixtures.feed_b(spark, 1, 60), b)}, "2024-01-01")
    edge = s.tables["edges"].orderBy("uid_l").first()
    n = s.tables["members"].count()
    pipeline.split_members(s, spark.createDataFrame([(edge.uid_r, edge.uid_l)], "uid_l string, uid_r string"), ("ann", "bob"), "2024-04-01")
    own = {r.uid: r.member_id for r in s.tables["records"].collect()}
    assert own[edge.uid_l] != own[edge.uid_r] and s.tables["members"].count() == n + 1
    new = s.tables["members"].filter(F.col("member_id").isin(own[edge.uid_l], own[edge.uid_r])).collect()
    assert all(r.name_token and r.state == "ELIGIBLE_ACTIVE" for r in new) and len(new) == 2
    assert s.tables["edges"].filter((F.col("uid_l") == edge.uid_l) & (F.col("uid_r") == edge.uid_r)).count() == 0


# history in batches


def test_batches_make_the_history_of_a_rebuild(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["k1", "k2", "k3", None, "k5", "k6"]), f"2024-01-{r.randrange(1, 29):02d}", r.choice("ABC"), batch, i) for batch in range(6) for i in range(batch * 100, batch * 100 + 12)]
    x = spark.createDataFrame(rows, "k string, d string, state string, arrival int, tie int").withColumn("effective", F.col("d").cast("date"))
    h = history.History(Snapshots(spark, str(tmp_path)), "h", ["k"], "k string, effective date, state string, arrival int, tie int", buckets=8)
    for batch in range(6):
        before = dict((b, p) for p, b in h.store.files("h"))
        own = h.merge(x.filter(F.col("arrival") == batch))
        after = dict((b, p) for p, b in h.store.files("h"))
        assert {b for b in after if before.get(b) != after[b]} == set(own)
        want = store.rebuild(x.filter(F.col("arrival") <= batch), ["k"], "state", "effective", "arrival", "tie")
        assert sorted(map(str, h.periods().collect())) == sorted(map(str, want.select("k", "state", "effective_from", "effective_to").collect()))
    assert h.merge(x.limit(0)) == [] and h.merge(x.filter("arrival = 2")) and sorted(map(str, h.periods().collect())) == sorted(map(str, want.select("k", "state", "effective_from", "effective_to").collect()))


def test_as_of_repeats_a_period_for_wanted_spans_only(spark):
    h = spark.createDataFrame([("a", "X", "1990-01-01", None), ("b", "Y", "2024-02-01", "2024-02-03")], "id string, state string, f string, t string")
    h = h.select("id", "state", F.col("f").cast("date").alias("effective_from"), F.col("t").cast("date").alias("effective_to"))
    m = spark.createDataFrame([("1991-05-05",), ("2024-02-02",)], "m string").select(F.col("m").cast("date").alias("moment"))
    x = store.as_of(h, m, days=1)
    assert sorted((r.moment.year, r.id) for r in x.collect()) == [(1991, "a"), (2024, "a"), (2024, "b")]


def test_violations_of_several_checks(spark):
    x = spark.createDataFrame([(1, 5), (1, -1), (2, None)], "k int, v int")
    got = {r.rule: r.n for r in store.violations(x, ["k"], {"positive": F.col("v") > 0, "known": F.col("v").isNotNull(), "fine": F.lit(True)}).collect()}
    assert got == {"unique": 1, "positive": 1, "known": 1}


# suppression


def test_rows_without_keys_are_held_against_the_ledger(spark):
    rows = spark.createDataFrame([(None, ["h1"]), ("a", ["h2"]), ("a", ["h3"]), ("b", []), ("c", None), (None, ["h4", "h1"]), (None, ["h2"])], "k string, suppression_hashes array<string>")
    ledger = spark.createDataFrame([("h1", 0), ("h3", 0), ("h2", 1)], "suppression_hash string, override_count int")
    keep, gone = suppression.split_suppressed(rows, ledger, ["k"])
    assert sorted(map(str, gone.collect())) == sorted(map(str, rows.filter("array_contains(suppression_hashes, 'h1') OR array_contains(suppression_hashes, 'h3')").collect()))
    assert keep.count() == 4 and keep.columns == rows.columns


def test_a_member_that_is_asked_for_twice_is_refused(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    members = spark.createDataFrame([(u, "ELIGIBLE_ACTIVE")], "member_id string, state string")
    enrollments = spark.createDataFrame([], "member_id string, effective_to date")
    ledger = spark.createDataFrame([], pipeline.LEDGER)
    asked = spark.createDataFrame([("r1", u, ["h"]), ("r2", u, ["g"])], "request_id string, member_id string, suppression_hashes array<string>")
    with pytest.raises(ValueError, match="2 times"):
        suppression.execute_deletions(members, enrollments, ledger, asked, "2024-01-01")
    assert suppression.execute_deletions(members, enrollments, ledger, asked.limit(1), "2024-01-01")["events"].count() == 2


def test_all_white_space_is_white_space(spark):
    space = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    df = spark.createDataFrame([(x + "A" + x + x + "b" + x,) for x in space], "x string")
    got = df.select(tokens.normalize(F.col("x")).alias("n"), tokens.strip(F.col("x")).alias("s"), "x").collect()
    assert len(got) == len(space) and all(r.n == "a b" and r.s == r.x.strip() for r in got)


def test_us_dates_are_read_number_by_number(spark):
    want = {" 4 / 2 / 1985 ": "1985-04-02", "4/2/ 85": "0085-04-02", "4/2/ 5": "4/2/ 5", "4/2/5": "0005-04-02", "4/2/85 ": "1985-04-02", "004/0002/00085": "0085-04-02", "4/2/1985\x1c": "1985-04-02", "4 /2/31": "1931-04-02", "x": "x", "4/2/19 85": "4/2/19 85"}
    got = spark.createDataFrame([(k,) for k in want], "x string").select("x", dates.us_date(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == want


# readers


def test_a_broken_xml_row_takes_no_other_with_it(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><rs><r><id>1</id><n>x</n></r>\n<r><id>2</id><n>bad</r><r k="v"><id>3</id></r><r/><r><id>4</id><r><id>5</id><n>é&amp;</n></r><rx><id>9</id></rx><r><id>6</id></rs>', encoding="utf-8")
    (tmp_path / "b.xml").write_text("<rs></rs>")
    (tmp_path / "c.xml").write_text("<rs><r><id>7</id></r><r><id>8</id>")
    got = feeds.read_xml(spark, str(tmp_path), "r", ["id", "n"]).collect()
    assert sorted((r.id, r.n) for r in got if r.id) == [("1", "x"), ("3", None), ("5", "é&"), ("7", None)]
    assert sorted(r.parse_error for r in got if r.parse_error) == ["<r><id>2</id><n>bad</r>", "<r><id>4</id>", "<r><id>6</id></rs>", "<r><id>8</id>"]
    assert len(got) == 9  # and one without content


def interchange(element, component, end, body):
    isa = element.join(["ISA", "00", " " * 10, "00", " " * 10, "ZZ", "SENDER".ljust(15), "ZZ", "RECEIVER".ljust(15), "240101", "1200", "^", "00501", "000000001", "0", "T", component]) + end
    assert len(isa) == feeds.ISA_CHARS
    return isa + end.join(s.replace("|", element) for s in body) + end


BODY = ["GS|BE|A|B|20240101|1200|1|X|005010X220A1", "ST|834|0001|005010X220A1", "INS|Y|18", "REF|0F|M1", "NM1|IL|1|DOE|JO||||34|900112222", "N3|1 OAK", "N4|AMES|IA|50010", "DMG|D8|19900102", "INS|Y|18", "NM1|IL|1|NOREF", "INS|Y|18", "REF|0F|M3", "SE|12|0001", "GE|1|1", "IEA|1|000000001"]


@pytest.mark.parametrize(("element", "component", "end"), [("*", ":", "~"), ("|", ">", "\n"), ("\x1d", ":", "\x1c"), ("*", ":", "'")])
def test_834_separators_come_from_the_interchange(spark, tmp_path, element, component, end):
    (tmp_path / "a.834").write_text(interchange(element, component, end, BODY), newline="")
    got = sorted(map(tuple, feeds.read_x12_834(spark, str(tmp_path / "a.834")).collect()))
    blank = ("",) * 6
    assert got == [("", "", "NOREF", *blank, "no REF*0F"), ("M1", "JO", "DOE", "19900102", "900112222", "1 OAK", "AMES", "IA", "50010", None), ("M3", "", "", *blank, "no NM1*IL")]


def test_834_trailers_that_count_otherwise_are_errors(spark, tmp_path):
    body = ["ST|834|1", "INS|Y", "REF|0F|M1", "NM1|IL|1|A|B", "SE|9|1", "ST|834|2", "INS|Y", "REF|0F|M2", "NM1|IL|1|A|B"]
    (tmp_path / "a.834").write_text(interchange("*", ":", "~", body))
    (tmp_path / "b.834").write_text(interchange("|", ":", "\n", ["GS|BE", "ST|834|1", "SE|2|1", "GE|2|1", "IEA|x|1"]), newline="")
    got = [r.parse_error for r in feeds.read_x12_834(spark, str(tmp_path)).collect()]
    assert sorted(x for x in got if x) == ["GE says 2, found 1", "IEA says x, found 1", "SE says 9, found 5", "ST without SE"] and got.count(None) == 2


def test_834_round_trip_in_three_styles(spark, sf, tmp_path):
    people = [(r.c_custkey, r.c_name.replace("#", " ")) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    for k, (element, component, end) in enumerate([("*", ":", "~"), ("|", ">", "\n"), ("\x1d", ":", "\x1c")]):
        body = ["GS|BE", "ST|834|1", *[s for i, n in people for s in ("INS|Y", f"REF|0F|{i}", f"NM1|IL|1|{n}|X")], f"SE|{3 * len(people) + 2}|1", "GE|1|1", "IEA|1|1"]
        (tmp_path / f"{k}.834").write_text(interchange(element, component, end, body), newline="")
    got = feeds.read_x12_834(spark, str(tmp_path)).collect()
    assert all(r.parse_error is None for r in got) and sorted((int(r.member_id), r.last_name) for r in got) == sorted(people * 3)


# pairs


def test_a_hot_block_is_compared_in_units(spark):
    rows = [(i, "hot" if i % 3 else f"b{i % 4}", i % 5 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b int")
    rules = [(["a"], None), (["b"], F.col("id") % 2 == 0)]
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and (x[1] == y[1] or (x[2] is not None and x[2] == y[2] and not x[0] % 2 and not y[0] % 2))}
    for unit in (1, 13, 1000):
        got = resolve.blocked_pairs(df, "id", rules, unit_rows=unit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    left, right = resolve.units(df.select(F.col("id").alias("uid"), "a"), ["a"], 20)
    met = left.join(right.withColumnRenamed("uid", "other"), ["a", "_i", "_j"]).groupBy("a", "_i", "_j").count().filter("a = 'hot'").toPandas()
    assert len(met) == 55 and met["count"].max() <= 40 * 40  # ten parts of about 20


def test_packs_of_a_common_row_stay_small(spark):
    df = spark.range(2000).select("id", (F.col("id") < 1900).alias("a"))
    met = resolve.met_packs(df, "id", [(["a"], None)], [])
    sizes = met.agg(F.max(F.size("uids_l")), F.max(F.size("uids_r"))).first()
    assert max(sizes) <= 128
    x = resolve.expanded(met)
    assert x.count() == x.distinct().count() == 1900 * 1899 // 2 + 100 * 99 // 2 and not x.filter("uid_l >= uid_r or (uid_l < 1900) <> (uid_r < 1900)").count()


def test_random_pairs_estimate_what_all_pairs_have(spark, sf):
    x = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("uid"), "o_orderstatus")
    n = [r["count"] for r in x.groupBy("o_orderstatus").count().collect()]
    p = sum(k * (k - 1) for k in n) / (sum(n) * (sum(n) - 1))
    share = lambda seed, rows=x: resolve.random_pairs(rows, "uid", 4000, seed).agg(F.avg((F.col("o_orderstatus_l") == F.col("o_orderstatus_r")).cast("int"))).first()[0]
    got = [share(s) for s in range(12)]
    sd = (p * (1 - p) / 4000) ** 0.5
    assert all(abs(g - p) < 5 * sd for g in got) and 0.4 * sd < (sum((g - p) ** 2 for g in got) / 12) ** 0.5 < 1.8 * sd
    assert share(3, x.repartition(7)) == got[3]  # whatever the partitions
    few = resolve.random_pairs(x.limit(9), "uid", 36).collect()
    assert len({(r.uid_l, r.uid_r) for r in few} | {(r.uid_r, r.uid_l) for r in few}) == 72
    assert resolve.random_pairs(x.limit(1), "uid").count() == resolve.random_pairs(x.limit(0), "uid").count() == 0


# chains and anchors


def test_a_chain_goes_on_from_its_head(spark, tmp_path):
    path = str(tmp_path / "c.jsonl")
    one = feeds.append_chain(path, [{"event_class": "X", "n": i, "text": "é" * 70000} for i in range(3)])
    two = feeds.append_chain(path, [{"event_class": "Y"}], head=one)
    assert audit.validate_log(spark, path, head=two) == {"valid": True, "entries_checked": 4, "first_broken": None, "reason": None}
    with pytest.raises(RuntimeError):
        feeds.append_chain(path, [{"event_class": "Z"}], head=one)
    assert feeds.append_chain(path, []) == two
    threads = [threading.Thread(target=feeds.append_chain, args=(path, [{"event_class": "T", "n": i}] * 5)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert audit.validate_log(spark, path)["entries_checked"] == 44 and audit.validate_log(spark, path)["valid"]


def entries(spark, n=600):
    rows, head = [], {}
    for i in range(n):
        chain = "ab"[i % 3 == 0]
        seq, prior = head.get(chain, (0, audit.GENESIS))
        own = f"{chain}{seq}"
        rows.append((chain, seq, f"2024-01-01 {i // 250:02d}:{i % 60:02d}:00", own, prior))
        head[chain] = (seq + 1, own)
    return spark.createDataFrame(rows, "chain string, seq long, t string, own string, prior string").withColumn("ts", F.col("t").cast("timestamp"))


def test_anchors_show_lost_added_changed_and_relinked_entries(spark):
    x = entries(spark).cache()
    made = F.concat("chain", F.col("seq").cast("string"))
    kept = anchors.anchors(x, ["chain"], "seq", "own", "prior", "ts").cache()
    check = lambda rows, made=made: {(r.chain, r.hour.hour): r.verdict for r in anchors.check_hours(rows, kept, ["chain"], "seq", "own", "prior", made, "ts").collect()}
    fine = check(x)
    assert set(fine.values()) == {"INTACT"} and len(fine) == 6 and anchors.follow(kept, ["chain"]).count() == 0
    hour = x.filter("chain = 'a' AND hour(ts) = 1").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    odd = lambda v: fine | {("a", 1): v}
    assert check(x.filter(f"NOT (chain = 'a' AND seq = {hour.b})")) == odd("LOST")  # the last entry of an hour
    assert check(x.filter("NOT (chain = 'a' AND hour(ts) = 1)")) == odd("LOST")
    assert check(x.unionByName(x.filter(f"chain = 'a' AND seq = {hour.a}"))) == odd("ADDED")
    assert check(x, F.when((F.col("chain") == "a") & (F.col("seq") == hour.a + 2), "zz").otherwise(made)) == odd("CHANGED")
    assert check(x.withColumn("prior", F.when((F.col("chain") == "a") & (F.col("seq") == hour.a + 1), "zz").otherwise(F.col("prior")))) == odd("RELINKED")
    assert [r.hour.hour for r in anchors.follow(kept.filter("NOT (chain = 'a' AND hour(hour) = 1)"), ["chain"]).collect()] == [2]


def test_a_proof_leads_to_the_root_of_what_was_anchored_alone(spark):
    x = entries(spark)
    nodes = anchors.tree(x, ["chain"], "seq", "own", "ts").cache()
    roots = anchors.anchors(x, ["chain"], "seq", "own", "prior", "ts").select("chain", "hour", "first_seq", "root")
    y = anchors.by_hour(x, "ts").join(roots, ["chain", "hour"]).withColumn("place", F.col("seq") - F.col("first_seq")).join(anchors.proofs(nodes, ["chain"]), ["chain", "hour", "place"])
    got = y.select(anchors.proves(F.col("own"), F.col("path"), F.col("root")).alias("a"), anchors.proves(F.concat("own", F.lit("x")), F.col("path"), F.col("root")).alias("b"), anchors.proves(F.col("own"), F.col("path"), F.lit("0")).alias("c"), F.size("path").alias("n")).collect()
    assert len(got) == 600 and all(r.a and not r.b and not r.c and 1 <= r.n <= 2 for r in got)


# change capture and profiles


def test_a_copy_follows_the_store_once_per_commit(spark, tmp_path):
    s, a = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "c"))
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, m map<string,int>")
    with s.transaction() as tx:
        tx.create("t", "k long, v string", ["k"], 4)
        tx.append("t", rows(*[(i, f"v{i}", None) for i in range(20)]))
    copy = capture.Copy(s, a, "t", ["k"])
    same = lambda: sorted(map(tuple, s.read("t").collect())) == sorted(map(tuple, a.read("t").collect()))
    assert copy.step() == 1 and same() and copy.step() == 1 and a.version() == 1
    files = dict((b, p) for p, b in a.files("t"))
    with s.transaction() as tx:
        own = tx.touched("t", rows((3, "", None)))
        x = tx.read("t", own).withColumn("v", F.when(F.col("k") == 3, None).otherwise(F.col("v")))
        tx.replace("t", x, own)
    assert copy.step() == 2 and same()
    assert [b for b, p in ((b, p) for p, b in a.files("t")) if files[b] != p] == own
    assert [tuple(r) for r in a.read("t_changes").filter("version = 2").select("k", "op", "row.v").collect()] == [(3, "U", None)]
    with s.transaction() as tx:
        tx.replace("t", tx.read("t").filter("k > 4").unionByName(rows((99, "new", None)).drop("m")))
    with pytest.raises(ZeroDivisionError), a.transaction() as tx:  # a step that dies
        tx.append("t", s.read("t"))
        1 / 0
    assert copy.offset() == 2 and copy.step() == 3 and same()
    assert {(r.k, r.op) for r in a.read("t_changes").filter("version = 3").collect()} == {(i, "D") for i in range(5)} | {(99, "I")}
    with s.transaction() as tx:
        tx.create("other", "x int")
    assert copy.step() == 4 and same() and a.read("t_changes").count() == 27


def test_profiles_of_days_merge_and_a_shifted_column_drifts(spark):
    x = spark.createDataFrame([(d, f"u{i % 40}", "" if i % 4 == 0 else None if i % 4 == 1 else "x") for d in range(5) for i in range(200)], "day int, u string, b string")
    got = {r.field: r for r in dq.merge_profiles(dq.sketch_profile(x.withColumn("p", F.lit("P")), ["u", "b"], ["p", "day"]), ["p"]).collect()}
    assert (got["u"]["count"], got["u"].null_count, got["u"].distinct_count) == (1000, 0, 40)
    assert (got["b"].null_count, got["b"].null_rate, got["b"].distinct_count) == (500, 0.5, 1)
    assert dq.merge_profiles(dq.sketch_profile(x.limit(0), ["u"], ["day"]), ["day"]).count() == 0
    was, same = dq.value_counts(x, ["u", "b"], []), dq.value_counts(x.filter("day < 2"), ["u", "b"], [])
    quiet = {r.field: r for r in dq.distribution_drift(was, same, ["field"]).collect()}
    assert all(abs(r.psi) < 1e-9 and abs(r.js) < 1e-9 for r in quiet.values())
    shifted = dq.value_counts(x.withColumn("u", F.when(F.col("u") < "u3", "new").otherwise(F.col("u"))), ["u", "b"], [])
    loud = {r.field: r for r in dq.distribution_drift(was, shifted, ["field"]).collect()}
    assert loud["u"].psi > 0.25 and 0.1 < loud["u"].js <= 1 and abs(loud["b"].psi) < 1e-9
    apart = dq.distribution_drift(dq.value_counts(x, ["u"], []), dq.value_counts(x.withColumn("u", F.lit("z")), ["u"], []), ["field"]).first()
    assert apart.js == pytest.approx(1.0)


# rules


def test_rules_are_read_and_refused():
    r = rules.parse_rules("comparisons: [{column: a, levels: [exact, {prefix: 2, levenshtein: 1}, else]}]\nblocking: [[a]]")
    assert r.comparisons[0].m == pytest.approx((0.95, 0.025, 0.025)) and r.comparisons[0].u is None and (r.high, r.low) == (20.0, -18.0)
    for bad in ("levels: [exact]", "levels: [exact, {sounds: 1}, else]", "levels: [exact, else], m: [0.5]", "levels: [exact, else], u: [0.9, 0.0]", "levels: [else, exact]"):
        with pytest.raises(ValueError):
            rules.parse_rules(f"comparisons: [{{column: a, {bad}}}]\nblocking: [[a]]")
    with pytest.raises(ValueError):
        rules.parse_rules("comparisons: [{column: a, levels: [exact, else]}]\nblocking: [[a]]\nprior: 1")


def test_another_rule_set_needs_no_code(spark):
    rows = [(1, "anna", 10.0, "x"), (2, "anne", 10.5, "x"), (3, "bob", 100.0, "x"), (4, "anna", None, "y"), (5, None, 10.0, "x"), (6, "anna", 99.0, "y")]
    df = spark.createDataFrame(rows, "uid int, name string, amount double, block string")
    r = rules.parse_rules("""
comparisons:
  - {column: name, levels: [exact, {jaro_winkler: 0.8}, else]}
  - {column: amount, levels: [exact, {difference: 1}, {relative: 0.05}, else], u: [0.1, 0.1, 0.1, 0.7]}
blocking: [[block], {equal: [name], where: "amount > 5"}]
""")
    got = {(x.uid_l, x.uid_r): (x.gamma_name, x.gamma_amount) for x in r.score(df).collect()}
    assert got == {(1, 2): (1, 2), (1, 3): (0, 0), (1, 5): (0, 3), (2, 3): (0, 0), (2, 5): (0, 2), (3, 5): (0, 0), (4, 6): (2, 0), (1, 6): (2, 0)}
    u = r.chances(df)  # all 15 pairs: 3 have equal names, 3 like ones
    assert u["name"] == pytest.approx((3 / 15, 3 / 15, 9 / 15)) and u["amount"] == (0.1, 0.1, 0.1, 0.7)
    weight = {(x.uid_l, x.uid_r): x.match_weight for x in r.score(df).collect()}
    assert weight[1, 2] == pytest.approx(math.log2(1e-4 / (1 - 1e-4)) + math.log2(0.025 / 0.2) + math.log2(0.05 / 3 / 0.1))


# streams


def test_shuffled_batches_lock_as_the_times_say(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, 1_704_067_200 + r.randrange(3 * 86_400), i) for i, k in enumerate(r.choice([1, 2, 3]) for _ in range(90))]
    rows = [(k, t, i, i % 4 != 0, i % 9 == 0) for k, t, i in rows]
    r.shuffle(rows)
    last = max(x[1] for x in rows)
    batches = [rows[:30], rows[30:60], rows[60:], [(9, last + 40 * 86_400, 900, False, False)], [(9, last + 90 * 86_400, 901, False, False)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    schema = "anchor long, t long, attempt_id long, failed boolean, succeeded boolean"
    try:
        for i, b in enumerate(batches):
            path = str(tmp_path / "in")
            spark.createDataFrame(b, schema).select("anchor", F.timestamp_seconds("t").alias("ts"), "attempt_id", "failed", "succeeded").coalesce(1).write.mode("append").parquet(path)
            out = timed.timed_lockout(spark.readStream.schema("anchor long, ts timestamp, attempt_id long, failed boolean, succeeded boolean").parquet(path), "30 days")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = {x.attempt_id: (x.failures, x.locked) for x in spark.read.parquet(str(tmp_path / "out")).filter("attempt_id < 900").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {}
    for k in (1, 2, 3):
        stamps, locked = [], False
        for _, t, i, failed, succeeded in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            stamps, now, found = lockout.step(stamps, locked, t * 1_000_000, failed, succeeded, lockout.WINDOW_HOURS, lockout.FAILURES)
            want[i], locked = (len(stamps), found), now
    assert got == want and any(f for _, f in want.values())


# stages, conflicts, replays


def test_a_stage_takes_each_event_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    with s.transaction() as tx:
        tx.create("out", "id int")
    with stages.taking(s, "a", ids(spark, 1, 2, 2, None), "id") as (tx, fresh):
        tx.append("out", fresh)
    with pytest.raises(ZeroDivisionError), stages.taking(s, "a", ids(spark, 2, 3), "id") as (tx, fresh):
        tx.append("out", fresh)
        1 / 0
    with stages.taking(s, "a", ids(spark, 2, 3), "id") as (tx, fresh):
        tx.append("out", fresh)
    assert sorted(r.id for r in s.read("out").collect()) == [1, 2, 3]
    with stages.taking(s, "b", ids(spark, 1), "id") as (_, fresh):
        assert fresh.count() == 1


def test_conflicts_are_reviewed_and_hold_merges_back(spark):
    rows = [("a", 1, None, "x"), ("a", 2, "s1", "x"), ("a", 3, "s2", "x"), ("a", 4, "s2", None), ("a", 5, "s3", "x"), ("b", 1, "s1", "y"), ("b", 2, "s1", "y"), ("c", 1, None, None)]
    x = store.identity_conflicts(spark.createDataFrame(rows, "uid string, t int, ssn string, dob string"), ["uid"], ["t"], ["ssn", "dob"])
    got = x.collect()
    assert sorted((r.uid, r.attribute, r.kept, r.proposed, r.times) for r in got) == [("a", "ssn", "s1", "s2", 2), ("a", "ssn", "s1", "s3", 1)] and len({r.queue_id for r in got}) == 2
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "uid_l string, uid_r string")
    assert [tuple(r) for r in store.without_conflicts(edges, x, "uid").collect()] == [("b", "c")]


def test_a_replay_fills_a_parallel_version(spark, tmp_path):
    v = store.VersionedTable(spark, str(tmp_path / "v"))
    v.publish(ids(spark, 1, 2), 1)
    same = lambda new, old: new.count() == old.count()
    assert v.replay(lambda: ids(spark, 1), same) == 1 and v.current() == 1 and v.read().count() == 2
    assert v.replay(lambda: ids(spark, 7, 8), same) == 3 and sorted(r.id for r in v.read().collect()) == [7, 8] and v.read(2).count() == 1
