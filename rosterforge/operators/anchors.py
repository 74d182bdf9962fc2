"""Hourly anchors of audit chains: a hash tree over an hour's entries, so that a check reads that hour and its anchor alone.

Entries of a chain are numbered without gaps (seq). The leaves of an hour's tree are the hashes of its entries in order; a node is
the hash of FAN nodes below it, the last of a level of fewer. A tree is made level by level, each a grouping by the place divided by FAN,
so no task sees more than FAN hashes of a group, and an hour of n entries takes log n levels. The anchor keeps the root, the number
of entries, the first number, and the hashes before and at the end. Kept where the log's writer can't change it, it shows lost, added
and changed entries, and a proof of a few hashes shows that an entry is among those that were anchored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .audit import GENESIS

FAN = 16
HOUR = "hour"


def leaf_hash(own: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), own).cast("binary"), 256)


def node_hash(below: Column) -> Column:
    """Of an array of hashes in order."""
    return F.sha2(F.concat(F.lit("node:"), F.array_join(below, ",")).cast("binary"), 256)


def by_hour(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn(HOUR, F.date_trunc("hour", F.col(ts)))


def tree(rows: DataFrame, chain: list[str], seq: str, own: str, ts: str) -> DataFrame:
    """(chain, hour, level, place, h): all nodes of each hour's tree; level 0 has the leaves, the highest level of an hour its root."""
    tmp, key = Scratch(rows.sparkSession, "tree"), [*chain, HOUR]
    x = by_hour(rows, ts)
    first = x.groupBy(*key).agg(F.min(seq).alias("_first"))
    x = x.join(first, key).select(*key, F.lit(0).alias("level"), (F.col(seq) - F.col("_first")).cast("long").alias("place"), leaf_hash(F.col(own)).alias("h"))
    level = tmp.write(x, "level0")
    out, most, k = level, level.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0], 0
    while most > 0:
        most, k = most // FAN, k + 1
        several = level.groupBy(*key).agg(F.max("place").alias("_last")).filter("_last > 0").drop("_last")  # other trees are done
        up = level.join(several, key).groupBy(*key, F.floor(F.col("place") / FAN).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("_below"))  # FAN at most
        level = tmp.write(up.select(*key, F.lit(k).alias("level"), F.col("_up").cast("long").alias("place"), node_hash(F.col("_below.h")).alias("h")), f"level{k}")
        out = out.unionByName(level)
    return out


def anchors(rows: DataFrame, chain: list[str], seq: str, own: str, prior: str, ts: str) -> DataFrame:
    """(chain, hour, first_seq, n, first_prior, last_hash, root) of the hours of rows."""
    key = [*chain, HOUR]
    ends = by_hour(rows, ts).groupBy(*key).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n"), F.min_by(prior, seq).alias("first_prior"), F.max_by(own, seq).alias("last_hash"))
    roots = tree(rows, chain, seq, own, ts).groupBy(*key).agg(F.max_by("h", "level").alias("root"))
    return ends.join(roots, key)


def check_hours(rows: DataFrame, kept: DataFrame, chain: list[str], seq: str, own: str, prior: str, made: Column, ts: str) -> DataFrame:
    """(chain, hour, verdict): the entries of some hours against the anchors of these hours.

    rows: entries of the hours to check, and no others; made: an entry's hash made anew. LOST: fewer entries than anchored, or none;
    ADDED: more, or an hour without an anchor; CHANGED: another root, or an entry that isn't what its hash says; RELINKED: an entry or
    the hour doesn't follow what stood before it. INTACT otherwise.
    """
    key = [*chain, HOUR]
    x = rows.withColumn("_made", made)
    now = anchors(x, chain, seq, "_made", prior, ts).select(*key, F.col("n").alias("_n"), F.col("first_prior").alias("_prior"), F.col("root").alias("_root"))
    # An entry is held against the one before it by its number, not by gathering a chain.
    before = x.select(*chain, (F.col(seq) + 1).alias(seq), F.col(own).alias("_before"))
    links = by_hour(x, ts).join(before, [*chain, seq], "left").groupBy(*key).agg(
        F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col(prior))).alias("_unlinked"), F.count_if(~F.col("_made").eqNullSafe(F.col(own))).alias("_wrong")
    )
    y = kept.join(now, key, "full").join(links, key, "left")
    lost = F.col("_n").isNull() | (F.col("_n") < F.col("n"))
    verdict = F.when(F.col("n").isNull() | (F.col("_n") > F.col("n")), "ADDED").when(lost, "LOST").when((F.col("_root") != F.col("root")) | (F.col("_wrong") > 0), "CHANGED")
    return y.select(*key, verdict.when((F.col("_unlinked") > 0) | (F.col("_prior") != F.col("first_prior")), "RELINKED").otherwise("INTACT").alias("verdict"))


def follow(kept: DataFrame, chain: list[str]) -> DataFrame:
    """Anchors that don't follow the one before: (chain, hour). A row per hour, so a chain's anchors are few."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*chain).orderBy(HOUR)
    x = kept.withColumns({"_hash": F.coalesce(F.lag("last_hash").over(w), F.lit(GENESIS)), "_next": F.coalesce(F.lag(F.col("first_seq") + F.col("n")).over(w), F.col("first_seq"))})
    return x.filter((F.col("_hash") != F.col("first_prior")) | (F.col("_next") != F.col("first_seq"))).select(*chain, HOUR)


PATH = "array<struct<level:int,index:int,nodes:array<string>>>"


def group_paths(nodes: DataFrame, chain: list[str]) -> DataFrame:
    """(chain, hour, _up, _nodes, _above): for each FAN leaves of trees, their hashes in order and the steps above them to the root.

    Paths are made from the root down, a level at a time, for groups of FAN nodes: what leaves share is made and sent once.
    """
    tmp, key = Scratch(nodes.sparkSession, "paths"), [*chain, HOUR]
    groups = nodes.groupBy(*key, "level", F.floor(F.col("place") / FAN).cast("long").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("_s"))  # FAN at most
    tops = nodes.groupBy(*key).agg(F.max("level").alias("_top"))
    # A root stands in no step, unless it is the only leaf.
    groups = tmp.write(groups.join(tops, key).filter("level < _top OR _top = 0").select(*key, "level", "_up", F.col("_s.h").alias("_nodes"), "_top"), "groups")
    none, above, k = F.array().cast(PATH), None, groups.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    while True:
        x = groups.filter(F.col("level") == k).withColumn("_to", F.floor(F.col("_up") / FAN).cast("long"))
        own = x.select(*key, "_up", "_nodes", "_top", "_to")
        if above is None:
            paths = own.withColumn("_above", none)
        else:
            step = F.struct(F.lit(k + 1).alias("level"), (F.col("_up") % FAN).cast("int").alias("index"), F.col("_over").alias("nodes"))
            over = above.select(*key, F.col("_up").alias("_to"), F.col("_nodes").alias("_over"), F.col("_above").alias("_rest"))
            paths = own.join(over, [*key, "_to"], "left").withColumn("_above", F.when(F.col("_over").isNull(), none).otherwise(F.concat(F.array(step), "_rest"))).drop("_over", "_rest")
        if k == 0:
            return paths.select(*key, "_up", F.when(F.col("_top") > 0, F.col("_nodes")).alias("_nodes"), "_above")
        above, k = tmp.write(paths.drop("_top", "_to"), f"paths{k}"), k - 1


def with_paths(entries: DataFrame, nodes: DataFrame, chain: list[str]) -> DataFrame:
    """entries (chain, hour, place) that have a leaf, with their path: they meet the path of their FAN leaves, and no path is shuffled for each."""
    x = entries.withColumn("_up", F.floor(F.col("place") / FAN).cast("long")).join(group_paths(nodes, chain), [*chain, HOUR, "_up"])
    step = F.struct(F.lit(0).alias("level"), (F.col("place") % FAN).cast("int").alias("index"), F.col("_nodes").alias("nodes"))
    path = F.when(F.col("_nodes").isNull(), F.array().cast(PATH)).otherwise(F.concat(F.array(step), "_above"))
    return x.withColumn("path", path).drop("_up", "_nodes", "_above")


def proofs(nodes: DataFrame, chain: list[str]) -> DataFrame:
    """(chain, hour, place, path): for each leaf of trees the hashes that lead from it to the root: per level its place among FAN nodes, and these."""
    return with_paths(nodes.filter("level = 0").select(*chain, HOUR, "place"), nodes, chain)


def proves(own: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from an entry's hash to a root."""
    start = F.struct(leaf_hash(own).alias("h"), F.lit(True).alias("ok"))
    up = lambda acc, s: F.struct(node_hash(s["nodes"]).alias("h"), (acc["ok"] & F.coalesce(F.get(s["nodes"], s["index"]) == acc["h"], F.lit(False))).alias("ok"))
    end = F.aggregate(path, start, up)
    return end["ok"] & (end["h"] == root)
