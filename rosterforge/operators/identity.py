"""Merging and unmerging stored members: which members become one, and what a member falls apart into when an edge is cut.

A member is a component of records over edges that were scored, or ruled by a reviewer. Both operations look at the members that
they concern and at nothing else (all sides of their joins grow with these, and are merged, never broadcast): a merge joins members as nodes of a small graph of rulings, a split walks over the records and
edges of the members that lose an edge. Neither lists a group's records in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import uuid5
from .resolve import components


def ruled_members(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(member_l, member_r) of edges (uid_l, uid_r) between records (uid, member_id) of two members. Unknown records are left out."""
    of = lambda s: records.select(F.col("uid").alias(f"uid_{s}"), F.col("member_id").alias(f"member_{s}"))
    return edges.select("uid_l", "uid_r").join(of("l").hint("merge"), "uid_l").join(of("r").hint("merge"), "uid_r").filter("member_l <> member_r").select("member_l", "member_r").distinct()


def merge_moves(records: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(member_id, survivor): the members that edges between records join to another one.

    records: uid, member_id; members: member_id, state, first_seen_at. Members that are deleted take no part. The member that was seen
    first survives, of several the one of the least id; chains of rulings end at one survivor.
    """
    live = members.filter("state <> 'DELETED'").select("member_id", "first_seen_at")
    known = records.join(live.select("member_id").hint("merge"), "member_id", "left_semi")
    pairs = ruled_members(known, edges).select(F.col("member_l").alias("uid_l"), F.col("member_r").alias("uid_r"))
    nodes = pairs.select(F.col("uid_l").alias("uid")).unionByName(pairs.select(F.col("uid_r").alias("uid"))).distinct()
    own = components(nodes, pairs).select(F.col("uid").alias("member_id"), "component").join(live.hint("merge"), "member_id")
    first = own.groupBy("component").agg(F.min(F.struct("first_seen_at", "member_id")).alias("_first"))
    return own.join(first.hint("merge"), "component").select("member_id", F.col("_first.member_id").alias("survivor")).filter("member_id <> survivor")


def split_moves(records: DataFrame, edges: DataFrame, cut: DataFrame) -> DataFrame:
    """(uid, member_id, new_member_id): the records that leave their member when the edges of cut (uid_l, uid_r) are gone.

    records: uid, member_id, born_as (the member that the record came to first). Of the parts of a member the one with most records that
    were born as it keeps its id, then the largest, then that of the least uid. A part whose records were all born as one
    other member gets that member's id back; other parts get an id of their own. A cut that leaves the member in one piece
    moves nothing.
    """
    ends = cut.select(F.explode(F.array("uid_l", "uid_r")).alias("uid")).distinct()
    hit = records.join(ends.hint("merge"), "uid", "left_semi").select("member_id").distinct()
    own = records.join(hit.hint("merge"), "member_id", "left_semi").select("uid", "member_id", "born_as")
    both = cut.select("uid_l", "uid_r").unionByName(cut.select(F.col("uid_r").alias("uid_l"), F.col("uid_l").alias("uid_r")))
    of = lambda s: own.select(F.col("uid").alias(f"uid_{s}"), F.col("member_id").alias(f"member_{s}"))
    inside = edges.select("uid_l", "uid_r").join(of("l").hint("merge"), "uid_l").join(of("r").hint("merge"), "uid_r").filter("member_l = member_r").join(both.hint("merge"), ["uid_l", "uid_r"], "left_anti")
    x = own.join(components(own.select("uid"), inside.select("uid_l", "uid_r")).hint("merge"), "uid")
    parts = x.groupBy("member_id", "component").agg(
        F.count_if(F.col("born_as") == F.col("member_id")).alias("_born"), F.count(F.lit(1)).alias("_n"), F.min("uid").alias("_least"), F.min("born_as").alias("_a"), F.max("born_as").alias("_b")
    )
    parts = parts.withColumn("_k", F.row_number().over(W.partitionBy("member_id").orderBy(F.desc("_born"), F.desc("_n"), "_least")))
    back = (F.col("_a") == F.col("_b")) & (F.col("_a") != F.col("member_id"))
    parts = parts.filter("_k > 1").withColumn("_back", F.when(back, F.col("_a")))
    parts = parts.withColumn("_of", F.row_number().over(W.partitionBy("_back").orderBy(F.desc("_n"), "_least")))
    new = F.when(F.col("_back").isNotNull() & (F.col("_of") == 1), F.col("_back")).otherwise(uuid5(F.concat_ws("|", F.lit("split"), "member_id", "_least")))
    return x.join(parts.select("component", new.alias("new_member_id")).hint("merge"), "component").select("uid", "member_id", "new_member_id")
