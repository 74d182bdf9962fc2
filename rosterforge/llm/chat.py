r"""Chat formatting of reply trees.

Trees are rows (tree, node, parent, role, text, score). Root-to-leaf paths come from iterative self-joins: every leaf knows
the nodes found so far with their distance; each round joins them with the jump table (node to its 2**k-th
ancestor) and joins the jump table with itself, so that depth d takes log2(d) rounds. Branches are ranked by the sum of
their scores (ties: the least leaf), the best `top` of a tree are chosen, and each chosen path becomes one conversation.

A turn is written as "### role ###\n", the text, "\n</turn>\n". Inside roles and texts a backslash stands before each \,
< and #, so neither control string can occur in them; taking the backslashes away gives the text back.
The loss mask lists the spans (code points, from 0) of the assistant's texts in the formatted string.

Null roles and texts are empty, null scores 0. A node whose parent is null or isn't in its tree is a root. Nodes of a cycle
have no root, so no path reaches them: they are reported by cycles(). Rows repeated with one (tree, node) count once,
the one of least role and text. An empty table gives no conversations; rows with a null tree form one tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

TURN_END = "\n</turn>\n"
MARK = "###"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\<#])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\<#])", "$1")


def root_paths(nodes: DataFrame, top: int = 1, most_rounds: int = 40) -> DataFrame:
    """(tree, leaf, rank, depth, node, role, text) of the chosen branches; depth counts from the root, 0."""
    tmp = Scratch(nodes.sparkSession, "paths")
    same = W.partitionBy("tree", "node").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    own = nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")).withColumn("_k", F.row_number().over(same)).filter("_k = 1").drop("_k")
    own = tmp.write(own, "nodes")
    narrow = own.select("tree", "node", "parent", "score")
    known = narrow.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = narrow.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))).select("tree", F.col("node").alias("low"), F.col("parent").alias("high")).filter("low <> high")
    jump = tmp.write(up, "jump0")
    parents = jump.select(F.col("tree").alias("t"), F.col("high").alias("n")).distinct()
    leaves = narrow.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    paths = tmp.write(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "paths0")
    for k in range(most_rounds):
        step = jump.select(F.col("tree").alias("t"), "low", "high")
        more = paths.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("low"))).select("tree", "leaf", F.col("high").alias("node"), (F.col("above") + 2**k).alias("above"))
        more = tmp.write(more, f"more{k}")
        if more.isEmpty():
            break
        paths = paths.unionByName(more)
        nxt = jump.join(step.select("t", F.col("low").alias("mid"), F.col("high").alias("far")), F.col("tree").eqNullSafe(F.col("t")) & (F.col("high") == F.col("mid")))
        jump = tmp.write(nxt.select("tree", "low", F.col("far").alias("high")).filter("low <> high"), f"jump{k + 1}")
    key = lambda a, b: a.tree.eqNullSafe(b["t"])
    scores = own.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    if top > 0:
        sums = paths.join(scores, key(paths, scores) & (paths.node == scores.n)).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
        rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("branch_score"), F.asc_nulls_first("leaf")))
        best = tmp.write(sums.withColumn("rank", rank).filter(F.col("rank") <= top), "best").select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank", "branch_score")
        paths = paths.join(best, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).drop("t", "l")
    texts = own.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n")


def cycles(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, node) that no path of root_paths(top=all) holds."""
    held = root_paths(nodes, top=2**31 - 1).select("tree", "node").distinct()
    return nodes.select("tree", "node").distinct().exceptAll(held)


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_mask): one string per chosen path."""
    turn = F.struct((-F.col("above")).alias("order"), F.col("role"), F.col("text"), F.concat(F.lit(MARK + " "), escape(F.col("role")), F.lit(f" {MARK}\n")).alias("head"), escape(F.col("text")).alias("body"))
    x = paths.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(t["head"], t["body"], F.lit(TURN_END))))
    kept = F.array().cast("array<struct<start:long,length:long>>")
    mask = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), kept.alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(TURN_END)).alias("at"),
            F.when(F.coalesce(t["role"] == "assistant", F.lit(False)), F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return x.select("tree", "leaf", "rank", F.array_join(pieces, "").alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with turns array<struct<role, text>> and loss_text, both read back from string and mask."""
    pieces = F.split(F.col("formatted"), TURN_END)
    # What stands after the last end mark is empty.
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.substr(F.substring_index(p, f" {MARK}\n", 1), F.lit(len(MARK) + 2))).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, f" {MARK}\n", 1)) + len(MARK) + 3)).alias("text")),
    )
    loss = F.array_join(F.transform("loss_mask", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    return formatted.withColumns({"turns": turns, "loss_text": unescape(loss)})


def linear(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: each row replies to the one before it (ties: by role and text)."""
    w = W.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    x = rows.select(F.col(tree).alias("tree"), F.row_number().over(w).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return x.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
