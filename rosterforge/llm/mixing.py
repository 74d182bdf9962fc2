"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves are (domain, language, source). A token budget goes down the tree: at each node the children share it by
weight, and a child that has less than its share gives the shortage to its siblings before anything reaches an
ancestor's siblings, since a node never gets more than its whole subtree holds. Sharing is exact water-filling:
children sorted by capacity per weight are filled one after another while they are smaller than their share of the rest.

Each leaf then takes whole seeded epochs and, of the last one, the prefix of documents whose running token count
stays within what is left. The order of an epoch is the md5 of seed, epoch and id. Running counts come from sums
over hash ranges of a leaf and then inside one range, so a leaf with a third of all rows is spread over many tasks.

A token is a run of anything but white space. Null texts have none and are never taken. Null domain, language or source
count as the value "". Repeated rows are documents of their own. Rows of one id, and rows of no id, have one place in the order each. An empty table or a budget of 0 gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

LEVELS = ("domain", "language", "source")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight(level: str, weights: Mapping[str, float], default: float) -> Column:
    """A node's weight among its siblings."""
    if not weights:
        return F.lit(float(default))
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(float(default)))


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-filling among siblings: nodes with w, cap and the parent's budget b get `got`.

    In the order of cap / w, the level at a node is what the nodes before it leave, per weight of the rest.
    """
    order = W.partitionBy(*parent).orderBy("_need", *[c for c in LEVELS if c in nodes.columns])
    whole = W.partitionBy(*parent)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    x = nodes.withColumn("_need", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    x = x.withColumns({"_used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    level = F.when(F.col("_w") > 0, F.greatest(F.col("b") - F.col("_used"), F.lit(0.0)) / F.col("_w")).otherwise(F.lit(0.0))
    # The level rises as nodes are filled and falls once a node that can't be filled is taken for full: the peak holds.
    x = x.withColumn("_level", F.max(level).over(whole))
    got = F.when(F.col("w") <= 0, F.lit(0.0)).otherwise(F.least(F.col("cap"), F.col("_level") * F.col("w")))
    return x.withColumn("got", got).drop("_need", "_used", "_w", "_level")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, float]], defaults: Mapping[str, float], max_epochs: int) -> DataFrame:
    """leaves (domain, language, source, leaf_tokens, leaf_docs) with `allot`, the tokens that each may give."""
    x = leaves.withColumn("cap", F.col("leaf_tokens") * F.lit(float(max_epochs)))
    for i, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: i + 1]), list(LEVELS[:i])
        nodes = x.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level, weights.get(level, {}), defaults.get(level, 1.0)))
        if parent:
            nodes = nodes.join(above, parent)  # noqa: F821
        else:
            nodes = nodes.withColumn("b", budget)
        above = share(nodes, parent or [F.lit(0)]).select(*keys, F.col("got").alias("b"))
    return leaves.join(above.withColumnRenamed("b", "_b"), list(LEVELS)).withColumn("allot", F.floor(F.col("_b") + 1e-6).cast("long")).drop("_b")


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def mix(docs: DataFrame, domain: Column, budget_share: float, weights: Mapping[str, Mapping[str, float]], defaults: Mapping[str, float] | None = None, seed: int = 11, max_epochs: int = 2, range_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and epoch that is taken: id, domain, language, source, n_tokens, epoch, order key.

    carry: columns of docs that follow, and that order rows of equal id and tokens; without them rows of one id can't be told apart.
    budget_share: the budget as a part of all tokens of the corpus; max_epochs: how often a document may be taken at most.
    """
    tmp = Scratch(docs.sparkSession, "mix")
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text(domain).alias("domain"), text(F.col(lang_col)).alias("language"), text(F.col(source_col)).alias("source"), tokens(F.col(text_col)).alias("n_tokens"), *carry).filter("n_tokens > 0")
    rows = tmp.write(rows, "rows")
    leaves = tmp.write(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_docs")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, F.floor(F.lit(total) * F.lit(float(budget_share))).cast("double"), weights, defaults or {}, max_epochs)
    full = F.least(F.floor(F.col("allot") / F.col("leaf_tokens")), F.lit(max_epochs)).cast("int")
    plan = plan.select(*LEVELS, full.alias("full"), (F.col("allot") - full * F.col("leaf_tokens")).alias("rest"), F.ceil(F.col("leaf_docs") / range_rows).cast("long").alias("ranges"))
    plan = tmp.write(plan, "plan")

    joined = rows.join(plan, list(LEVELS))
    whole = joined.filter("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full - 1)"))).withColumn("order_key", epoch_key(seed, F.col("epoch"), F.col("id")))
    last = joined.filter("rest > 0").withColumn("epoch", F.col("full")).withColumn("order_key", epoch_key(seed, F.col("epoch"), F.col("id")))
    spot = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    last = last.withColumn("range", F.floor(spot * F.col("ranges") / F.lit(float(2**32))).cast("long"))
    last = tmp.write(last, "last")
    sums = last.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("_n"))
    sums = sums.withColumn("before", F.sum("_n").over(W.partitionBy(*LEVELS).orderBy("range")) - F.col("_n"))
    sums = tmp.write(sums.drop("_n"), "sums")
    inner = W.partitionBy(*LEVELS, "range").orderBy("order_key", F.col("id").asc_nulls_first(), "n_tokens", *carry).rowsBetween(W.unboundedPreceding, 0)
    prefix = last.join(sums, [*LEVELS, "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).filter("upto <= rest")
    cols = ["id", *LEVELS, "n_tokens", "epoch", "order_key", *carry]
    return whole.select(cols).unionByName(prefix.select(cols)).withColumnRenamed("id", id_col)
