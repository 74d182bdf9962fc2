"""Last record wins inside a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column], dedup_blank_keys: bool = True) -> DataFrame:
    """One row per key, the last by `order`. Blank keys collapse too unless dedup_blank_keys is False."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    if dedup_blank_keys:
        return rows.withColumn("_k", rank).filter("_k = 1").drop("_k")
    blank = F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == ""
    return rows.filter(~blank).withColumn("_k", rank).filter("_k = 1").drop("_k").unionByName(rows.filter(blank))


def complete_then_last(rows: DataFrame, required: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose required fields are all there, and of these the last of each key: if the last duplicate is bad, one before it wins."""
    for c in required:
        rows = rows.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return last_wins(rows, keys, order)


def label_status(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows with dup_count and dedup_status DEDUP_WINNER, DEDUP_LOSER or UNIQUE."""
    w = W.partitionBy(*keys)
    x = rows.withColumns({"dup_count": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(*[c.desc() for c in order]))})
    return x.withColumn("dedup_status", F.when(F.col("dup_count") == 1, "UNIQUE").when(F.col("_k") == 1, "DEDUP_WINNER").otherwise("DEDUP_LOSER")).drop("_k")


def audit_winners(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One event per winner of a group of several, with its context as JSON."""
    x = label_status(rows, keys, order).filter("dedup_status = 'DEDUP_WINNER'")
    return x.select(F.lit("WITHIN_FEED_DEDUP").alias("event_class"), *keys, "dup_count", F.to_json(F.struct(*keys, "dup_count")).alias("context"))
