"""Stages that take each event once: the keys that a stage has taken are committed together with what it made of them.

A stage's keys lie in a bucketed table of the store, so a delivery reads the buckets of its own keys. An event that comes again, in the same
delivery or a later one, or after a stage died before its commit, has its effect once; stages don't see each other's keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .snapshots import Snapshots, Transaction

TABLE = "taken"


def prepare(store: Snapshots, buckets: int = 16) -> None:
    if TABLE not in store.manifest()["tables"]:
        with store.transaction() as tx:
            tx.create(TABLE, "event_key string, stage string", ["event_key"], buckets)


@contextmanager
def taking(store: Snapshots, stage: str, incoming: DataFrame, key: str) -> Iterator[tuple[Transaction, DataFrame]]:
    """The transaction to write results to, and the rows of incoming whose key the stage hasn't taken, one for each key.

    Rows without a key can't be told apart and are left out.
    """
    prepare(store)
    with store.transaction() as tx:
        x = incoming.filter(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")).dropDuplicates(["_key"])
        own = tx.touched(TABLE, x.select(F.col("_key").alias("event_key")))
        taken = tx.read(TABLE, own).filter(F.col("stage") == stage).select(F.col("event_key").alias("_key"))
        fresh = Scratch(store.spark, "stage").write(x.join(taken, "_key", "left_anti"), "fresh")
        yield tx, fresh.drop("_key")
        tx.append(TABLE, fresh.select(F.col("_key").alias("event_key"), F.lit(stage).alias("stage")))
