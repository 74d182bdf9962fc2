"""A history that is kept up batch by batch: only the buckets of the keys that a batch names are read and written again.

The table holds every change point of a key, also those that repeat the state before them, as a late row may come between:
effective, state, arrival and tie (of one key and day the last to arrive counts, of those the greatest tie), `opens` (the state is another
than before) and `effective_to` (where the period that it opens ends). A batch's rows are spliced into the points of their keys; the
neighbours' `opens` and ends follow from that. So the history equals the rebuild from all rows, in whatever order they came,
and late rows cost no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots

POINT = ("effective", "state", "arrival", "tie")


def splice(points: DataFrame, key: list[str]) -> DataFrame:
    """Points (key, effective, state, arrival, tie) with one left for each key and day, and what each opens."""
    last = W.partitionBy(*key, "effective").orderBy(F.desc("arrival"), F.desc("tie"), F.desc("state"))
    x = points.select(*key, *POINT).withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    w = W.partitionBy(*key).orderBy("effective")
    x = x.withColumn("opens", (F.row_number().over(w) == 1) | ~F.col("state").eqNullSafe(F.lag("state").over(w)))
    after = F.first(F.when(F.col("opens"), F.col("effective")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return x.withColumn("effective_to", F.when(F.col("opens"), after))


@dataclass
class History:
    """The history `table` of a store; key: its columns; schema: of the key and the points, as DDL."""

    store: Snapshots
    table: str
    key: list[str]
    schema: str
    buckets: int = 16

    def __post_init__(self) -> None:
        if self.table not in self.store.manifest()["tables"]:
            with self.store.transaction() as tx:
                tx.create(self.table, f"{self.schema}, opens boolean, effective_to date", self.key, self.buckets)

    def merge(self, changes: DataFrame) -> list[int]:
        """Splice a batch of rows (key, effective, state, arrival, tie) in, in one commit. The buckets that were written again."""
        with self.store.transaction() as tx:
            own = tx.touched(self.table, changes)
            if own:
                old = tx.read(self.table, own)
                keys = changes.select(*[F.col(k).alias(f"_{k}") for k in self.key]).distinct()
                same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
                rest = old.join(keys, same, "left_anti")
                points = old.join(keys, same, "left_semi").select(*self.key, *POINT).unionByName(changes.select(*self.key, *POINT))
                tx.replace(self.table, rest.unionByName(splice(points, self.key)), own)
        return own

    def periods(self, version: int | None = None) -> DataFrame:
        """(key, state, effective_from, effective_to)"""
        x = self.store.read(self.table, version).filter("opens")
        return x.select(*self.key, "state", F.col("effective").alias("effective_from"), "effective_to")
