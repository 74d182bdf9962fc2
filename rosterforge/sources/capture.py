"""Change capture: an analytical copy that follows a table of the store by numbered changes, each applied once.

The copy's folder has its own log of commits. A step looks at what the store has committed since the version that the copy stands for:
tables name their files, so only the buckets whose files are others are read, old and new. What differs there by key is the
changes: I (inserted), U (updated) and D (deleted), with the row as it is now. They are numbered by the store's version, added to the copy's change
log, and put into the copy's table, together with the new version, in one commit. So a step that is run again, or that died before
its commit, changes nothing twice, and a deleted or blanked member leaves nothing in the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .snapshots import Snapshots


class Copy:
    """The copy of one table. key: its columns that tell rows apart; without nulls."""

    def __init__(self, store: Snapshots, copy: Snapshots, table: str, key: list[str]):
        self.store, self.copy, self.table, self.key = store, copy, table, key

    def offset(self) -> int:
        """The store's version that the copy stands for."""
        return self.copy.manifest()["properties"].get(f"{self.table}:offset", 0)

    def changes(self, before: int, now: int) -> tuple[DataFrame, list[int] | None]:
        """Changes (key, op, row) between two versions, and the buckets in which they lie (None: the table isn't bucketed)."""
        old, new = (self.store.manifest(v)["tables"].get(self.table, {"parts": [], "buckets": None}) for v in (before, now))
        spec = self.store.manifest(now)["tables"][self.table]
        parts = lambda t, b: sorted(p for p, x in t["parts"] if x == b)
        buckets = None
        if spec["buckets"]:
            buckets = [b for b in range(spec["buckets"]) if parts(old, b) != parts(new, b)]
        schema = StructType.fromJson(spec["schema"])
        empty = self.store.spark.createDataFrame([], schema)
        side = lambda v, t: self.store.read(self.table, v, buckets) if t["parts"] else empty
        row = F.struct(*[F.col(f"`{f.name}`") for f in schema])
        was = side(before, old).select(*self.key, row.alias("_old"))
        is_ = side(now, new).select(*self.key, row.alias("row"))
        x = was.join(is_, self.key, "full")
        op = F.when(F.col("_old").isNull(), "I").when(F.col("row").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("row")), "U")
        return x.select(*self.key, op.alias("op"), "row").filter("op IS NOT NULL"), buckets

    def step(self) -> int:
        """Bring the copy up to the store's last version; that version."""
        before, now = self.offset(), self.store.version()
        if before == now:
            return now
        found, buckets = self.changes(before, now)
        spec = self.store.manifest(now)["tables"][self.table]
        schema, log = StructType.fromJson(spec["schema"]), f"{self.table}_changes"
        with self.copy.transaction() as tx:
            if self.table not in tx.tables:
                tx.create(self.table, schema, spec["key"], spec["buckets"])
                tx.create(log, found.withColumn("version", F.lit(now).cast("long")).schema)
            tx.append(log, found.withColumn("version", F.lit(now).cast("long")))
            mine = tx.store._rows(tx.work, log).filter(F.col("version") == now)  # as they were written
            if buckets is None or buckets:
                kept = tx.read(self.table, buckets).join(mine.select(*self.key), self.key, "left_anti")
                rows = kept.unionByName(mine.filter("op <> 'D'").select("row.*"))
                tx.replace(self.table, rows, buckets)
            tx.set_property(f"{self.table}:offset", now)
        return now
