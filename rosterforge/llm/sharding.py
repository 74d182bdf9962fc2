"""Two-pass external shuffle into shards of nearly equal row counts, in DataFrame operations only.

Pass 1 scatters whole records by a seeded hash of their content into buckets; their number follows from the counted rows and
bytes, so that a bucket fits in memory. Pass 2 sorts each bucket by a second hash and the content, and takes the records in the
order that Spark's shuffle(array, seed), an inside-out Fisher-Yates shuffle, gives to the bucket's places. Only places are
ever held as an array; records go through sorts, which spill. A record's place in the whole order is its bucket's offset and
its place in the bucket; shard s of n takes the places p with p * n // rows = s, so counts differ by one at most.

A partition holds whole buckets, of a number fixed by the counts, in order; a task that runs again after a lost executor
makes the same order.

Law: "rows". Null texts have no bytes; null ids and repeated rows are records like others. Rows that agree in every
column that can be sorted (all but maps and variants) are interchangeable. An empty table gives no rows. Copies are spread
over the shards like any other records. Columns of the records called shard or slot are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def sortable(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]


def external_shuffle(records: DataFrame, n_shards: int, seed: int = 17, bucket_rows: int = 10_000, bucket_bytes: int = 64 << 20, size: Column | None = None, by: tuple[str, ...] | None = None, most_partitions: int = 20_000) -> DataFrame:
    """records with shard (0 to n_shards - 1) and slot (gapless from 0 within a shard).

    size: a record's bytes, for the number of buckets; by: columns that the scatter hashes (default: all that can be
    sorted). Rows that agree in all of `by` meet in one bucket, so `by` should hold an id. most_partitions: beyond it, a
    partition holds several buckets.
    """
    by = list(by or sortable(records))
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(size if size is not None else F.lit(64)), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_rows), -(-total // bucket_bytes))
    parts = min(buckets, most_partitions)
    place = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(buckets)).cast("int")
    counts = records.select(place.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_bucket", "_n", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # a row per bucket
    before = Scratch(records.sparkSession, "shards").write(before, "before")
    # The hash is finer than the partitions, and each partition deals with its buckets in order.
    orders = before.repartition(parts, "_bucket").sortWithinPartitions("_bucket").withColumn("_order", F.expr(f"shuffle(sequence(0L, _n - 1), {seed})"))
    orders = Scratch(records.sparkSession, "shards").write(orders.select("_bucket", "_before", "_order"), "orders")
    keys = [F.col("_r").getField(c) for c in by]
    inside = W.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(~seed), *keys), *keys)
    scattered = records.select(place.alias("_bucket"), F.struct(*records.columns).alias("_r")).repartition(parts, "_bucket")
    placed = scattered.withColumn("_i", F.row_number().over(inside)).join(orders, "_bucket")
    spot = F.col("_before") + F.element_at("_order", F.col("_i"))
    shard = F.floor(spot * n_shards / F.lit(max(n, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil(shard.cast("decimal(20,0)") * n / n_shards).cast("long")
    own = [F.col("_r").getField(c).alias(c) for c in records.columns if c not in ("shard", "slot")]
    return placed.select(*own, shard.alias("shard"), (spot - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 17, text_col: str = "text") -> DataFrame:
    """Write whole records into path/shard=s and return the written rows.

    A bucket's places are gapless, so a bucket is written by the task that shuffled it: a shard is a file of each
    partition that reaches into it, ordered by slot.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    out = external_shuffle(docs, n_shards, seed, size=size)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
