"""Shared plumbing: scratch tables in the cluster's shared folder, and input normalisation."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "Scratch", "give_back", "held_out", "in_arrow", "learn_row", "lower_ascii", "released", "shared_dir", "small", "table"]

#: A side is broadcast only when a count has shown that it has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


#: Bytes of rows that go to a Python worker at a time, in place of Spark's default of 64 MB.
ARROW_BYTES, ARROW_DEFAULT = "4m", "67108864b"


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches bounded by bytes, for the memory of workers and of their executor. A session's own bound holds."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == ARROW_DEFAULT:
        conf.set(key, ARROW_BYTES)
    return df.mapInArrow(run, schema)


#: What empties the memories that modules keep in a worker for tasks of their own kind.
MEMORIES: list[Callable[[], None]] = []


def give_back() -> None:
    """Give memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable, forget: bool = True) -> Callable:
    """run, a function for in_arrow, in a worker that first forgets what tasks of other kinds have kept (unless these memories are its
    own), and that at a task's end gives back the memory that it has freed: workers live on, and several wait in each executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for clear in MEMORIES if forget else ():
            clear()
        yield from run(batches)
        give_back()

    return whole


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learn_row(doc_id: Column) -> Column:
    """Rows that models may learn labels from: crc32 of the id as text, mod 4, is not 2. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
