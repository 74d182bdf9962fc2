"""Hashed n-gram indices of Arrow string columns, and distributed document frequencies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import in_arrow

_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "alpha" not in _tables:
        _tables["alpha"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["alpha"]


def lowered() -> np.ndarray:
    """Lower-case code points, where that is one code point."""
    if "lower" not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x2000):
            x = chr(c).lower()
            if len(x) == 1:
                t[c] = ord(x)
        _tables["lower"] = t
    return _tables["lower"]


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets as code points and offsets."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cp, starts[off]


def hashed(symbols: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket for the n-gram at each place; symbols are one row's."""
    if len(symbols) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(symbols) - n + 1, n, np.uint32)
    for j in range(n):
        h ^= symbols[j : len(symbols) - n + 1 + j]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's bytes, as 32-bit numbers."""
    for _, _, buf, off in tk.chunks(column):
        wide = buf.astype(np.uint32)
        for a, b in zip(off[:-1], off[1:], strict=True):
            yield wide[a:b]


def char_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's code points in lower case."""
    low = lowered()
    for _, _, buf, off in tk.chunks(column):
        cp, coff = code_points(buf, off)
        cp = low[cp]
        for a, b in zip(coff[:-1], coff[1:], strict=True):
            yield cp[a:b]


def indicators(row: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The distinct buckets of a row, sorted."""
    mask = np.zeros(1 << bits, bool)
    for n in orders:
        mask[hashed(row, n, bits)] = True
    return np.flatnonzero(mask)


def counts(row: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket occurs in a row."""
    return np.bincount(np.concatenate([hashed(row, n, bits) for n in orders]), minlength=1 << bits)


def document_frequencies(rows: DataFrame, cls: str, text_col: str, read: Callable, orders: tuple[int, ...], bits: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows: per class (an int column below `classes`) the rows, and the rows that hold each bucket.

    Each task counts into one array; what it sends is bounded by classes times buckets, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((classes, 1 << bits), np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            for c, row in zip(batch.column(cls).to_pylist(), read(batch.column(text_col)), strict=True):
                df[c, indicators(row, orders, bits)] += 1
                n[c] += 1
        c, b = np.nonzero(df)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((c, own)).astype(np.int32)), pa.array(np.concatenate((b, np.full(len(own), -1))).astype(np.int32)), pa.array(np.concatenate((df[c, b], n[own])))], ["c", "b", "n"]
        )

    got = in_arrow(rows.select(cls, text_col), run, "c int, b int, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros((classes, 1 << bits), np.int64), np.zeros(classes, np.int64)
    whole = (got.b < 0).to_numpy()
    n[got.c[whole]] = got.n[whole]
    df[got.c[~whole], got.b[~whole]] = got.n[~whole]
    return n, df


def bounded_sample(rows: DataFrame, cls: str, per_class: int, id_col: str, sizes: dict) -> DataFrame:
    """Rows of each class whose hash falls below the part that leaves about per_class of them: the documented bound.

    The cut is three standard deviations low, so a class rarely has more than per_class rows. Where it has, as rows that share an id
    are taken or left together, equal rows count once and those of the least digests of the whole row are taken, per_class at most.
    """
    cut = F.lit(0.0)
    for c, n in sizes.items():
        part = 1.0 if n <= per_class else max(per_class - 3 * per_class**0.5, per_class / 2) / n
        cut = F.when(F.col(cls) == c, F.lit(part)).otherwise(cut)
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) < cut * (1 << 30))
    taken = {r[cls]: r["n"] for r in sample.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    digest = F.xxhash64(*rows.columns)
    for c in [c for c, n in taken.items() if n > per_class]:
        least = sample.filter(F.col(cls) == c).select(digest.alias("h")).distinct().orderBy("h").limit(per_class + 1).agg(F.max("h"), F.count("h")).first()
        own = F.col(cls) == c
        if least[1] > per_class:  # the digest after the last that is taken
            sample = sample.filter(~own | (digest < least[0]))
        sample = sample.filter(~own).unionByName(sample.filter(own).dropDuplicates())
    return sample
