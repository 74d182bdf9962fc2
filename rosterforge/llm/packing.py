"""Hierarchical packing of documents into sequences of several context sizes, without padding.

Documents are encoded where they are read and packed there, some megabytes of text at a time; texts are never shuffled. A
document of the longest context or more gives whole sequences of it, and its rest is a piece like a shorter document. Pieces are
routed to tiers: the smallest context that holds them. Tiers are packed from the longest: the longest piece opens a sequence,
whose gap is filled with the longest pieces of shorter tiers that fit; when none fits, the longest piece that is left is cut to
fill it. So a sequence is full to its context size, and a document is cut only where nothing whole would fit. What the last
sequence lacks when no piece is left waits for the task's next texts; at a task's end it is cut at powers of two, at most one
sequence of each, so that nothing is padded there either.

Step groups: the sequences of a tier, ordered by the cost of attention within pieces (the sum of squared lengths), are cut into
groups of as many tokens each, so that the sequences of a step cost about the same. The order is a range partitioning, and a
sequence's place in it is its place in its part plus the counts of the parts before.

A row of the files is a sequence: its ids as little-endian 32-bit numbers and its pieces. Sequence ids are the task's number times
2**33 plus a count. Null texts are empty and hold the end id alone. Null and repeated ids are documents like others. A text of
any length is one document, held by one worker. An empty table gives no sequences. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import in_arrow
from .tokenise import encoder
from .wavelet import passes

TIERS = (256, 512, 1024, 2048, 4096)
PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"
SEQUENCE = f"sequence_id long, n_tokens int, cost long, ids binary, pieces array<{PIECE}>"
#: Sequences that are handed over at a time.
RUN = 256


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Pool:
    """Pieces by length; a bit of `held` says whether there is a piece of that length."""

    def __init__(self):
        self.of: dict[int, list[Piece]] = {}
        self.held = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.of.setdefault(n, []).append(piece)
        self.held |= 1 << n

    def longest(self, limit: int) -> Piece | None:
        """Take out the longest piece of at most `limit`; of several the one that came last."""
        n = (self.held & ((2 << limit) - 1)).bit_length() - 1
        if n < 0:
            return None
        own = self.of[n]
        piece = own.pop()
        if not own:
            self.held ^= 1 << n
        return piece


class Packer:
    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.rest = sorted(tiers), []
        if any(t & (t - 1) or t < 1 for t in self.tiers):
            raise ValueError("context sizes are powers of two")

    def add(self, pieces: Iterator[Piece]) -> Iterator[list[Piece]]:
        """Full sequences of new pieces and of what was left before."""
        top, pool = self.tiers[-1], Pool()
        for piece in [*self.rest, *pieces]:
            while len(piece.ids) >= top:
                own, piece = piece.cut(top)
                yield [own]
            if len(piece.ids):
                pool.put(piece)
        self.rest = []
        while pool.held:
            own = [pool.longest(top)]
            gap = next(t for t in self.tiers if t >= len(own[0].ids)) - len(own[0].ids)
            while gap:
                piece = pool.longest(gap)
                if piece is None and (piece := pool.longest(top)) is not None:
                    piece, back = piece.cut(gap)
                    pool.put(back)
                if piece is None:
                    self.rest = [p._replace(ids=p.ids.copy()) for p in own]  # not the whole array that it is a part of
                    return
                own.append(piece)
                gap -= len(piece.ids)
            yield own

    def end(self) -> Iterator[list[Piece]]:
        """What is left, cut at powers of two."""
        left, self.rest = self.rest, []
        total = sum(len(p.ids) for p in left)
        while total:
            n = room = 1 << (total.bit_length() - 1)
            own = []
            while room:
                piece = left.pop(0)
                if len(piece.ids) > room:
                    piece, back = piece.cut(room)
                    left.insert(0, back)
                own.append(piece)
                room -= len(piece.ids)
            total -= n
            yield own


def rows_of(sequences: list[list[Piece]], first: int) -> list[dict]:
    out = []
    for k, own in enumerate(sequences):
        pieces, at, cost = [], 0, 0
        for p in own:
            n = len(p.ids)
            pieces.append({"doc_id": p.doc_id, "start": p.start, "length": n, "doc_tokens": p.doc_tokens, "offset": at})
            at, cost = at + n, cost + n * n
        ids = np.concatenate([p.ids for p in own]).astype("<u4").tobytes()
        out.append({"sequence_id": first + k, "n_tokens": at, "cost": cost, "ids": ids, "pieces": pieces})
    return out


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS) -> None:
    """Encode docs (doc_id, text) with a tokenizer file of the driver, and write their sequences to path."""
    with open(tokenizer) as f:
        spec = f.read()
    Packer(tiers)
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    piece = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "offset")])
    schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("cost", pa.int64()), ("ids", pa.binary()), ("pieces", pa.list_(piece))])

    def pieces(column: pa.Array, texts: pa.Array) -> Iterator[Piece]:
        flat, off = encoder(sent.value).encode(texts)
        flat = np.insert(flat, off[1:], end_id)
        off = off + np.arange(len(off))
        for i, a, b in zip(column.to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            yield Piece(i, 0, b - a, flat[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = Packer(tiers), TaskContext.get().partitionId() << 33

        def sequences() -> Iterator[list[Piece]]:
            for column, texts in passes(batches):
                yield from packer.add(pieces(column, texts))
            yield from packer.end()

        held = []
        for own in sequences():
            held.append(own)
            if len(held) == RUN:
                yield pa.RecordBatch.from_pylist(rows_of(held, at), schema)
                held, at = [], at + RUN
        if held:
            yield pa.RecordBatch.from_pylist(rows_of(held, at), schema)

    out = in_arrow(rows, run, SEQUENCE)
    out.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The sequences, as read from the files."""
    return spark.read.schema(SEQUENCE).parquet(path)


def step_groups(sequences: DataFrame, step_tokens: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """(sequence_id, n_tokens, cost, step): steps of one tier, of step_tokens each but for a tier's last, and of like costs."""
    spark = sequences.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["n_tokens", "cost", "sequence_id"]
    narrow = sequences.select("sequence_id", "n_tokens", "cost").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tmp = Scratch(spark, "steps")
    placed = tmp.write(narrow.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed")
    # a row for each part and tier
    heads = placed.groupBy("n_tokens", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    heads = heads.withColumn("_before", F.sum("_n").over(W.partitionBy("n_tokens").orderBy("_part")) - F.col("_n"))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    step = F.floor(place * F.col("n_tokens") / F.lit(step_tokens)).cast("long")
    return placed.join(heads, ["n_tokens", "_part"]).select("sequence_id", "n_tokens", "cost", step.alias("step"))


def pieces_of(sequences: DataFrame) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_tokens (of the sequence)."""
    own = F.transform("pieces", lambda p: F.struct(p.alias("p"), F.crc32(F.substring(F.col("ids"), (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))).alias("crc")))
    x = sequences.select("sequence_id", "n_tokens", F.explode(own).alias("o"))
    return x.select("o.p.doc_id", "o.p.start", "o.p.length", F.col("o.crc").alias("ids_crc32"), "o.p.doc_tokens", "sequence_id", "o.p.offset", "n_tokens")
