"""Token ids as wavelet matrices: succinct bit planes with rank and select, one compressed file per shard.

Documents are dealt to shards by ranges of doc_id and sorted; each shard is one Parquet file with the wavelet matrix of all its
tokens, and the ids and lengths of its documents. The matrix has one plane per bit of a token, highest first: bit l of all tokens
in the order that the planes above have sorted them into (zeros before ones, stable). A plane is stored in compressed chunks of
64 KB. With the number of zeros of each plane and counts of ones before every 512 bits, a token at a place, the number of a
token's occurrences before a place, and the place of its j-th occurrence are found in as many steps as there are planes; only
the chunks that a step looks into are decompressed.

A shard whose range turns out to hold more than `most_tokens` is written as several parts, each with a matrix of its own, so
that a task's memory is bounded by that and its longest document. Spark's own writer makes the files, so a task that a lost
executor has begun leaves nothing half written, and any shared store will do. Null texts are empty and hold the end id alone.
Rows with a null id come first; rows that share an id follow each other in the order of their texts, and ranges may end between
them. An empty table makes no shards. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, in_arrow, released
from .tokenise import encoder

SHARD = "shard int, part int, n_docs int, n_tokens long, width int, doc_ids binary, lengths binary, zeros binary, ranks binary, planes array<binary>"
#: Shards that a corpus is divided into, unless they would be too small or too large.
SHARDS = 4096
#: Bits between two stored counts of ones, and bits of a chunk.
STEP, CHUNK = 512, 1 << 19
#: Tokens that one step of building takes at a time, so that they stay in the processor's cache.
RUN = 1 << 18


class WaveletMatrix:
    """n tokens of `width` bits. chunk(level, k): 64-bit words of a chunk of a plane; ranks: ones before every STEP bits."""

    def __init__(self, n: int, width: int, zeros: np.ndarray, ranks: np.ndarray, chunk: Callable[[int, int], np.ndarray]):
        self.n, self.width, self.zeros, self.ranks, self.chunk = n, width, zeros, ranks, chunk

    @classmethod
    def build(cls, tokens: np.ndarray, width: int) -> WaveletMatrix:
        n = len(tokens)
        bits = -(-max(n, 1) // STEP) * STEP
        planes, zeros = np.zeros((width, bits // 8), np.uint8), np.zeros(width, np.int64)
        v = tokens.astype(np.uint16 if width <= 16 else np.uint32)
        sorted_ = np.empty_like(v)
        for level in range(width):
            mask = v.dtype.type(1 << (width - 1 - level))
            low, high = 0, n - int(np.count_nonzero(v & mask))
            zeros[level] = high
            for i in range(0, n, RUN):
                part = v[i : i + RUN]
                bit = (part & mask) != 0
                packed = np.packbits(bit, bitorder="little")
                planes[level, i // 8 : i // 8 + len(packed)] = packed
                ones = int(np.count_nonzero(bit))
                np.compress(bit, part, out=sorted_[high : high + ones])
                np.compress(~bit, part, out=sorted_[low : low + len(part) - ones])
                low, high = low + len(part) - ones, high + ones
            v, sorted_ = sorted_, v
        words = planes.view(np.uint64)
        ones = np.bitwise_count(words).reshape(width, -1, STEP // 64).sum(2, dtype=np.uint32)
        ranks = np.zeros((width, bits // STEP + 1), np.uint32)
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(n, width, zeros, ranks, lambda level, k: words[level, k * (CHUNK // 64) : (k + 1) * (CHUNK // 64)])

    def chunks(self) -> Iterator[np.ndarray]:
        """All chunks, plane by plane."""
        for level in range(self.width):
            for k in range(-(-((self.ranks.shape[1] - 1) * STEP) // CHUNK)):
                yield self.chunk(level, k)

    def tokens(self) -> np.ndarray:
        """All tokens: the planes' sorting undone from the last to the first."""
        v = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in reversed(range(self.width)):
            out, low, high = np.empty_like(v), 0, int(self.zeros[level])
            for k, i in enumerate(range(0, self.n, CHUNK)):
                m = min(CHUNK, self.n - i)
                bit = np.unpackbits(self.chunk(level, k).view(np.uint8), count=m, bitorder="little").view(bool)
                at, part = np.flatnonzero(bit), out[i : i + m]  # places take half the time of a mask here
                ones = len(at)
                part[np.flatnonzero(~bit)] = v[low : low + m - ones]
                part[at] = v[high : high + ones] | v.dtype.type(1 << (self.width - 1 - level))
                low, high = low + m - ones, high + ones
            v = out
        return v

    def _steps(self, level: int, step: np.ndarray) -> np.ndarray:
        """The words of whole steps: a row for each."""
        each, per = CHUNK // STEP, STEP // 64
        out = np.empty((*step.shape, per), np.uint64)
        k = step // each
        for x in np.unique(k).tolist():
            out[k == x] = self.chunk(level, x).reshape(-1, per)[step[k == x] - x * each]
        return out

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before place i of a plane."""
        i = np.asarray(i, np.int64)
        step = np.minimum(i // STEP, self.ranks.shape[1] - 2)
        left = np.clip((i - step * STEP)[..., None] - np.arange(0, STEP, 64), 0, 64)
        mask = np.where(left >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[level, step].astype(np.int64) + np.bitwise_count(self._steps(level, step) & mask).sum(-1, dtype=np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The tokens at places i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(i.shape, np.int64)
        for level in range(self.width):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return out

    def _span(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the last plane's order has the token's occurrences among places a to b - 1."""
        for level in range(self.width):
            ones = self._ones(level, np.array([a, b]))
            if token >> (self.width - 1 - level) & 1:
                a, b = (int(self.zeros[level] + x) for x in ones)
            else:
                a, b = int(a - ones[0]), int(b - ones[1])
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often a token occurs before place i."""
        if token >> self.width:
            return 0
        a, b = self._span(token, 0, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: np.ndarray) -> np.ndarray:
        """The places of a token's j-th occurrences, from 0."""
        at = self._span(token, 0, self.n)[0] + np.asarray(j, np.int64)
        for level in reversed(range(self.width)):
            one = token >> (self.width - 1 - level) & 1
            k = at - self.zeros[level] if one else at
            lo, hi = np.zeros_like(k), np.full_like(k, self.n)
            while (lo < hi).any():  # the place before which there are k such bits
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                less = (ones if one else mid + 1 - ones) <= k
                lo, hi = np.where(less & (lo < hi), mid + 1, lo), np.where(less, hi, mid)
            at = lo
        return at


#: Bytes of text that are encoded at a time, unless a single text is longer.
PASS = 10 << 20


def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of as many batches as make a pass."""
    held, size = [], 0

    def whole() -> tuple[pa.Array, pa.Array]:
        """One copy of what is held: the batches are gone while it is worked on."""
        out = tuple(map(pa.concat_arrays, zip(*held, strict=True)))
        held.clear()
        return out

    for batch in batches:
        held.append((batch.column("doc_id"), batch.column("text").cast(pa.large_string())))
        size += batch.column("text").nbytes
        del batch
        if size >= PASS:
            yield whole()
            size = 0
    if held:
        yield whole()


def pack(ids: np.ndarray, has: np.ndarray) -> bytes:
    """doc ids and whether each is stated."""
    return zstandard.ZstdCompressor(1).compress(ids.astype("<i8").tobytes() + has.astype(np.uint8).tobytes())


def shard_row(shard: int, part: int, ids: np.ndarray, has: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, width: int) -> dict:
    m, z = WaveletMatrix.build(tokens, width), zstandard.ZstdCompressor(1)
    head = {"shard": shard, "part": part, "n_docs": len(ids), "n_tokens": len(tokens), "width": width, "doc_ids": pack(ids, has), "lengths": z.compress(lengths.astype("<u4").tobytes())}
    return head | {"zeros": m.zeros.astype("<i8").tobytes(), "ranks": z.compress(m.ranks.astype("<u4").tobytes()), "planes": [z.compress(x.tobytes()) for x in m.chunks()]}


class Shard:
    """A shard, or a part of one, as read from its file."""

    def __init__(self, row: dict):
        z = zstandard.ZstdDecompressor()
        self.shard, self.part, n, width = row["shard"], row["part"], row["n_tokens"], row["width"]
        head = z.decompress(row["doc_ids"])
        self.ids, self.has = np.frombuffer(head, "<i8", row["n_docs"]), np.frombuffer(head, np.uint8, row["n_docs"], 8 * row["n_docs"]).astype(bool)
        self.lengths = np.frombuffer(z.decompress(row["lengths"]), "<u4").astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.planes, self.opened = row["planes"], {}
        ranks = np.frombuffer(z.decompress(row["ranks"]), "<u4").reshape(width, -1)
        self.matrix = WaveletMatrix(n, width, np.frombuffer(row["zeros"], "<i8"), ranks, self.chunk)

    def chunk(self, level: int, k: int) -> np.ndarray:
        at = level * (len(self.planes) // self.matrix.width) + k
        if at not in self.opened:
            self.opened[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.planes[at]), np.uint64)
        return self.opened[at]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int | None = None, most_tokens: int = 1 << 24) -> None:
    """Encode docs (doc_id, text) with a tokenizer file of the driver and write shards to path, one file each.

    shard_bytes: text of a shard, on average; by default a SHARDS-th of all text, but 16 MB at least and 1 GB at most, so that the
    number of files stays manageable. most_tokens bounds a shard's parts, and so a worker's memory.
    """
    spark = docs.sparkSession
    with open(tokenizer) as f:
        spec = f.read()
    width = max(1, max(encoder(spec).vocabulary() - 1, end_id).bit_length())
    sent = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shard_bytes = shard_bytes or min(max(total // SHARDS, 16 << 20), 1 << 30)
    shards = max(1, -(-total // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, part = encoder(sent.value), TaskContext.get().partitionId(), 0
        ids, has, tokens, lengths = [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            whole = []
            for x in (ids, has, lengths, tokens):
                whole.append(np.concatenate(x))
                x.clear()
            row = shard_row(shard, part, *whole, width)
            return pa.RecordBatch.from_pylist([row], schema)

        for column, texts in passes(batches):
            flat, off = e.encode(texts)
            n = np.diff(off)
            with_end, own = np.full(len(flat) + len(n), end_id, id_type), np.ones(len(flat) + len(n), bool)
            own[off[1:] + np.arange(len(n))] = False
            with_end[own] = flat
            del own, flat
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            has.append(column.is_valid().to_numpy(zero_copy_only=False))
            lengths.append(n + 1)
            tokens.append(with_end)
            held += len(with_end)
            # A pass's arrays are many times its text: they are gone, and not only free, before the next one.
            del column, texts, off, n, with_end
            give_back()
            if held >= most_tokens:
                yield flush()
                part, held = part + 1, 0
        if lengths:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("doc_ids", "lengths", "zeros", "ranks")), ("planes", pa.list_(pa.binary()))])
    id_type = np.uint16 if width <= 16 else np.uint32
    # The beginning of a text divides rows of one id, or of none, so that they needn't be one shard.
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    in_arrow(dealt, released(encode, forget=False), SHARD).write.mode("overwrite").option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)


def shards_of(batch: pa.RecordBatch) -> Iterator[Shard]:
    for i in range(len(batch)):
        yield Shard({c: batch.column(c)[i].as_py() for c in batch.schema.names})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back: doc_id, start, n_tokens, ids_crc32, shard, part. In file order within a part."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards_of(batch):
                raw = memoryview(b.matrix.tokens().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b.starts[:-1], b.starts[1:], strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, pa.int64(), mask=~b.has), pa.array(b.starts[:-1]), pa.array(b.lengths), pa.array(crc, pa.int64()), pa.array(np.full(n, b.shard, np.int32)), pa.array(np.full(n, b.part, np.int32))],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "shard", "part"],
                )

    files = spark.read.schema(SHARD).parquet(path)
    own = in_arrow(files, released(digest), "doc_id long, at long, n_tokens long, ids_crc32 long, shard int, part int")
    return own.join(part_starts(files), ["shard", "part"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "part")


def part_starts(files: DataFrame) -> DataFrame:
    """(shard, part, before): ids of all parts before. Shards are summed first, then the parts inside each shard."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    inside = files.select("shard", "part", (F.sum("n_tokens").over(W.partitionBy("shard").orderBy("part")) - F.col("n_tokens")).alias("b"))
    return inside.join(shards, "shard").select("shard", "part", (F.col("base") + F.col("b")).alias("before"))


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, part, n): how often a token occurs, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards_of(batch):
                yield pa.RecordBatch.from_pylist([{"shard": b.shard, "part": b.part, "n": b.matrix.count(token)}], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n", pa.int64())]))

    return in_arrow(spark.read.schema(SHARD).parquet(path), run, "shard int, part int, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place): a token's occurrences by select; place counts from the document's first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards_of(batch):
                at = b.matrix.select(token, np.arange(b.matrix.count(token)))
                doc = np.searchsorted(b.starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[doc], pa.int64(), mask=~b.has[doc]), pa.array(at - b.starts[doc])], ["doc_id", "place"])

    return in_arrow(spark.read.schema(SHARD).parquet(path), run, "doc_id long, place long")
