"""Near-duplicate detection: MinHash signatures, banding, signature verification, exact confirmation, components.

1. One pass over the texts gives each document the number of its distinct 5-word shingles, a 128-bit hash of its word
   sequence, `bands` keys of `rows` universal hash minima each, and eight bits of every minimum.
2. Documents of one word sequence are one class; its least id takes part in what follows, so exact copies cost nothing.
   Of buckets (a band's key) with the same members one is looked at.
3. In each bucket all members are paired with one center, never with each other. A center of many members stands in as
   many copies as its largest bucket has `share` members, so no task gets all of its pairs. Pairs whose sizes or signatures
   can't reach the threshold go; the others are confirmed on their full shingle sets. Links give components.
4. Buckets that still hold more than one component are compared by signature, in blocks of bounded size, and what
   could be linked gathers in families. A group of near copies meets in most bands anew: such buckets are compared as one
   (see `meetings`), and a component that fills blocks isn't compared with itself. Inside a family, blocks of full sets are compared with each other by products of
   their incidence matrices, but for blocks of one component. What leaves a block is at most one link per document, so a
   large group of near copies never makes its square of rows, and no link between different components is lost.

At the threshold of 0.75 a pair shares none of 40 buckets of 5 minima with probability (1 - 0.75**5)**40 = 2e-5, and its
signatures are more than 4.5 standard deviations off with 3e-6.

A null or empty text, or one without words, has the empty set and links with nothing. Rows that share an id are one node, which
has the links of each; rows with a null id link with nothing, have a null component_id and are kept. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import in_arrow, released, Scratch, small
from .components import connected_components

SIGNATURE = "doc_id long, n_shingles long, seq binary, bands array<long>, sig binary"


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b of x -> a * x + b modulo 2**64, a odd."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for _ in range(2))
    return a * np.uint64(2) + np.uint64(1), b


def signer(bands: int, rows: int, k: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(bands * rows, seed)
        salt = tk.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for i, j, buf, off in tk.chunks(batch.column("text")):
                w, woff = tk.words(buf, off)
                g, goff = tk.grams(w, woff, k)
                size = np.array([len(x) for x in tk.distinct(g, goff)], np.int64)
                some = np.flatnonzero(size)
                minima = np.zeros((len(a), j - i), np.uint64)
                if len(some):
                    at = goff[some]
                    h = np.empty_like(g)
                    for m in range(len(a)):
                        np.multiply(g, a[m], out=h)
                        h += b[m]
                        minima[m, some] = np.minimum.reduceat(h, at)
                keys = np.zeros((bands, j - i), np.uint64)
                for r in range(rows):
                    keys = tk.mix(keys ^ minima[r::rows])
                keys = tk.mix(keys ^ salt[:, None]).T
                # A minimum of n values lies near 2**64 / n, so its own top bits tell nothing of long texts: they are mixed first.
                low = np.ascontiguousarray((tk.mix(minima).T >> np.uint64(56)).astype(np.uint8))
                seq = np.stack([tk.sequence_hash(w, woff, 1), tk.sequence_hash(w, woff, 2)], 1)
                full = size > 0
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32), pa.array(np.ascontiguousarray(keys[full]).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(size), pa.array([x.tobytes() for x in seq]), lists, pa.array([x.tobytes() for x in low])], ["doc_id", "n_shingles", "seq", "bands", "sig"]
                )

    return sign


def shingle_sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.chunks(batch.column("text")):
                each = tk.distinct(*tk.grams(*tk.words(buf, off), k))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = pa.array(np.concatenate(each).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(ends, flat)], ["doc_id", "shingles"])

    return sets


def agreeing(sigs: int):
    """Number of equal bytes in two signatures, for a column of both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, center = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, sigs) for c in ("sig", "sig_c"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "center", "salt")), pa.array((own == center).sum(1).astype(np.int64))], ["doc_id", "center", "salt", "same"])

    return count


def least_agreement(percent: int, sigs: int) -> int:
    """Unrelated minima agree in 1 of 256 bytes; 4.5 standard deviations below the threshold nothing is lost."""
    j = percent / 100
    p = j + (1 - j) / 256
    return int(sigs * (p - 4.5 * (p * (1 - p) / sigs) ** 0.5))


class Forest:
    """Union-find over the places of a block."""

    def __init__(self, labels: np.ndarray | None, n: int):
        self.root = list(range(n))
        if labels is not None:  # places of one label are united from the start
            _, first, at = np.unique(labels, return_index=True, return_inverse=True)
            self.root = first[at].tolist()

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one key, of a partition that is sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cut.tolist(), len(k)]
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.concat_tables([*held, t.slice(a, b - a)])
            held = []
        held.append(t.slice(edges[-2]))
    if held:
        yield pa.concat_tables(held)


def similar(sigs: int, least: int, percent: int):
    """Of each block pair of a bucket: links (u, v) that join all documents whose signatures could reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            ids, n, side = (t.column(c).to_numpy() for c in ("doc_id", "n", "side"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, sigs)
            forest, out = Forest(None, len(ids)), []
            for x in range(len(ids) - 1):
                rest = slice(x + 1, None)
                ok = ((sig[rest] == sig[x]).sum(1) >= least) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x])) & ((side[rest] == 0) | (side[x] == 0) | (side[rest] != side[x]))
                out += [(ids[x], ids[y]) for y in (np.flatnonzero(ok) + x + 1).tolist() if forest.unite(x, y)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return run


def intersections(flat: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets left and sets right: products of incidence matrices, `width` values at a time."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[value] > 1  # a value of one set alone counts for no pair
    value, doc = value[shared], doc[shared]
    _, value = np.unique(value, return_inverse=True)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    out = np.zeros((len(left), len(right)), np.float32)
    m = np.zeros((len(off) - 1, width), np.float32)
    for lo in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        a, b = np.searchsorted(value, [lo, lo + width])
        m[:] = 0
        m[doc[a:b], value[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out


def confirmed(percent: int):
    """Of each pair of blocks of a family: links (u, v) between documents whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "unit"):
            ids, component, side = (t.column(c).to_numpy() for c in ("doc_id", "component", "side"))
            lists = t.column("shingles").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            size = np.diff(off)
            both = intersections(flat, off - off[0], left, right)
            good = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (component[left][:, None] != component[right][None, :]) & (both > 0)
            forest = Forest(component, len(ids))
            out = [(ids[left[x]], ids[right[y]]) for x, y in zip(*(z.tolist() for z in np.nonzero(good)), strict=True) if forest.unite(int(left[x]), int(right[y]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return run


def block_pairs(rows: DataFrame, group: str, size: int, tmp: Scratch, name: str, within: str | None = None) -> DataFrame:
    """rows in blocks of about `size` rows of one group, each block with itself and with each other block: columns unit and side.

    A row is repeated for each block that its own meets. side: 0 in a block with itself, else 1 or 2. With `within`, a
    column, values of it that fill a block have blocks of their own, which don't meet themselves or each other.
    """
    seed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    if within is None:
        rows = rows.withColumn("_own", F.lit(0).cast("long"))
    else:
        sizes = tmp.write(rows.groupBy(group, within).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= size), f"{name}-own")
        rows = rows.join(sizes, [group, within], "left").withColumn("_own", F.when(F.col("_m").isNotNull(), F.col(within) + 1).otherwise(F.lit(0))).drop("_m")
    counts = tmp.write(rows.groupBy(group, "_own").agg(F.ceil(F.count(F.lit(1)) / size).alias("_nb")), f"{name}-counts")
    one = counts.select(group, F.col("_own").alias("o1"), F.explode(F.expr("sequence(0L, _nb - 1)")).alias("b1"))
    two = one.select(group, F.col("o1").alias("o2"), F.col("b1").alias("b2"))
    meet = one.join(two, group).filter("(o1 < o2 OR (o1 = o2 AND b1 <= b2)) AND NOT (o1 = o2 AND o1 <> 0)")
    meet = meet.withColumn("unit", F.xxhash64(F.lit(name), group, "o1", "b1", "o2", "b2"))
    self_met = (F.col("o1") == F.col("o2")) & (F.col("b1") == F.col("b2"))
    first = meet.select(group, F.col("o1").alias("_own"), F.col("b1").alias("_b"), "unit", F.when(self_met, 0).otherwise(1).alias("side"))
    second = meet.filter(~self_met).select(group, F.col("o2").alias("_own"), F.col("b2").alias("_b"), "unit", F.lit(2).alias("side"))
    blocks = tmp.write(first.unionByName(second), f"{name}-blocks")
    placed = rows.join(counts, [group, "_own"]).withColumn("_b", F.pmod(seed, F.col("_nb")))
    return placed.drop("_nb").join(blocks, [group, "_own", "_b"]).drop("_own", "_b", group)


def meetings(left: DataFrame, mixed: DataFrame, block: int, tmp: Scratch) -> DataFrame:
    """(key, doc_id, component): the members of mixed buckets (key, lo, m), where buckets of one least component are one if that repeats fewer rows.

    A bucket goes into the joint one whole, so all of its pairs still meet, and pairs of many bands meet once.
    """
    x = left.join(mixed, "key").select("key", "lo", "doc_id", "component")
    joint = tmp.write(x.select("lo", "doc_id", "component").distinct(), "joint")
    repeated = lambda n: n * F.ceil(n / block)
    apart = mixed.groupBy("lo").agg(F.sum(repeated(F.col("m"))).alias("apart"))
    chosen = joint.groupBy("lo").agg(F.count(F.lit(1)).alias("d")).join(apart, "lo").filter(repeated(F.col("d")) <= F.col("apart"))
    chosen = tmp.write(chosen.select("lo"), "chosen")
    alone = x.join(chosen, "lo", "left_anti").select("key", "doc_id", "component")
    together = joint.join(chosen, "lo", "left_semi").select(F.xxhash64(F.lit("joint"), "lo").alias("key"), "doc_id", "component")
    return tmp.write(alone.unionByName(together), "meetings")


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, bands: int = 40, rows: int = 5, seed: int = 5, block: int = 256, share: int = 128) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. docs needs doc_id (long) and text.

    block: documents per block; share: members of a bucket that meet one copy of its center.
    """
    tmp = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = tmp.write(in_arrow(texts, released(signer(bands, rows, k, seed)), SIGNATURE), "signed")
    labels = components_of(signed, texts, tmp, percent, k, bands * rows, block, share)
    out = signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def components_of(signed: DataFrame, texts: DataFrame, tmp: Scratch, percent: int, k: int, sigs: int, block: int, share: int) -> DataFrame:
    """(node, component) of all documents that have a link."""
    least = least_agreement(percent, sigs)
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = tmp.write(full.groupBy("seq").agg(F.min("doc_id").alias("rep")), "classes")
    # Copies of one word sequence: links to the class's least id.
    copies = full.select("seq", "doc_id").join(classes, "seq").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    nodes = tmp.write(full.join(classes.withColumnRenamed("rep", "doc_id"), ["seq", "doc_id"], "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "bands", "sig"), "nodes")
    members = nodes.select("doc_id", F.explode("bands").alias("key"))
    seen = F.struct(F.xxhash64(F.lit(0), "doc_id").alias("h"), F.col("doc_id").alias("d"))
    print_of = F.sum(F.xxhash64(F.lit(1), "doc_id").cast("decimal(20,0)"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("m"), F.min(seen).alias("c"), print_of.alias("p")).filter("lo <> hi")
    buckets = buckets.groupBy("m", "p", "lo", "hi", "c").agg(F.min("key").alias("key")).select("key", "m", F.col("c.d").alias("center"))
    buckets = tmp.write(buckets, "buckets")
    # A center is a member of its buckets, so it has as many of them as there are bands at most.
    copies_of = tmp.write(buckets.groupBy("center").agg(F.ceil(F.max("m") / share).alias("salts")), "centers")
    buckets = tmp.write(buckets.drop("m").join(copies_of, "center"), "salted")
    shared = tmp.write(members.join(buckets, "key").distinct(), "shared")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        some = texts.join(small(ids, ids.count()), "doc_id", "left_semi")
        return tmp.write(in_arrow(some, released(shingle_sets(k)), "doc_id long, shingles array<long>"), name)

    # Each member of a bucket with a copy of the bucket's center.
    pairs = shared.filter("doc_id <> center").select("doc_id", "center", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt")).distinct()
    spread = copies_of.select("center", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"))
    centers = spread.join(nodes.select(F.col("doc_id").alias("center"), F.col("n").alias("n_c"), F.col("sig").alias("sig_c")), "center")
    pairs = pairs.join(nodes.select("doc_id", "n", "sig"), "doc_id").join(centers, ["center", "salt"])
    pairs = pairs.filter(100 * F.least("n", "n_c") >= percent * F.greatest("n", "n_c")).select("doc_id", "center", "salt", "sig", "sig_c")
    near = tmp.write(in_arrow(pairs, agreeing(sigs), "doc_id long, center long, salt long, same long").filter(F.col("same") >= least).drop("same"), "near")
    sets = sets_of(tmp.write(near.select(F.explode(F.array("doc_id", "center")).alias("doc_id")).distinct(), "ids"), "sets")
    used = near.select("center", "salt").distinct().join(sets.select(F.col("doc_id").alias("center"), F.col("shingles").alias("s_c")), "center")
    both = near.join(sets, "doc_id").join(used, ["center", "salt"]).withColumn("i", F.size(F.array_intersect("shingles", "s_c")))
    good = both.filter(100 * F.col("i") >= percent * (F.size("shingles") + F.size("s_c") - F.col("i")))
    links = tmp.write(good.select(F.greatest("doc_id", "center").alias("u"), F.least("doc_id", "center").alias("v")).distinct(), "links")
    tmp.drop("sets", "ids", "near")

    # Buckets that hold several components, by signature.
    labels = tmp.write(connected_components(links, Scratch(tmp.spark, "cc")), "labels").withColumnRenamed("node", "doc_id")
    left = shared.drop("center", "salts").join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = tmp.write(left, "left")
    mixed = tmp.write(left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").drop("hi"), "mixed")
    rows = meetings(left, mixed, block, tmp)
    units = block_pairs(rows, "key", block, tmp, "bucket", "component").drop("component").join(nodes.select("doc_id", "n", "sig"), "doc_id")
    kin = in_arrow(units.repartition("unit").sortWithinPartitions("unit"), similar(sigs, least, percent), "u long, v long")
    kin = tmp.write(kin.distinct(), "kin")
    families = tmp.write(connected_components(kin, Scratch(tmp.spark, "cc")).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")

    # Families that hold several components, by full sets.
    named = families.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = tmp.write(named, "named")
    several = named.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("family")
    rows = tmp.write(named.join(tmp.write(several, "several"), "family", "left_semi").select("family", "doc_id", "component"), "rows")
    units = block_pairs(rows, "family", block, tmp, "family", "component").join(sets_of(rows.select("doc_id").distinct(), "rest"), "doc_id")
    more = in_arrow(units.repartition("unit").sortWithinPartitions("unit"), confirmed(percent), "u long, v long")
    more = tmp.write(more.distinct(), "more")
    known = labels.select(F.col("doc_id").alias("u"), F.col("component").alias("v"))
    out = tmp.write(connected_components(copies.unionByName(known).unionByName(more), Scratch(tmp.spark, "cc")), "components")
    tmp.drop("shared", "left", "nodes", "rest", "classes", "buckets", "salted", "centers", "joint", "meetings", "bucket-blocks", "family-blocks")
    return out
