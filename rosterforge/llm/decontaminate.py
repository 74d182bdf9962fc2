"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item if one of its runs of words is within d = floor(max_edit * m) word edits
(insert, delete, replace) of the item's m words. Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z.

Candidates come from the LSH alone. Each item, and the window at each place of each document, is embedded by the CGK random walk
(it copies the word under it; a bit that the word and the step decide makes it stay or move on), which maps edit distance to
Hamming distance. A walk is the same for windows of all lengths as long as it is inside, so one walk from a place serves
items of every length. An item has parts of `span` words at most, and walks go alternately forward from a part's first word and
backward from its last, on through the item, `steps` steps each (twice an item's words for short items), so that all of a long
item's words are walked over: of d edits some part has no more than its share, wherever they are. Repeated tables of sampled steps
make candidates: a window meets an item when the sampled symbols of one table agree at one of its parts. The number of tables follows from the target recall at the Hamming distance `far`, shared by
independent walks, as more tables don't repair a walk that drifts. What meets passes a lossless filter before it is verified:
by the q-gram lemma a run within d edits shares at least m + 1 - q * (d + 1) of the item's q-grams, on diagonals (place in
document less place in item) that differ by d at most. The rest is verified by the edit distance of the item to the best
run around the windows that met.

The decision about a document needs the document and the items alone: no shuffle, no join. Items are sent to the
executors in blocks of a checked size, one pass over the texts for each block.

Null or empty texts, and items without words, match nothing. Repeated rows give equal results, repeated items (equal
words) one result for each item_id; rows of items that agree in id and text are one item. Items without an id are looked for like others and have a null item_id. Items of a few
words match few edits: d is 0 below 1 / max_edit words. Columns of the documents of any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import in_arrow, released

FOUND = "array<struct<item_id:bigint,distance:int,n_words:int,start_word:bigint>>"
#: Places whose walks are taken at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class Rule:
    """max_edit: edits per word of the item; recall: of all tables at Hamming distance far; bits: steps that a table samples; steps: of a walk at most; walks: independent embeddings, each with its share of the tables; span: words of an item's part at most."""

    max_edit: float = 0.2
    recall: float = 0.999
    far: float = 0.6
    bits: int = 2
    seed: int = 23
    walks: int = 4
    steps: int = 24
    span: int = 14

    @property
    def tables(self) -> int:
        """Of each walk."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - (1 - self.far) ** self.bits) / self.walks)

    def steps_of(self, m: int) -> int:
        """Items of no edits have walks that stay inside; others up to twice their words."""
        return m if math.floor(m * self.max_edit + 1e-9) == 0 and m < self.steps else min(self.steps, 2 * m)

    def parts_of(self, m: int) -> list[tuple[int, int]]:
        """Begins and ends of the parts of an item, of about equal lengths."""
        k = -(-m // self.span)
        return [(m * j // k, m * (j + 1) // k) for j in range(k)]

    def samples(self, walk: int, steps: int) -> np.ndarray:
        """The steps that each table of a walk samples."""
        rng = np.random.default_rng((self.seed, walk, steps))
        k = min(self.bits, steps)
        x = np.array([np.sort(rng.choice(steps, k, replace=False)) for _ in range(self.tables)])
        return np.concatenate([x, np.repeat(x[:, -1:], self.bits - k, 1)], 1)


def coins(words: np.ndarray, walk: int, seed: int) -> np.ndarray:
    """64 random bits of each word: bit t says whether a walk moves on from it at step t."""
    return tk.mix(words ^ tk.mix(np.array([seed * 64 + walk + 1], np.uint64))).view(np.int64)


def cgk(words: np.ndarray, bits: np.ndarray, begin: int, end: int, times: list[int], limit: int | None = None) -> dict[int, np.ndarray]:
    """The symbols that the walks from places begin to end - 1 copy at `times`; 0 from `limit` on. Arrays reach max(times) past the end."""
    at, move, out = np.arange(begin, end), np.empty(end - begin, np.int64), {}
    for t in range(times[-1] + 1):
        if t in times:
            out[t] = words.take(at) if limit is None else np.where(at < limit, words.take(at), np.uint64(0))
        bits.take(at, out=move, mode="clip")
        move >>= t
        move &= 1
        at += move
    return out


def code(symbols: dict[int, np.ndarray], sampled: np.ndarray, table: int) -> np.ndarray:
    """A table's hash of the sampled symbols."""
    h = symbols[int(sampled[0])] + np.uint64(table + 1)
    for k, t in enumerate(sampled[1:]):
        h *= ODD[k % 2]
        h ^= symbols[int(t)]
    return h * ODD[len(sampled) % 2]


class Items:
    """The items of one block: their LSH tables, and their grams by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], rule: Rule):
        self.rule = rule
        buf, off = tk.raw(pa.array(texts, pa.large_string()))
        w, woff = tk.words(buf, off, tk.ALNUM_WORDS)
        n = woff[1:] - woff[:-1]
        self.ids = [i for i, m in zip(ids, n, strict=True) if m]
        self.words = [w[a:b] for a, b in zip(woff[:-1], woff[1:], strict=True) if b > a]
        self.m = np.array([len(x) for x in self.words], np.int64)
        self.d = np.floor(self.m * rule.max_edit + 1e-9).astype(np.int64)
        #: The longest grams, up to 3 words, that some shared one is certain for.
        self.q = np.clip(self.m // (self.d + 1), 1, 3)
        self.need = np.maximum(self.m + 1 - self.q * (self.d + 1), 1)
        self.by_q = {}
        for q in np.unique(self.q):
            own = np.flatnonzero(self.q == q)
            grams = [tk.grams(self.words[i], np.array([0, self.m[i]]), int(q), whole=False)[0] for i in own]
            h = np.concatenate(grams)
            item = np.repeat(own, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            self.by_q[int(q)] = (seen, keys, first, count, item[order], place[order])
        self.lsh = [self._tables(walk, steps) for steps in sorted({rule.steps_of(int(m)) for m in self.m}) for walk in range(rule.walks)]

    def _tables(self, walk: int, steps: int) -> tuple:
        """A walk's tables for the parts of items that take so many steps: codes in order, each with its parts, and a quick look.

        A part is its item, and in it the part's first word and the word after its last.
        """
        rule, codes, owners = self.rule, [], []
        sampled = rule.samples(walk, steps)
        times = sorted({int(t) for t in sampled.ravel()})
        for i, a, b in [(i, *p) for i, m in enumerate(self.m.tolist()) if rule.steps_of(m) == steps for p in rule.parts_of(m)]:
            x = self.words[i][a:] if walk % 2 == 0 else self.words[i][:b][::-1]
            m = len(x)
            x = np.concatenate((x, np.zeros(steps, np.uint64)))
            symbols = cgk(x, coins(x, walk, rule.seed), 0, 1, times, m)
            for k, s in enumerate(sampled):
                if all(symbols[int(t)][0] for t in s):  # where a walk has left the item, nothing can agree
                    codes.append(code(symbols, s, k)[0])
                    owners.append((i, a, b))
        h, owner = np.array(codes, np.uint64), np.array(owners, np.int64).reshape(-1, 3)
        order = np.argsort(h, kind="stable")
        keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
        bits = max(18, math.ceil(math.log2(max(len(keys), 1) * 64)))
        seen = np.zeros(1 << bits, bool)
        seen[(keys >> np.uint64(64 - bits)).view(np.int64)] = True
        return walk, sampled, times, keys, first, count, owner[order], seen, np.uint64(64 - bits)


def look_up(h: np.ndarray, keys: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places `at` with hashes h: those that a key equals, once for each of its entries, and the entries."""
    k = np.searchsorted(keys, h)
    k[k == len(keys)] = 0
    same = keys[k] == h
    at, k = at[same], k[same]
    rep = count[k]
    if not len(k):
        return at, k
    return np.repeat(at, rep), np.repeat(first[k] - np.concatenate(([0], np.cumsum(rep)[:-1])), rep) + np.arange(rep.sum())


def candidates(items: Items, w: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows at all places that meet an item in a table: rows, items, and first words (of w; a text may begin later)."""
    n, rule = len(w), items.rule
    row_of = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    found = []
    sides = {}
    for walk, sampled, times, keys, first, count, owner, seen, shift in items.lsh:
        if not len(keys) or not n:
            continue
        back = walk % 2
        if back not in sides:
            sides[back] = np.concatenate((w[::-1] if back else w, np.zeros(rule.steps + 1, np.uint64)))
        x = sides[back]
        bits = coins(x, walk, rule.seed)
        for a in range(0, n, BLOCK):
            symbols = cgk(x, bits, a, min(a + BLOCK, n), times)
            for k, s in enumerate(sampled):
                h = code(symbols, s, k)
                at = np.flatnonzero(seen.take((h >> shift).view(np.int64)))
                if not len(at):
                    continue
                at, entry = look_up(h[at], keys, first, count, at + a)
                if len(at):
                    item, first_word, end_word = owner[entry].T
                    at = n - 1 - at if back else at
                    found.append((row_of[at], item, at + 1 - end_word if back else at - first_word))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row, item, start = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, item, start


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edits from item to a run of text, and the first place in text where such a run ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions
    end = int(row.argmin())
    return int(row[end]), end


def shared_grams(items: Items, w: np.ndarray, woff: np.ndarray, wanted: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which of the pairs (row, item) hold enough shared grams on near diagonals, by the q-gram lemma. wanted: row * items + item, sorted."""
    hits = []
    row_of = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    near = np.zeros(len(woff) - 1, bool)
    near[row] = True
    for q, (seen, keys, first, count, owner, place) in items.by_q.items():
        if len(w) < q:
            continue
        # grams at all places, across rows too: those are dropped only after the look-up, when they are few
        c = [np.uint64(pow(0xA24BAED4963EE407, j + 1, 2**64)) for j in range(q)]
        h = w[: len(w) - q + 1] * c[0]
        for j in range(1, q):
            h += w[j : len(w) - q + 1 + j] * c[j]
        h = tk.mix(h)
        at = np.flatnonzero(seen[h >> np.uint64(44)])
        at = at[(row_of[at] == row_of[at + q - 1]) & near[row_of[at]]]
        at, entry = look_up(h[at], keys, first, count, at)
        hits.append((row_of[at] * len(items.m) + owner[entry], owner[entry], at - place[entry]))
    if not hits:
        return np.zeros(len(row), bool)
    pair, own, diag = (np.concatenate(x) for x in zip(*hits, strict=True))
    k = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
    few = wanted[k] == pair
    pair, own, diag = pair[few], own[few], diag[few]
    if not len(pair):
        return np.zeros(len(row), bool)
    order = np.lexsort((diag, pair))
    pair, own, diag = pair[order], own[order], diag[order]
    # From each hit on, count hits of the same pair on the next d diagonals.
    number = np.cumsum(np.concatenate(([0], pair[1:] != pair[:-1])))
    flat = number * np.int64(diag.max() - diag.min() + items.d.max() + 2) + (diag - diag.min())
    inside = np.searchsorted(flat, flat + items.d[own], "right") - np.arange(len(flat))
    return np.isin(row * len(items.m) + item, np.unique(pair[inside >= items.need[own]]))


def matches(items: Items, w: np.ndarray, woff: np.ndarray) -> dict[int, list[dict]]:
    """Of a chunk of rows: by row, the items that it holds."""
    row, item, start = candidates(items, w, woff)
    if not len(row):
        return {}
    keep = shared_grams(items, w, woff, np.unique(row * len(items.m) + item), row, item)
    row, item, start = row[keep], item[keep], start[keep]
    if not len(row):
        return {}
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    # Windows of one row and item that touch are verified together.
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > items.m[item[1:]]))))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b in zip(cut, np.append(cut[1:], len(row)), strict=True):
        r, i = int(row[a]), int(item[a])
        if best.get((r, i), (1, 0))[0] == 0:
            continue
        x, m, d = items.words[i], int(items.m[i]), int(items.d[i])
        lo, hi = max(int(woff[r]), int(start[a]) - 2 * d), min(int(woff[r + 1]), int(start[b - 1]) + m + 2 * d)
        if hi <= lo:
            continue
        dist, end = distance(x, w[lo:hi])
        if dist <= d and dist < best.get((r, i), (d + 1, 0))[0]:
            back, length = distance(x[::-1], w[lo : lo + end][::-1])
            best[r, i] = (dist, lo - int(woff[r]) + (end - length if back == dist else max(0, end - m)))
    out: dict[int, list[dict]] = {}
    for (r, i), (dist, at) in best.items():
        out.setdefault(r, []).append({"item_id": items.ids[i], "distance": dist, "n_words": int(items.m[i]), "start_word": at})
    return out


def blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The distinct items in blocks of about block_bytes of text, each collected alone."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r[0] for r in part], [r[1] for r in part]


def scan(docs: DataFrame, ids: list[int], texts: list[str], rule: Rule, text_col: str = "text") -> DataFrame:
    """(row, found): each row of docs as a struct, and the items of one block that its text holds."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = rows.select("row", F.expr(f"CAST(NULL AS {FOUND})").alias("found")).schema
    sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value, rule)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("start_word", pa.int64())]))
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            if items.ids:
                for i, _, buf, off in tk.chunks(batch.column("row").field(text_col)):
                    for r, x in matches(items, *tk.words(buf, off, tk.ALNUM_WORDS)).items():
                        found[i + r] = sorted(x, key=lambda y: (y["item_id"] is not None, y["item_id"] or 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "found"])

    return in_arrow(rows, released(run), schema)


def find_contamination(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start_word): one row per document row and item that it holds."""
    out = None
    for ids, texts in blocks(items, block_bytes):
        found = scan(docs.select("doc_id", "text"), ids, texts, rule).filter(F.size("found") > 0)
        part = found.select("row.doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    for ids, texts in blocks(items, block_bytes):
        own = [F.col("row").getField(c).alias(c) for c in docs.columns]
        docs = scan(docs, ids, texts, rule).filter(F.size("found") == 0).select(*own)
    return docs
