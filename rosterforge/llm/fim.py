"""Fill-in-the-middle: each text cut at two places into prefix, middle and suffix, and written with sentinels in another order.

A byte automaton, given as a table, reads each text once. Its state is the number of continuation bytes that are due and
the longest end of the text that begins a sentinel; each transition says whether a unit (a code point) begins and whether a
sentinel ends with it. The transitions of a text are counted: the first count is its number of units n, the second tells whether
it holds a sentinel. A second pass finds the bytes of the two cuts: the counts of blocks lead to the block of a cut, and only
that block is looked into.

The state depends on the last few bytes alone (three, or a sentinel's length), so the blocks of a batch are read side by side, each
from a few bytes before its own, and one look-up moves all of them by a byte. Texts are divided by the byte 0xFF, which is no
part of UTF-8 and leads back to the first state.

Cuts, form and order follow from the sha256 of `seed:doc_id` alone, so a document's result is the same in every run and on
every executor. No text meets another: no shuffle, and no bound on a text's length but a worker's memory (about eight times the text).

Null texts are empty. Empty texts and texts that hold a sentinel stay as they are ("plain"), as does the stated part of the rest.
A null id is hashed as no digits. Repeated rows give equal results; an empty table gives an empty one. All columns are kept; one
called `fim` is replaced by the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import in_arrow

RESULT = "struct<output:string,form:string,n:bigint,prefix_chars:bigint,middle_chars:bigint>"
#: What a transition says.
UNIT, SENTINEL = 1, 2
#: Divides texts.
END = 0xFF
#: Bytes of a block, and blocks that are looked into at a time for cuts.
BLOCK, LOOK = 512, 4096


@dataclass(frozen=True)
class Rule:
    """plain, spm: percent of the documents that stay as they are, and of the others that begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    spm: int = 20
    seed: int = 1

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def check(self) -> None:
        """What joins parts may not look like a sentinel: none may hold another or begin as another ends."""
        for a in self.sentinels:
            for b in self.sentinels:
                if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")
        if len(set(self.sentinels)) < 3:
            raise ValueError("sentinels must differ")


@dataclass(frozen=True)
class Automaton:
    """step: the next state times 256, by state times 256 plus byte; says: what the transition says; warm: bytes that fix the state."""

    step: np.ndarray
    says: np.ndarray
    warm: int

    @classmethod
    def build(cls, sentinels: tuple[str, ...]) -> Automaton:
        words = [s.encode() for s in sentinels]
        begun = sorted({w[:k] for w in words for k in range(len(w) + 1)})
        number = {p: i for i, p in enumerate(begun)}
        step, says = np.zeros((4, len(begun), 256), np.int32), np.zeros((4, len(begun), 256), np.uint8)
        for due in range(4):
            for p, i in number.items():
                for byte in range(END):
                    follows = byte & 0xC0 == 0x80 and due > 0
                    then = due - 1 if follows else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                    s = p + bytes([byte])
                    hit = any(s.endswith(w) for w in words)
                    while s not in number:
                        s = s[1:]
                    step[due, i, byte] = then * len(begun) + number[s]
                    says[due, i, byte] = UNIT * (not follows) + SENTINEL * hit
        return cls((step * 256).ravel(), says.ravel(), max(3, *map(len, words)))

    def read(self, text: np.ndarray) -> np.ndarray:
        """What the transition at each byte says, as rows of BLOCK bytes; text ends are END bytes."""
        blocks = max(1, -(-len(text) // BLOCK))
        padded = np.full(self.warm + blocks * BLOCK, END, np.uint8)
        padded[self.warm : self.warm + len(text)] = text
        lanes = np.lib.stride_tricks.as_strided(padded, (self.warm + BLOCK, blocks), (1, BLOCK))
        out, at = np.empty((BLOCK, blocks), np.uint8), np.zeros(blocks, np.int32)
        for t in range(self.warm + BLOCK):
            at += lanes[t]
            if t >= self.warm:
                self.says.take(at, out=out[t - self.warm], mode="clip")
            at = self.step.take(at)
        return np.ascontiguousarray(out.T)


@dataclass
class Scan:
    """The first pass over some texts: what each byte says, and the bytes and units before each text."""

    said: np.ndarray
    first: np.ndarray
    units: np.ndarray
    holds: np.ndarray

    @classmethod
    def of(cls, automaton: Automaton, buf: np.ndarray, off: np.ndarray) -> Scan:
        n = len(off) - 1
        first = off + np.arange(n + 1)  # each text is followed by END
        text = np.insert(buf, off[1:], END) if n else buf
        said = automaton.read(text)
        flat = said.ravel()[: len(text)]
        units = np.concatenate(([0], np.cumsum(np.add.reduceat(flat & UNIT, first[:-1], dtype=np.int64)))) if n else np.zeros(1, np.int64)
        holds = np.maximum.reduceat(flat, first[:-1]) >= SENTINEL if n else np.zeros(0, bool)
        return cls(said, first, units, holds)

    @cached_property
    def counts(self) -> np.ndarray:
        """Units up to the end of each block."""
        return np.cumsum((self.said & UNIT).sum(1, dtype=np.int64))

    def places(self, rows: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The second pass: in texts `rows`, the bytes before their `unit`-th unit; at n, the text's length."""
        wanted, out = self.units[rows] + unit, np.empty(len(rows), np.int64)
        end = unit == self.units[rows + 1] - self.units[rows]
        out[end] = self.first[rows[end] + 1] - 1 - self.first[rows[end]]
        inside = np.flatnonzero(~end)
        for k in range(0, len(inside), LOOK):
            i = inside[k : k + LOOK]
            block = np.searchsorted(self.counts, wanted[i], "right")
            before = self.counts[block] - (self.said[block] & UNIT).sum(1, dtype=np.int64)
            upto = np.cumsum(self.said[block] & UNIT, 1, dtype=np.int32)
            place = np.argmax(upto > (wanted[i] - before)[:, None], 1)
            out[i] = block * BLOCK + place - self.first[rows[i]]
        return out


def numbers(seed: int, doc_id: object) -> tuple[int, ...]:
    """The first four groups of eight hexadecimal digits of a document's digest."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def rewrite(rule: Rule, automaton: Automaton, ids: list, column: pa.Array) -> Iterator[dict]:
    """The result of each text, in order."""
    p, s, m = (x.encode() for x in rule.sentinels)
    for i, j, buf, off in tk.chunks(column):
        scan = Scan.of(automaton, buf, off)
        n = np.diff(scan.units)
        h = [numbers(rule.seed, x) for x in ids[i:j]]
        cuts = np.array([sorted((a % (k + 1), b % (k + 1))) for (a, b, _, _), k in zip(h, n.tolist(), strict=True)], np.int64)
        moved = np.flatnonzero((n > 0) & ~scan.holds & np.array([x[2] % 100 < 100 - rule.plain for x in h], bool))
        at = np.zeros((len(n), 2), np.int64)
        for side in range(2):
            at[moved, side] = scan.places(moved, cuts[moved, side])
        cut = set(moved.tolist())
        for r in range(j - i):
            t = buf[off[r] : off[r + 1]].tobytes()
            if r not in cut:
                yield {"output": t.decode("utf-8", "replace"), "form": "plain", "n": int(n[r]), "prefix_chars": None, "middle_chars": None}
                continue
            a, b = at[r].tolist()
            spm = h[r][3] % 100 < rule.spm
            out = s + t[b:] + p + t[:a] + m + t[a:b] if spm else p + t[:a] + s + t[b:] + m + t[a:b]
            x, y = cuts[r].tolist()
            yield {"output": out.decode("utf-8", "replace"), "form": "spm" if spm else "psm", "n": int(n[r]), "prefix_chars": x, "middle_chars": y - x}


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `fim`: output, form (plain, psm or spm), n units, and the units of prefix and middle (null if plain)."""
    rule.check()
    docs = docs.drop("fim")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = rows.select("row", F.expr(f"CAST(NULL AS {RESULT})").alias("fim")).schema
    kind = pa.struct([("output", pa.string()), ("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.build(rule.sentinels)
        for batch in batches:
            row = batch.column("row")
            found = list(rewrite(rule, automaton, row.field(id_col).to_pylist(), row.field(text_col)))
            yield pa.RecordBatch.from_arrays([row, pa.array(found, kind)], ["row", "fim"])

    out = in_arrow(rows, run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "fim")


def restore(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output and its form were made of: cut at the sentinels and put in order."""
    quoted = "|".join(rf"\Q{x}\E" for x in rule.sentinels)
    parts = F.split(output, quoted, -1)
    order = lambda *k: F.concat(*[F.get(parts, F.lit(i)) for i in k])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)
