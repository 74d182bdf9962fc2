"""Vectorised text kernels over Arrow string columns: no Python object per word.

A batch's UTF-8 bytes are one numpy array. A word's hash is a polynomial in an odd base modulo 2**64 over random
byte codes; differences of a running sum give every word's hash at once, and multiplying with the inverse power
makes it independent of the word's place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
#: Bytes of text that one vector step takes, unless a single text is longer.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space and \x09-\x0D.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of letters, digits and non-ASCII bytes.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK + 1)
        for k, b in (("p", BASE), ("i", BASE_INV)):
            x = np.full(size, b, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all of its input."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' offsets; nulls are empty."""
    a = column.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), off
    return np.frombuffer(data, np.uint8)[: off[-1]], off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes: first row, end row, their bytes, and offsets within these."""
    if not len(column):
        return
    buf, off = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and the rows' offsets into them. A-Z count as a-z."""
    if not len(buf):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    inside = kind[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True  # a row's first byte begins a word even if the row before ends in one
    was = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~was | first[:-1]))
    nxt = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~nxt | first[1:])) + 1
    p, inv = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(CODES[LOWER[buf]] * p[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts]), np.searchsorted(starts, off)


def sequence_hash(w: np.ndarray, off: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    p, inv = powers(len(w) + 1)
    total = np.zeros(len(w) + 1, U64)
    np.cumsum(mix(w ^ U64(salt)) * p[: len(w)], out=total[1:])
    n = (off[1:] - off[:-1]).astype(U64)
    return mix((total[off[1:]] - total[off[:-1]]) * inv[off[:-1]] + n * U64(0xD6E8FEB86659FD93))


def grams(w: np.ndarray, off: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word grams, and offsets. With whole, a row of 1 to k - 1 words is one gram."""
    n = off[1:] - off[:-1]
    count = np.maximum(n - k + 1, 0)
    if whole:
        count[(n > 0) & (n < k)] = 1
    out = np.concatenate(([0], np.cumsum(count)))
    if not out[-1]:
        return np.zeros(0, U64), out
    at = np.repeat(off[:-1] - out[:-1], count) + np.arange(out[-1])
    length = np.repeat(np.minimum(n, k), count)
    h = np.zeros(out[-1], U64)
    for j in range(k):
        c = U64(pow(0xA24BAED4963EE407, j + 1, 2**64))
        if whole:
            here = j < length
            h += np.where(here, w[np.minimum(at + j, len(w) - 1)], U64(0)) * c
        else:
            h += w[at + j] * c
    return mix(h), out


def distinct(h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each row's sorted distinct values."""
    return [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
