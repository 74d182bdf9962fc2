"""Token ids of whole texts by the tokenizers library, in the workers, with a bounded memory of words.

A byte-level pre-tokenizer always cuts before a single space that stands between two characters that aren't white
space. So such a piece, space included, has the same ids wherever it stands. A piece of ASCII and Latin letters, digits and marks, without
an apostrophe, is cut on into the pre-tokenizer's words, which are its runs of one kind: texts are cut by arrays of their bytes, the words of
many texts are numbered by Arrow, and only distinct ones are looked at. Another piece stays whole until then; if it is of common letters
and marks, the pre-tokenizer's own pattern cuts it. Only words that the worker doesn't remember go to the library. Texts that
hold the string of an added token, such as an end mark, go to the library whole: there it is that token.

A tokenizer whose words end with a mark and that drops white space (WordEncoder) is cut at white space. Tokenizers of other kinds
get the whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import MEMORIES

#: Texts that a cut by bytes could cut wrongly: white space beyond ASCII beside a space (RE2).
WIDE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = f"{WIDE} | {WIDE}"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed pattern of the byte-level pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Kinds of bytes: a space, letters, digits, marks, a line break, and bytes whose piece is left whole. Letters beyond ASCII are those of
#: U+00C0 to U+023F: their first bytes, and any byte that isn't a character's first. White space of ASCII.
SPACE, LETTER, DIGIT, MARK, BREAK, ODD = range(6)
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*b"0123456789"]] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
KIND[[*b" \n'"]] = SPACE, BREAK, ODD
WHITE = np.zeros(256, bool)
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: One word of the pattern, by its kinds of bytes alone (RE2).
PLAIN = r"\A(?: ?(?:[A-Za-zÀ-ÖØ-öø-ȿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n)\z"
#: Pieces whose characters the pattern reads alike in both libraries: ASCII and Latin letters, and line breaks inside (RE2).
COMMON = r"\A [!-~¡-¬®-ɏ](?:[\n!-~¡-¬®-ɏ]*[!-~¡-¬®-ɏ])?\z"
#: A memory of so many words is closed; the one closed before it is forgotten.
MOST = 500_000
#: New words in one call.
RUN = 500


#: Rows whose ids are laid out at a time, bytes of text that are cut into pieces at a time, and distinct pieces that are looked at at a time.
ROWS, SLICE, PIECES = 1 << 16, 2 << 20, 1 << 16


def runs(flat: np.ndarray, start: np.ndarray, count: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + count] of each row in a row, and the rows' offsets. number: the rows in this order, else each once."""
    rows = len(start) if number is None else len(number)
    own = [slice(k, k + ROWS) if number is None else number[k : k + ROWS] for k in range(0, rows, ROWS)]
    ends = np.zeros(rows + 1, np.int64)
    for k, x in enumerate(own):
        ends[k * ROWS + 1 : (k + 1) * ROWS + 1] = count[x]
    np.cumsum(ends, out=ends)
    out = np.empty(ends[-1], flat.dtype)
    for k, x in enumerate(own):
        to = ends[k * ROWS : (k + 1) * ROWS + 1]
        at = np.repeat(start[x] - to[:-1], count[x])
        at += np.arange(to[0], to[-1])
        out[to[0] : to[-1]] = flat[at]
    return out, ends


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about SLICE bytes, a longer text alone or last."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    cuts = np.searchsorted(ends, np.arange(SLICE, ends[-1], SLICE)) + 1 if len(ends) else []
    bounds = np.unique(np.concatenate(([0], cuts, [len(ends)]))).astype(int).tolist()
    for a, b in pairwise(bounds):
        yield texts.slice(a, b - a)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that aren't UNEVEN, odd pieces as one, in a row, and how many each text has."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    n = int(off[-1] - off[0])
    if not n:
        return texts.slice(0, 0), np.zeros(len(texts), np.int64)
    raw, off = np.frombuffer(texts.buffers()[2], np.uint8, n, off[0]), off - off[0]
    kind, white, some = KIND[raw], WHITE[raw], np.diff(off) > 0
    piece, alone = np.zeros(n, bool), white.copy()
    piece[off[:-1][some]] = True
    alone[1:] &= ~white[:-1]
    alone[:-1] &= ~white[1:]
    alone[off[:-1][some]] = alone[off[1:][some] - 1] = False
    space = alone & (kind == SPACE)
    piece |= space
    start = piece.copy()
    start[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
    odd = (kind == ODD) | (white & ~alone)
    odd[:-1] |= (raw[:-1] == 0xC3) & (raw[1:] & 0xDF == 0x97)  # × and ÷ are marks
    if odd.any():
        number = np.cumsum(piece, dtype=np.int32) - 1
        whole = np.zeros(number[-1] + 1, bool)
        whole[number[odd]] = True
        start &= piece | ~whole[number]
    at = np.flatnonzero(start)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, n)), pa.py_buffer(raw)])
    return words, np.diff(np.searchsorted(at, off))


def strings(x: pa.Array) -> list[str]:
    """x.to_pylist(), by way of an array of objects, which is several times as fast."""
    return x.to_numpy(zero_copy_only=False).tolist()


def pieces_of(text: str) -> list[str]:
    """The pieces of any text, spaces included."""
    first, *others = CUT.split(text)
    return [first, *(" " + x for x in others)]


#: A byte-level vocabulary's character for each byte: its own if it can be seen, else one of those from 256.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CHARACTER = {x: x for x in SEEN} | {x: 256 + k for k, x in enumerate(sorted(set(range(256)) - set(SEEN)))}


def byte_level(word: str) -> str:
    """A word as a byte-level vocabulary writes it."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", "Ġ")
    return word.encode().decode("latin-1").translate(CHARACTER)


class Memory:
    """Words' numbers and, by number, their ids."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        """New words, their ids and the offsets of these."""
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends[1:]))
        self.flat = np.concatenate((self.flat, flat))


class Encoder:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        j = json.loads(spec)
        pre = j.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not j.get("normalizer") and j["model"]["type"] == "BPE" and not j["model"].get("dropout")
        #: Strings that are tokens of their own, whatever stands around them.
        self.added = [x["content"] for x in j.get("added_tokens", ()) if x["content"]]
        self.model = self.tokenizer.model
        self.memory, self.old = Memory(), Memory()

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """By the library alone."""
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the texts' offsets. texts: strings without nulls."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = np.full(len(texts), not self.by_piece)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        uneven = ~whole & pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        even = ~whole & ~uneven
        own = [np.zeros(0, np.uint32)] * len(texts)  # of texts that aren't even, one by one
        for i, x in zip(np.flatnonzero(whole).tolist(), self.ids(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            own[i] = x
        if even.all():
            return self._of_lists(map(cut, slices(texts)))
        lists = map(cut, slices(texts.filter(pa.array(even))))
        if uneven.any():
            by_hand = [pieces_of(x) for x in texts.filter(pa.array(uneven)).to_pylist()]
            lists = chain(lists, [(pa.array(chain.from_iterable(by_hand), pa.large_string()), np.array(list(map(len, by_hand))))])
        at = np.concatenate((np.flatnonzero(even), np.flatnonzero(uneven)))
        flat, off = self._of_lists(lists)
        count = np.array([len(x) for x in own], np.int64)
        count[at] = np.diff(off)
        ends = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(ends[-1], np.uint32)
        spot = np.repeat(ends[at] - off[:-1], count[at])
        spot += np.arange(len(flat))
        out[spot] = flat
        for i in np.flatnonzero(whole).tolist():
            out[ends[i] : ends[i + 1]] = own[i]
        return out, ends

    def _of_lists(self, lists: Iterator[tuple[pa.Array, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as words or whole pieces, in arrays, and how many each text has. Of each array only numbers are kept."""
        coded, sizes = [], []
        for words, size in lists:
            coded.append(words.dictionary_encode())
            sizes.append(size)
            del words
        if not coded:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        off = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
        chunks = pa.chunked_array(coded).unify_dictionaries().chunks
        pieces, number = chunks[0].dictionary, np.concatenate([x.indices.to_numpy() for x in chunks])
        del coded, chunks, sizes
        parts = [self._of_pieces(pieces.slice(k, PIECES)) for k in range(0, len(pieces), PIECES)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in parts)])
        count = np.concatenate([np.zeros(0, np.int64), *(np.diff(x) for _, x in parts)])
        del parts
        out, where = runs(flat, np.cumsum(count) - count, count, number)
        return out, where[off]

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and pieces, and their offsets."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._of_words(strings(pieces))
        common = pc.match_substring_regex(pieces, COMMON).to_numpy(zero_copy_only=False) & ~plain
        other = ~plain & ~common
        own = pieces.filter(pa.array(common))
        text = "".join(strings(own))
        words, n = WORD.findall(text), int(plain.sum())
        flat, ends = self._of_words(strings(pieces.filter(pa.array(plain))) + words)
        # Words end where pieces end: both are counted in characters.
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum(pc.utf8_length(own).to_numpy())) + 1
        whole = self.ids(strings(pieces.filter(pa.array(other))))
        start, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        start[plain], count[plain] = ends[:n], np.diff(ends[: n + 1])
        count[common] = np.diff(ends[n + last], prepend=ends[n])
        start[common] = ends[n + last] - count[common]
        count[other] = [len(x) for x in whole]
        start[other] = len(flat) + np.cumsum(count[other]) - count[other]
        return runs(np.concatenate([flat, *whole]), start, count)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the pattern, and their offsets."""
        if len(self.memory.number) > MOST:
            self.memory, self.old = Memory(), self.memory
        m = self.memory
        number = np.fromiter(map(m.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            again = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(again))
            seen = np.fromiter(map(self.old.number.get, new, repeat(-1)), np.int64, len(new))
            known = seen >= 0
            flat, ends = self._by_library([new[i] for i in np.flatnonzero(~known).tolist()])
            start, count = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
            start[known], count[known] = self.old.ends[seen[known]] + len(flat), np.diff(self.old.ends)[seen[known]]
            start[~known], count[~known] = ends[:-1], np.diff(ends)
            m.learn(new, *runs(np.concatenate((flat, self.old.flat)), start, count))
            number[missing] = np.fromiter(map(m.number.get, again), np.int64, len(again))
        return runs(m.flat, m.ends[number], np.diff(m.ends)[number])

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of new words: each is one for the pre-tokenizer, so that only the library's model is asked."""
        ids, ends = [], [0]
        for tokens in map(self.model.tokenize, map(byte_level, words)):
            ids += [x.id for x in tokens]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.array(ends, np.int64)


#: Fixed pattern of the pre-tokenizer that keeps words and drops white space, and the end of a word in its vocabulary.
BARE_WORD, WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
BARE = regex.compile(BARE_WORD)


@cache
def plain_letters() -> str:
    """Of ASCII and Latin characters those that stay one character of their kind when they are composed and lower-cased (RE2 class)."""
    kind = lambda c: unicodedata.category(c)[0]
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) if c != 0xAD]
    own = [c for c in chars if unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and kind(c.lower()) == kind(c)]
    return "".join(rf"\x{{{ord(c):x}}}" for c in own)


class WordEncoder(Encoder):
    """A tokenizer that composes and lower-cases texts, drops white space, and ends the last token of each word with a mark.

    No word crosses white space, so what stands between it has the same ids wherever it stands. Distinct pieces are cut into
    words, and new words go to the library as a list; their ids end at the tokens that have the mark.
    """

    def __init__(self, spec: str):
        super().__init__(spec)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for x, i in vocab.items():
            self.ends_word[i] = x.endswith(WORD_END)
        self.common = rf"\A[{plain_letters()}]*\z"

    @staticmethod
    def reads(j: dict) -> bool:
        """Whether a tokenizer file is of this kind."""
        pre, norm, model = j.get("pre_tokenizer") or {}, j.get("normalizer") or {}, j["model"]
        cut, last = [*pre.get("pretokenizers", ()), None, None][:2]
        return (
            [x["type"] for x in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and bool(cut) and cut.get("pattern") == {"Regex": BARE_WORD} and cut.get("behavior") == "Removed" and cut.get("invert") is True
            and bool(last) and last["type"] == "ByteLevel" and not last.get("use_regex", True) and not last.get("add_prefix_space")
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout") and not model.get("ignore_merges") and not j.get("post_processor")
        )

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        own = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        flat, off = self._of_lists(pc.split_pattern(spaced(own), " "))
        if not whole.any():
            return flat, off
        ids = self.ids(texts.filter(pa.array(whole)).to_pylist())
        count, start = np.diff(off), off[:-1].copy()
        count[whole] = [len(x) for x in ids]
        start[whole] = len(flat) + np.concatenate(([0], np.cumsum(count[whole])))[:-1]
        return runs(np.concatenate([flat, *ids]), start, count)

    def _of_lists(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, ends = self._of_pieces(coded.dictionary)
        number = coded.indices.to_numpy().astype(np.int64)
        out, where = runs(flat, ends[number], np.diff(ends)[number])
        return out, where[off - off[0]] if len(off) else np.zeros(1, np.int64)

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        common = pc.match_substring_regex(pieces, self.common).to_numpy(zero_copy_only=False)
        own = pc.ascii_lower(pieces.filter(pa.array(common)))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.scalar(" ", own.type))[0].as_py()
        words = BARE.findall(text) if len(own) else []
        flat, ends = self._of_words(words)
        # Words end where pieces end: both are counted in characters.
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        last = np.searchsorted(upto, np.cumsum(pc.utf8_length(own).to_numpy()))
        count, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        count[common] = np.diff(ends[last], prepend=0)
        start[common] = ends[last] - count[common]
        other = self.ids(pieces.filter(pa.array(~common)).to_pylist())
        count[~common] = [len(x) for x in other]
        start[~common] = len(flat) + np.concatenate(([0], np.cumsum(count[~common])))[:-1]
        return runs(np.concatenate([flat, *other]), start, count)

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), RUN):
            run = words[k : k + RUN]
            ids = np.array(self.tokenizer.encode_batch_fast([run], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(run):  # a word that the library reads as several, or as none
                each = self.ids(run)
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            out.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def spaced(texts: pa.Array) -> pa.Array:
    """Texts with each of \\x09 to \\x0D as a space."""
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    raw = np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw)
    return pa.Array.from_buffers(texts.type, len(texts), [None, texts.buffers()[1], pa.py_buffer(raw)], offset=texts.offset)


_own: dict[int, Encoder] = {}
MEMORIES.append(_own.clear)


def encoder(spec: str) -> Encoder:
    """This worker's encoder for a tokenizer file's content."""
    if hash(spec) not in _own:
        _own.clear()
        _own[hash(spec)] = (WordEncoder if WordEncoder.reads(json.loads(spec)) else Encoder)(spec)
    return _own[hash(spec)]
