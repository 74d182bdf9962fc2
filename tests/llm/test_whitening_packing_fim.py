"""Whitening, packing and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterforge.llm import fim, packing, queries, tokenise, whitening
from rosterforge.llm.common import Scratch
from rosterforge.llm.whitening import Moments

# 11

VECTORS = "vec_id long, embedding array<float>, x int, id int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], VECTORS)


def brute_whitening(rows, components=16):
    """Exact moments in fractions; eigenvectors of the rounded covariance."""
    x = [(i, [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = [[Fraction(a) - Fraction(b, n) for a, b in zip(v, s, strict=True)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in d) / n) for j in range(len(s))] for i in range(len(s))])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = {}
    for i, v in x:
        far = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        out.setdefault((i, tuple(v)), (far, np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(v, s, strict=True)]) @ basis / np.sqrt(np.maximum(values, 1e-300))))
    return n, values, np.trace(cov), out


def random_vectors(n, dim, seed=3):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, dim)) * np.linspace(1, 4, dim) + 1).astype(np.float32)
    x[n // 2 :: 3] = x[0]  # copies
    return [(i, v.tolist()) for i, v in enumerate(x)]


def compare(got, rows, components=16):
    n, values, trace, want = brute_whitening(rows, components)
    assert len(got) == len(rows) * len(values)
    by = defaultdict(dict)
    for r in got:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
        by[r.vec_id][r.component] = r
    signs = None
    for (i, _), (far, white) in want.items():
        own = [by[i][k + 1] for k in range(len(values))]
        assert {r.deviation for r in own} == {far}
        own = np.array([r.whitened for r in own])
        signs = np.sign(own * white) if signs is None else signs
        assert np.allclose(own, white * signs, atol=1e-7)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_exact_moments(spark, parts):
    rows = random_vectors(200, 5)
    compare(whitening.whiten(vectors(spark, rows).repartition(parts)).collect(), rows)


def test_whitening_through_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    compare(queries.op11_whitening(spark, sf).collect(), rows)


def test_chan_merging_keeps_digits_that_sums_of_squares_lose():
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (4000, 3)) + 10**15
    whole = Moments.of(x)
    m = Moments.none(3)
    for a in range(0, 4000, 37):
        m = m.merge(Moments.of(x[a : a + 37]))
    d = 4000 * (x - 10**15) - (x - 10**15).sum(0)
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(d[:, i], d[:, j], strict=True)) / 4000**2 for j in range(3)] for i in range(3)])
    assert m.total == whole.total and np.allclose(m.scatter, exact, rtol=1e-12) and np.allclose(whole.scatter, exact, rtol=1e-12)
    y = (x - 10**15) / 7
    assert np.allclose(Moments.of(y[:1500]).merge(Moments.of(y[1500:])).scatter, exact / 49, rtol=1e-12)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**40, 5], [7, -(2**40)], [1, 2]], np.int64)
    s = [int(v) for v in x.sum(0)]
    assert whitening.deviations(x, s, 3) == [sum((3 * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert whitening.deviations(x // 2**35, [3, 4], 10**9) == [sum((10**9 * int(a) - b) ** 2 for a, b in zip(row, [3, 4], strict=True)) for row in x // 2**35]


def test_whitening_drops_what_cannot_be_used(spark):
    nan, inf = float("nan"), float("inf")
    good = random_vectors(30, 3, 8)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 0.0, 0.0]), (105, [-inf, 0.0, 0.0]), (106, [1e30, 0.0, 0.0]), (107, [1.0, 2.0])]
    again = [(None, good[3][1]), (5, good[5][1])]  # a null id and a repeated row
    got = whitening.whiten(vectors(spark, good + bad + again)).collect()
    assert Counter(r.vec_id for r in got) == Counter({i: 3 for i, _ in good} | {None: 3, 5: 6})
    assert {round(r.whitened, 9) for r in got if r.vec_id is None} == {round(r.whitened, 9) for r in got if r.vec_id == 3}


def test_whitening_of_little_variance_and_of_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(i, k, 1, 0, None, 0.0) for i in (1, 2) for k in (1, 2)]
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 5.0]) for i in range(6)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in flat)
    assert [r.explained for r in flat[:2]] == [pytest.approx(1.0), 0.0]


# 12

TEXTS = [(1, None), (2, ""), (3, "one two, THREE!"), (4, "it's " * 4000), (5, "dup"), (5, "dup"), (None, "null id"), (6, "x" * 30000), (7, "<|endoftext|> É 漢字"), (8, " \n\t ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, sequence_id int, ids int, fim int")


def documents(n=300, seed=4):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["alpha", "beta,", "Gamma", "don't", "42nd"]) for _ in range(int(r.paretovariate(0.7) * 12) % 9000))) for i in range(n)]


def check_packing(got, rows, tiers=packing.TIERS):
    """Pieces make up each document's ids without gaps, sequences are full, and nothing is padded."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for (i, ids), k in want.items():
        own = [r for r in by_doc[i] if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())]
        places = Counter((r.start, r.length) for r in own)
        if k == 1 and len({d for d in want if d[0] == i}) == 1:
            assert len(own) == len(by_doc[i])
            at = 0
            for start, length in sorted(places):
                assert start == at and places[start, length] == 1 and length > 0
                at += length
            assert at == len(ids)
        else:
            assert sum(r.length for r in own) >= k * len(ids)
    assert sum(r.length for r in got) == sum(len(ids) * k for (_, ids), k in want.items())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= max(tiers) and at & (at - 1) == 0 and {r.n_tokens for r in own} == {at}
    return by_sequence


def packed(spark, rows, tiers=packing.TIERS, parts=3):
    path = Scratch(spark, "packtest").path("p")
    packing.write_packed(frame(spark, rows).repartition(parts), path, queries.tokenizer_path("word_bpe_49k.json"), 2, tiers)
    return packing.read_packed(spark, path)


def test_packing_is_whole_and_full(spark):
    rows = TEXTS + [(1000 + i, t) for i, t in documents()]
    x = packed(spark, rows)
    sequences = check_packing(packing.pieces_of(x).collect(), rows)
    assert Counter(len({p.n_tokens for p in own}) for own in sequences.values()) == {1: len(sequences)}
    short = [s for s, own in sequences.items() if own[0].n_tokens < 256]
    assert len(short) <= 3 * 8 and {r.sequence_id for r in x.collect()} == set(sequences)


def test_packing_through_the_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(queries.op12_packing(spark, sf).collect(), rows)


def test_packing_of_nothing_and_odd_tiers(spark):
    assert packing.pieces_of(packed(spark, [])).count() == 0 and packing.step_groups(packed(spark, [])).count() == 0
    rows = documents(60, 9)
    check_packing(packing.pieces_of(packed(spark, rows, (8, 64))).collect(), rows, (8, 64))
    with pytest.raises(ValueError):
        packing.Packer((100,))


def test_short_pieces_fill_long_gaps_before_anything_is_cut():
    piece = lambda i, n: packing.Piece(i, 0, n, np.zeros(n, np.uint32))
    packer = packing.Packer((16, 64))
    got = list(packer.add(iter([piece(1, 40), piece(2, 20), piece(3, 4), piece(4, 64), piece(5, 130), piece(6, 14)])))
    assert [[(p.doc_id, len(p.ids)) for p in own] for own in got] == [[(4, 64)], [(5, 64)], [(5, 64)], [(1, 40), (2, 20), (3, 4)], [(6, 14), (5, 2)]]
    assert list(packer.end()) == []


def test_step_groups_balance_tokens_and_cost(spark):
    r = random.Random(2)
    rows = [(i, r.choice([256, 1024]), r.randrange(1000, 100000), None, None) for i in range(3000)]
    x = spark.createDataFrame(rows, packing.SEQUENCE).repartition(5)
    got = packing.step_groups(x, 1 << 14, parts=4).collect()
    for tier in (256, 1024):
        own = sorted((g for g in got if g.n_tokens == tier), key=lambda g: (g.cost, g.sequence_id))
        assert [g.step for g in own] == [k * tier // (1 << 14) for k in range(len(own))]


def test_word_encoder_equals_the_library():
    with open(queries.tokenizer_path("word_bpe_49k.json")) as f:
        e = tokenise.WordEncoder(f.read())
    odd = ["", " ", "It's  DON'T\n42nd—x ŉ İ ÀÉ naïve", "a\x1cb\x85c d e", "<|endoftext|> hi <|x", "ﬁ Å Ω K", "漢字 テスト 😀!!", "'sam ''s !'s 're're", "é ́a İ i", "²³ ¼x ªº µ ß", "x" * 3000, "a\tb\rc\x0bd\x0ce", "Σ ΑΣ ας"]
    r = random.Random(1)
    pool = [c for t in odd[:10] for c in t] + list("  abc'\n")
    odd += ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(2000)]
    for part in (odd, odd[7:], ["plain words"] * 3, []):
        flat, off = e.encode(pa.array(part, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [x.tolist() for x in e.ids(part)]


# 13


def brute_fim(rows, rule=fim.Rule()):
    out = []
    p, s, m = rule.sentinels
    for i, t in rows:
        t = t or ""
        h = hashlib.sha256(f"{rule.seed}:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(x in t for x in rule.sentinels) or h3 % 100 >= 100 - rule.plain:
            out.append((i, len(t), "plain", None, None, t))
        elif h4 % 100 < rule.spm:
            out.append((i, len(t), "spm", a, b - a, s + t[b:] + p + t[:a] + m + t[a:b]))
        else:
            out.append((i, len(t), "psm", a, b - a, p + t[:a] + s + t[b:] + m + t[a:b]))
    return Counter(out)


def odd_texts(n=600, seed=6):
    r = random.Random(seed)
    pool = ["a", "é", "漢", "😀", "<", ">", "<P", "P>", "<S", "<M>", "\n", "\x00", "word " * 50, "x" * 509, "\U0010ffff"]
    return [(i, "".join(r.choice(pool[: r.choice([9, 15])]) for _ in range(r.randrange(40)))) for i in range(n)]


EDGE = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id, é"), (4, "ends with <P>"), (5, "<P"), (6, ">"), (7, "<S>" * 3), (8, "漢字😀" * 60000), (9, "z" * 512), (10, "y" * 511 + "é" * 600)]


@pytest.mark.parametrize("rule", [fim.Rule(), fim.Rule(plain=0, spm=50, seed=9), fim.Rule("[[fim:pre]]", "[[fim:suf]]", "[[é]]", plain=0)])
def test_fim_equals_plain_python(spark, rule):
    rows = EDGE + [(100 + i, t) for i, t in odd_texts()]
    x = fim.fill_in_middle(frame(spark, rows), rule)
    assert x.columns == ["doc_id", "text", "sequence_id", "ids", "fim"]
    y = x.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "fim.*").withColumn("back", fim.restore(F.col("output"), F.col("form"), rule)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in y) == brute_fim(rows, rule)
    assert all(r.back == r.t for r in y)
    if rule.plain == 0:
        assert {r.form for r in y} == {"plain", "psm", "spm"}


def test_fim_of_nothing_and_of_bad_sentinels(spark):
    assert fim.fill_in_middle(frame(spark, [])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("ab", "bc", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark, []), fim.Rule(*bad))


def test_automaton_reads_blocks_side_by_side_as_one_by_one():
    """The table read from the first byte on, one after another, against the blocks; for bytes that are no UTF-8 as well."""
    a = fim.Automaton.build(("<P>", "<S>", "<M>"))
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(0, 255, 3000), np.frombuffer("<P>é漢😀<S><<M>".encode() * 200, np.uint8), r.choice([0x80, 0xF0, 0x3C, 0x50, 0x3E, 0xFF], 3000)]).astype(np.uint8)
    at, want = 0, []
    for b in text.tolist():
        want.append(int(a.says[at + b]))
        at = int(a.step[at + b])
    assert a.read(text).ravel()[: len(text)].tolist() == want


def test_fim_through_the_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = dict(rows)
    want = {(i, n, form, a, b, sha(out), sha(texts[i] or "")) for (i, n, form, a, b, out) in brute_fim(rows)}
    got = queries.op13_fill_in_middle(spark, sf).collect()
    assert len(got) == len(rows) and set(map(tuple, got)) == want
