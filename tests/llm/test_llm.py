"""The training-data operators against brute force, round trips and held-out rows."""

import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rosterforge.llm import chat, common, decontaminate, exact_dedup, langid, mixing, pii, quality, queries, sharding, textkernel, tokenise, wavelet
from rosterforge.llm import minhash as mh
from rosterforge.llm.common import Scratch
from rosterforge.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, id long, _bucket int"
LONG = "lorem ipsum dolor sit amet " * 5000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, "ONE two"), (7, LONG), (8, LONG + "x"), (None, "one two"), (None, None), (9, "É ünï 漢字 \U0001f600 a<b #c \\d"), (10, "a" * 70000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else "src1", None, "clash", 0, 0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def random_docs(n, seed, words=60, vocabulary=400):
    r = random.Random(seed)
    pool = ["w%d" % i for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = list(r.choice(out))
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(pool)
        else:
            w = [r.choice(pool) for _ in range(r.randrange(3, words))]
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


# 1


def brute_exact(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        g = [x for x in groups[lower(t)] if x is not None]
        keep = pick(g) if g else None
        out.append((i, keep, len(groups[lower(t)]), i == keep if i is not None else keep is None, hashlib.sha256(lower(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda c: F.lit("all"), lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)])
@pytest.mark.parametrize("bound", [0, 1000])
def test_exact_dedup_survives_collisions(spark, edge, none, digest, bound):
    got = exact_dedup.exact_dedup(edge, keep="largest", digest=digest, broadcast_rows=bound).collect()
    assert Counter(map(tuple, got)) == brute_exact(EDGE, max)
    if bound:
        assert exact_dedup.exact_dedup(none, digest=digest).count() == 0


def test_exact_dedup_keeps_the_smallest(edge):
    assert Counter(map(tuple, exact_dedup.exact_dedup(edge).collect())) == brute_exact(EDGE, min)


def test_drop_exact_copies(spark):
    docs = frame(spark, [(1, "A b"), (2, "a B"), (3, "c")])
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()) == [1, 3]


# 2


def waterfill(b, nodes):
    """nodes: {key: (w, cap)}; by bisection, unlike the operator."""
    lo, hi = 0.0, 1e12
    if sum(c for w, c in nodes.values() if w > 0) <= b:
        return {k: c if w > 0 else 0.0 for k, (w, c) in nodes.items()}
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for w, c in nodes.values()) < b else (lo, mid)
    return {k: min(c, lo * w) for k, (w, c) in nodes.items()}


def brute_budgets(leaves, budget, weights, epochs):
    def below(prefix):
        return {k: v for k, v in leaves.items() if k[: len(prefix)] == prefix}

    def go(prefix, b):
        level = len(prefix)
        if level == 3:
            return {prefix: b}
        names = {k[level] for k in below(prefix)}
        w = weights.get(mixing.LEVELS[level], {})
        got = waterfill(b, {n: (w.get(n, 1.0), epochs * sum(below((*prefix, n)).values())) for n in names})
        return {k: v for n in names for k, v in go((*prefix, n), got[n]).items()}

    return go((), budget)


@pytest.mark.parametrize("part, epochs", [(0.6, 2), (0.05, 1), (5.0, 3), (0.9, 1)])
def test_mix_takes_the_budgets(spark, sf, part, epochs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = queries.MIX_WEIGHTS
    rows = docs.select("doc_id", queries.domain(F.col("source")).alias("d"), "lang", "source", "text").collect()
    n = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    leaves = Counter()
    for r in rows:
        leaves[(r.d, r.lang, r.source)] += n[r.doc_id]
    total = sum(leaves.values())
    want = brute_budgets(leaves, int(total * part), weights, epochs)
    expected = Counter()
    for k, t in leaves.items():
        allot = int(want[k] + 1e-4)
        full = min(allot // t, epochs)
        own = [r.doc_id for r in rows if (r.d, r.lang, r.source) == k and n[r.doc_id]]
        for e in range(full):
            expected.update((i, e) for i in own)
        rest, used = allot - full * t, 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"{queries.MIX_SEED}:{full}:{i}".encode()).hexdigest()):
            used += n[i]
            if used > rest:
                break
            expected[(i, full)] += 1
    got = mixing.mix(docs, queries.domain(F.col("source")), part, weights, seed=queries.MIX_SEED, max_epochs=epochs, range_rows=3)
    assert Counter((r.doc_id, r.epoch) for r in got.collect()) == expected


def test_op2_against_brute_force(spark, sf):
    """The query itself, with its own settings."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", queries.domain(F.col("source")).alias("d"), "lang", "source", "text").collect()
    n = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    leaves = Counter()
    for r in rows:
        leaves[(r.d, r.lang, r.source)] += n[r.doc_id]
    want = brute_budgets(leaves, int(sum(leaves.values()) * queries.MIX_SHARE), queries.MIX_WEIGHTS, queries.MIX_EPOCHS)
    expected = Counter()
    for k, total in leaves.items():
        allot = int(want[k] + 1e-4)
        full = min(allot // total, queries.MIX_EPOCHS)
        own = [r.doc_id for r in rows if (r.d, r.lang, r.source) == k and n[r.doc_id]]
        rest = allot - full * total
        for e in range(full):
            expected.update((i, *k, n[i], e) for i in own)
        for i in sorted(own, key=lambda i: hashlib.md5(f"{queries.MIX_SEED}:{full}:{i}".encode()).hexdigest()):
            rest -= n[i]
            if rest < 0:
                break
            expected[(i, *k, n[i], full)] += 1
    got = queries.op2_mixing(spark, sf)
    assert Counter((r.doc_id, r.domain, r.language, r.source, r.n_tokens, r.epoch) for r in got.collect()) == expected and expected


def test_mix_of_edge_rows(edge, none):
    got = mixing.mix(edge, F.lit(None).cast("string"), 1.0, {}, max_epochs=1).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, t in EDGE if t and t.strip())
    assert mixing.mix(none, F.lit("d"), 1.0, {}).count() == 0
    assert mixing.mix(edge, F.lit("d"), 0.0, {}).count() == 0


def test_the_mixing_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    rows = [([None, i % 7, i][i % 3], " ".join(["w"] * (i % 11 + 1)), "en", f"src{i % 4}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    mixed = mixing.mix(docs, queries.domain(F.col("source")), queries.MIX_SHARE, queries.MIX_WEIGHTS, seed=queries.MIX_SEED, max_epochs=1).collect()
    assert Counter((k, len(t.split())) for k, t, *_ in kept) == Counter((r.doc_id, r.n_tokens) for r in mixed)
    assert set(kept) <= set(rows) and len(set(kept)) == len(kept) and any(k is None for k, *_ in kept)
    assert kept and sum(len(t.split()) for _, t, *_ in kept) <= queries.MIX_SHARE * sum(len(t.split()) for _, t, *_ in rows)


# 3, 8


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op3_quality(spark, d).toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    x = got[got.held_out].merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    good, bad = x.score[x.quality == 1].to_numpy(), np.sort(x.score[x.quality == 0].to_numpy())
    assert np.searchsorted(bad, good).mean() / len(bad) > 0.97
    assert (x.predicted == x.quality).mean() > 0.95


def test_quality_of_edge_rows(spark, edge, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = quality.score(edge, model)
    assert got.count() == len(EDGE) and "h" in got.columns and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, model).count() == 0
    assert quality.learn(none, labels) == 0.5
    assert quality.learn(edge, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")) == 1.0
    assert {r.score for r in quality.score(edge, 0.5).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 1]) + 0.3 * r.normal(size=60) > 0, 1, -1)
    w = quality.dual_coordinate_descent([(np.arange(5), v) for v in x], y, 5, np.full(60, 1.0), 500, 1)
    x1 = np.c_[x, np.ones(60)]
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x1 @ w)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in r.normal(scale=0.05, size=(300, 6)))


def test_language_on_held_out_rows(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = queries.op8_language_id(spark, d).toPandas().merge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    x = got[got.held_out]
    assert (x.lang_pred == x.lang).mean() > 0.95


def test_language_of_edge_rows(spark, edge, none, sf):
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    got = [(r.doc_id, r.lang_pred, r.lang_score) for r in langid.predict(edge, model).collect()]
    und = Counter(i for i, p, s in got if p == "und")
    assert und == Counter([1, 2, 3, None]) and all(s == 0 for _, p, s in got if p == "und") and all(0 < s <= 1 for _, p, s in got if p != "und")
    assert langid.learn(none) is None and langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"}


def test_temperature_of_overconfident_logits():
    r = np.random.default_rng(1)
    p = langid.softmax(r.normal(size=(4000, 3)))
    y = np.array([r.choice(3, p=q) for q in p])
    assert abs(langid.fit_temperature(np.log(p) * 4, y) - 4) < 0.4


def plain_bucket(symbols, n, bits):
    """The hashed bucket of each n-gram of a list of numbers, in plain 32-bit arithmetic."""
    out = []
    for i in range(len(symbols) - n + 1):
        h = n
        for x in symbols[i : i + n]:
            h = ((h ^ x) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
        out.append((h * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - bits))
    return out


def plain_grams(symbols, p):
    return Counter(b for n in p.orders for b in plain_bucket(symbols, n, p.bits))


def learns(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def small_corpus(tmp_path, spark):
    r = random.Random(12)
    pools = {"en": ["the", "of", "and", "house", "River"], "de": ["der", "und", "straße", "Über", "nicht"], "es": ["el", "que", "niño", "Año", "casa"]}
    docs = []
    for i in range(130):
        lang = r.choice(list(pools))
        words = [r.choice(pools[lang] + ["zz", "!!", "buy"] * (i % 3)) for _ in range(r.randrange(3, 14))]
        docs.append((i, " ".join(words), lang if i % 11 else None, "s", 0))
    docs += [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, "42 !?", "es", "s", 0), (203, "der der", "und", "s", 0), (5, "der und", "de", "s", 0)]
    labels = [(i, i % 3 // 2 if i % 3 else 1 - i % 2, 0) for i in range(0, 130) if i % 7] + [(3, None, 0), (4, 0, 0), (4, 1, 0), (500, 1, 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, labels


def brute_quality(docs, labels):
    """Scores by naive Bayes support vectors over dictionaries."""
    p = quality.Params()
    said = defaultdict(set)
    for i, y, _ in labels:
        if y in (0, 1):
            said[i].add(y)
    known = [(i, min(said[i]), sorted(plain_grams(list((t or "").encode()), p))) for i, t, *_ in docs if len(said[i]) == 1 and learns(i)]
    known.sort(key=lambda x: (x[0], x[1], np.array(x[2], np.int32).tobytes()))
    df = [Counter(b for _, y, k in known if y == c for b in k) for c in (0, 1)]
    size, seen = 1 << p.bits, set(df[0]) | set(df[1])
    total = [sum(x.values()) + p.alpha * size for x in df]
    ratio = {b: np.log((df[1][b] + p.alpha) / total[1]) - np.log((df[0][b] + p.alpha) / total[0]) for b in seen}
    norm = lambda k: max(np.sqrt(sum(ratio.get(b, 0) ** 2 for b in k)), 1e-9)
    rows = [{b: ratio[b] / norm(k) for b in k} for _, _, k in known]
    y = [1 if c else -1 for _, c, _ in known]
    cost = [p.cost * len(y) / (2 * y.count(v)) for v in y]

    def train(own):
        w, bias, a, rng = defaultdict(float), 0.0, [0.0] * len(own), np.random.default_rng(p.seed)
        for _ in range(p.epochs):
            most = 0.0
            for j in rng.permutation(len(own)):
                x, s, top = rows[own[j]], y[own[j]], cost[own[j]]
                g = s * (sum(w[b] * v for b, v in x.items()) + bias) - 1
                new = min(max(a[j] - g / (sum(v * v for v in x.values()) + 1), 0), top)
                step, a[j] = new - a[j], new
                for b, v in x.items():
                    w[b] += step * s * v
                bias += step * s
                most = max(most, abs(step))
            if most < 1e-4:
                break
        mean = sum(map(abs, w.values())) / size
        return lambda k: sum(((1 - p.beta) * mean + p.beta * w.get(b, 0.0)) * ratio.get(b, 0.0) for b in k) / norm(k) + bias

    first = train([j for j in range(len(y)) if j % 5])
    out = [j for j in range(len(y)) if j % 5 == 0]
    m, up = np.array([first(known[j][2]) for j in out]), np.array([y[j] > 0 for j in out])
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    loss = lambda s, b: np.logaddexp(0, s * m + b).sum() - (target * (s * m + b)).sum()
    at, reach = np.zeros(2), 64.0
    while reach > 1e-9:  # pattern search, unlike the operator
        better = [at + reach * np.array(v) for v in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1), (1, 1), (-1, -1))]
        best = min(better, key=lambda v: loss(*v))
        at, reach = (best, reach) if loss(*best) < loss(*at) else (at, reach / 2)
    whole, n = train(list(range(len(y)))), Counter(c for _, c, _ in known)
    return lambda t: 1 / (1 + np.exp(-(at[0] * whole(plain_grams(list((t or "").encode()), p)) + at[1])))


def test_op3_against_brute_force(spark, tmp_path):
    d, docs, labels = small_corpus(tmp_path, spark)
    score = brute_quality(docs, labels)
    got = queries.op3_quality(spark, d).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in docs) and len({round(r.score, 3) for r in got}) > 20
    want = defaultdict(list)
    for i, t, *_ in docs:
        want[i].append(score(t))
    for r in got:
        assert min(abs(r.score - w) for w in want[r.doc_id]) < 2e-4 and r.predicted == int(r.score >= 0.7) and r.held_out == (not learns(r.doc_id))


def brute_language(docs):
    """Languages by regularised leaders over dictionaries, and the calibrated probability."""
    p = langid.Params()
    low = lambda t: [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in t]
    known = sorted(((i, lang, plain_grams(low(t), p)) for i, t, lang, *_ in docs if learns(i) and lang and lang != "und" and t is not None), key=lambda x: (x[0], x[1], np.array(sorted(x[2]), np.int32).tobytes()))
    names = sorted({x[1] for x in known})
    df = Counter(b for *_, k in known for b in k)
    idf = lambda b: np.log((1 + len(known)) / (1 + df[b])) + 1

    def unit(k):
        v = {b: np.log1p(n) * idf(b) for b, n in k.items()}
        s = max(np.sqrt(sum(x * x for x in v.values())), 1e-9)
        return {b: x / s for b, x in v.items()}

    x, y, c = [unit(k) for *_, k in known], [names.index(lang) for _, lang, _ in known], len(names)
    z, n = defaultdict(lambda: [0.0] * c), defaultdict(lambda: [0.0] * c)

    def weight(b, j):
        l1, l2 = (p.l1, p.l2) if b != "bias" else (0, 0)
        zz = z[b][j]
        return 0.0 if abs(zz) <= l1 else -(zz - np.sign(zz) * l1) / ((p.beta + np.sqrt(n[b][j])) / p.rate + l2)

    def logits(v):
        return np.array([sum(weight(b, j) * s for b, s in v.items()) + weight("bias", j) for j in range(c)])

    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    mine, rng = [j for j in range(len(y)) if j % 5], np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(mine)):
            v, own = x[mine[k]], y[mine[k]]
            prob = soft(logits(v))
            for b, s in [*v.items(), ("bias", 1.0)]:
                old = [weight(b, j) for j in range(c)]
                for j in range(c):
                    g = (prob[j] - (j == own)) * s
                    step = (np.sqrt(n[b][j] + g * g) - np.sqrt(n[b][j])) / p.rate
                    z[b][j] += g - step * old[j]
                    n[b][j] += g * g
    out = [j for j in range(len(y)) if j % 5 == 0]
    kept = [(logits(x[j]), y[j]) for j in out]
    loss = lambda s: -sum(np.log(max(soft(v / np.exp(s))[own], 1e-12)) for v, own in kept)
    grid = np.linspace(-3, 3, 601)
    near = grid[int(np.argmin([loss(s) for s in grid]))]
    t = np.exp(min(np.linspace(near - 0.01, near + 0.01, 201), key=loss)) if len(out) >= 20 else 1.0

    def predict(text):
        if not text or not any(ch.isalpha() for ch in text):
            return "und", 0.0
        prob = soft(logits(unit(plain_grams(low(text), p))) / t)
        return names[int(prob.argmax())], float(prob.max())

    return predict


def test_op8_against_brute_force(spark, tmp_path):
    d, docs, _ = small_corpus(tmp_path, spark)
    predict = brute_language(docs)
    want = defaultdict(list)
    for i, t, *_ in docs:
        want[i].append(predict(t))
    got = queries.op8_language_id(spark, d).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in docs) and {r.lang_pred for r in got} == {"en", "de", "es", "und"}
    for r in got:
        assert any(r.lang_pred == lang and abs(r.score - s) < 2e-3 for lang, s in want[r.doc_id]) and r.held_out == (not learns(r.doc_id)), (r, want[r.doc_id])


# 4


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_shards_are_a_whole_even_shuffle(spark, edge, none, bucket_rows):
    n = 1000
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(rows, 16, 1, bucket_rows).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(rows.repartition(7), 16, 1, bucket_rows).collect()}
    assert len(one) == n and one != {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(rows, 16, 2, bucket_rows).collect()}
    slots = defaultdict(list)
    for s, k in one.values():
        slots[s].append(k)
    assert sorted(slots) == list(range(16)) and all(sorted(k) == list(range(len(k))) for k in slots.values())
    assert {len(k) for k in slots.values()} <= {n // 16, n // 16 + 1}
    spots = [s * 100 + k for _, (s, k) in sorted(one.items())]
    assert abs(np.corrcoef(np.arange(n), spots)[0, 1]) < 0.12
    got = sharding.external_shuffle(edge, 3, 1, bucket_rows).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(EDGE) and sorted(Counter(r.shard for r in got).values()) == [4, 4, 5]
    assert sharding.external_shuffle(none, 3).count() == 0


def test_written_shards_hold_whole_records(spark, edge, tmp_path):
    got = sharding.write_shards(edge, str(tmp_path / "s"), 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(EDGE)
    for f in (tmp_path / "s").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def test_op4_sizes(spark, sf):
    rows = queries.op4_sharding(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows) and len(rows) == len(texts)


def test_op4_answers_from_whole_written_shards(spark, sf, none, tmp_path):
    x = queries.op4_sharding(spark, sf)
    files = x.inputFiles()
    assert files and all("/shards/shard=" in f for f in files)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    written = spark.read.parquet(files[0].split("/shard=")[0])
    assert Counter(map(repr, written.select(docs.columns).collect())) == Counter(map(repr, docs.collect()))
    slots = defaultdict(list)
    for r in x.collect():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(queries.SHARDS)) and all(sorted(k) == list(range(len(k))) for k in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.write_shards(none, str(tmp_path / "none"), 4).count() == 0


def test_clashing_columns_of_shards_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "mine", -1, {"a": i}, i, i) for i in range(50)], "doc_id long, text string, shard string, slot int, m map<string,int>, _n int, _order int")
    got = sharding.external_shuffle(rows, 4, 1, bucket_rows=7, most_partitions=2)
    assert sorted(got.columns) == sorted(rows.columns) and sorted((r.shard, r.slot) for r in got.collect()) == [(i * 4 // 50, i - -(-(i * 4 // 50) * 50 // 4)) for i in range(50)]
    assert sorted((r.doc_id, r.text, r.m["a"], r._n, r._order) for r in sharding.write_shards(rows, str(tmp_path / "c"), 4).collect()) == [(i, f"t{i}", i, i, i) for i in range(50)]


def test_op4_law_against_brute_force(spark, sf):
    """rows: 16 shards whose counts differ by one at most, gapless slots; size and checksum of every whole text; null columns."""
    rows = {r.doc_id: r for r in queries.op4_sharding(spark, sf).collect()}
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys() and {r.law for r in rows.values()} == {"rows"} and {r.grown_shard for r in rows.values()} == {None}
    assert all((r["size"], r.text_crc32) == (len(docs[i]) + 1, zlib.crc32(docs[i])) for i, r in rows.items())
    n, counts = len(docs), Counter(r.shard for r in rows.values())
    assert counts == {s: -(-(s + 1) * n // 16) - -(-s * n // 16) for s in range(16)}
    assert sorted((r.shard, r.slot) for r in rows.values()) == [(s, k) for s in range(16) for k in range(counts[s])]


# 5


def feistel(key, kind, left, r, a, b):
    f = lambda i, half, mod: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % mod
    for i in range(8):
        if i % 2 == 0:
            left = (left + f(i, r, a)) % a
        else:
            r = (r + f(i, left, b)) % b
    return left, r


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def one(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    return [(r.text, [(s.kind, s.start, s.length) for s in r.pii]) for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_pseudonyms_are_what_the_network_says(spark):
    card, ip = "4111111111111111", "10.0.200.7"
    (got, spans), (got_ip, _), (phone, _) = one(spark, [f"pay {card}, now", ip, "+1 (743) 555-3824 x"])
    left, r = feistel("k", "card", int(card[:9]), int(card[9:15]), 10**9, 10**6)
    body = f"{left:09d}{r:06d}"
    assert got[4:19] == body and luhn(got[4:20]) and got[:4] + got[20:] == "pay , now" and spans == [("card", 4, 16)]
    left, r = feistel("k", "ipv4", 10 * 256, 200 * 256 + 7, 65536, 65536)
    assert got_ip == f"{left // 256}.{left % 256}.{r // 256}.{r % 256}"
    left, r = feistel("k", "phone", 543 * 800 + 355, 3824, 640_000, 10**4)
    assert phone == f"+1 ({left // 800 + 200}) {left % 800 + 200}-{r:04d} x"


def test_invalid_values_stay(spark):
    texts = ["4111111111111112", "2024-02-30", "31.04.2020", "300.1.1.1", "666-12-1234", "000-12-1234", "123-00-1234", "1.2.3.4.5", "v1.2", "(14) 555-1234", "155-234-5678", "234 155 5678", "1 023.555.1234", "x" * 5000, "", None, "12345678901234567890"]
    assert [t for t, _ in one(spark, texts)] == texts


def test_equal_values_stay_linked_and_formats_are_kept(spark):
    mail, token = "jo.doe+x@mail5.example.com", "ab" * 20
    out = one(spark, [f"{mail} 2020-12-25 {token}", f"é {mail}! 25.12.2020 12/25/2020 02/29/2004", "4111 1111 1111 1111 and 4111-1111-1111-1111", "123-45-6789", "4111 1111 1111 1111", "5500005555555559 5500005555555559"])
    a, b = out[0][0].split(" "), out[1][0].split(" ")
    assert a[0] == b[1][:-1] and a[0] != mail and a[0].endswith("@mail5.example.com") and len(a[0]) == len(mail)
    assert re.fullmatch("[0-9a-f]{40}", a[2]) and a[2] != token
    y, m, d = a[1].split("-")
    assert b[2] == f"{d}.{m}.{y}"  # one day in two formats
    assert int(b[3][3:5]) > 12 and b[4][:5] == "02/29" and int(b[4][6:]) % 4 == 0
    c = re.findall(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", out[2][0])
    assert len(c) == 2 and c[0].replace(" ", "") == c[1].replace("-", "") and luhn(c[0].replace(" ", "")) and out[4][0] == c[0]
    assert len(set(out[5][0].split())) == 1
    assert [out[1][0][s : s + n] for _, s, n in out[1][1]] == [b[1][:-1], *b[2:]]
    assert one(spark, ["123-45-6789"], "other")[0] != out[3]


@pytest.mark.parametrize("make, shape", [
    (lambda r: f"{r.randrange(1, 900) or 1:03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}", r"\d{3}-\d\d-\d{4}"),
    (lambda r: f"{r.randrange(1, 13):02d}/{r.randrange(13, 29):02d}/{r.randrange(1900, 2100)}", r"\d\d/\d\d/\d{4}"),
    (lambda r: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", r"\d{4}-\d\d-\d\d"),
])
def test_pseudonyms_are_a_permutation(spark, make, shape):
    r = random.Random(4)
    values = sorted({v for v in (make(r) for _ in range(1500)) if not v.startswith("666")})
    got = [t for t, _ in one(spark, values)]
    assert len(set(got)) == len(values) and all(re.fullmatch(shape, t) for t in got) and sum(a == b for a, b in zip(got, values, strict=True)) < 5
    kinds = {s[0][0] for _, s in one(spark, values)}
    assert len(kinds) == 1 and all([k for k, _, _ in s] == list(kinds) for _, s in one(spark, got))  # valid values of the same kind


def test_all_days_are_permuted(spark):
    first = date(1900, 1, 1)
    days = [(first + timedelta(i)).isoformat() for i in range(73_049)]
    assert days[-1] == "2099-12-31"
    df = spark.createDataFrame([(d,) for d in days], "text string")
    got = [r.text for r in pii.pseudonymise(df, queries.KEY).collect()]
    assert set(got) == set(days) and sum(a == b for a, b in zip(got, days, strict=True)) < 10


def test_short_email_names_stay_apart(spark):
    names = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in ["", *"abcdefghijklmnopqrstuvwxyz"]]
    got = [t for t, _ in one(spark, [f"{n}@x.org" for n in names])]
    assert len(set(got)) == len(names) and all(re.fullmatch("[a-p]{8}@x.org", t) for t in got)


def test_pseudonyms_of_edge_rows(spark, edge, none):
    assert Counter((r.doc_id, r.text) for r in pii.pseudonymise(edge, "k").collect()) == Counter(EDGE)
    assert pii.pseudonymise(none, "k").count() == 0
    rows = spark.createDataFrame([(1, "123-45-6789 a", 5, "w", 1)] * 2 + [(2, None, None, None, None)], "doc_id long, text string, pii int, _new string, _parts int")
    a, b, c = pii.pseudonymise(rows, "k").orderBy("doc_id").collect()
    assert a == b and a._new == "w" and a._parts == 1 and [s.kind for s in a.pii] == ["ssn"] and (c.text, c.pii) == (None, [])
    assert sorted(pii.pseudonymise(rows, "k").columns) == sorted(rows.columns)


def brute_pseudonym(m, key):
    """A match and its kind by plain Python: (replacement, kind), or (match, None) where it isn't valid."""
    net = lambda kind, left, r, a, b: feistel(key, kind, left, r, a, b)
    digits = re.sub("[^0-9]", "", m)

    def put(new):
        it = iter(new)
        return "".join(next(it) if ch.isdigit() else ch for ch in m)

    def day(y, mo, d):
        try:
            return date(int(y), int(mo), int(d))
        except ValueError:
            return None

    if "@" in m:
        name, host = m.split("@")
        h = hashlib.sha256(f"{key}|email|{m}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
        return h[: max(len(name), 8)].ljust(len(name), "x") + "@" + host, "email"
    if re.fullmatch(r"(?=.*[a-f])([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})", m):
        return hashlib.sha256(f"{key}|secret|{m}".encode()).hexdigest()[: len(m)], "secret"
    if x := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", m):
        v, write = day(*x.groups()), lambda v: v.isoformat()
    elif x := re.fullmatch(r"(\d\d)[/.](\d\d)[/.](\d{4})", m):
        v, write = day(x[3], x[2], x[1]), lambda v: put(v.strftime("%d%m%Y"))
        if v is None and (us := day(x[3], x[1], x[2])):
            if m.startswith("02") and us.day == 29:
                left, r = net("date_leap", (us.year - 1904) // 28, (us.year - 1904) // 4 % 7, 7, 7)
                return put(f"0229{(left * 7 + r) * 4 + 1904}"), "date_leap"
            late = [(a, b) for a in range(1, 13) for b in range(13, 32) if day(2001, a, b)]
            left, r = net("date_late", late.index((us.month, us.day)), us.year - 1900, 221, 200)
            return put(f"{late[left][0]:02d}{late[left][1]:02d}{r + 1900}"), "date_late"
    else:
        x = None
    if x:
        if v is None:
            return m, None
        n = (v - date(1900, 1, 1)).days
        left, r = net("date", n // 4297, n % 4297, 17, 4297)
        return write(date(1900, 1, 1) + timedelta(left * 4297 + r)), "date"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = [int(v) for v in m.split(".")]
        if max(o) > 255:
            return m, None
        left, r = net("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{r // 256}.{r % 256}", "ipv4"
    if x := re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", m):
        a, g, s = map(int, x.groups())
        if not (0 < a < 900 and a != 666 and g and s):
            return m, None
        areas = [v for v in range(1, 900) if v != 666]
        left, r = net("ssn", areas.index(a), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        return f"{areas[left]:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}", "ssn"
    if re.fullmatch(r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}", m):
        if digits[-10] < "2" or digits[-7] < "2":
            if m[0] not in "+(":
                return m, None
            others = [f"{v:06d}" for v in range(200_000)] + [f"{a}{e:03d}" for a in range(200, 1000) for e in range(200)]
            left, r = net("phone_other", others.index(digits[-10:-4]), int(digits[-4:]), 360_000, 10**4)
            return put(digits[:-10] + f"{others[left]}{r:04d}"), "phone_other"
        left, r = net("phone", (int(digits[-10:-7]) - 200) * 800 + int(digits[-7:-4]) - 200, int(digits[-4:]), 640_000, 10**4)
        return put(digits[:-10] + f"{left // 800 + 200}{left % 800 + 200}{r:04d}"), "phone"
    if not luhn(digits):
        return m, None
    left, r = net("card", int(digits[:-7]), int(digits[-7:-1]), 10 ** (len(digits) - 7), 10**6)
    body = f"{left:0{len(digits) - 7}d}{r:06d}"
    return put(next(body + str(c) for c in range(10) if luhn(body + str(c)))), "card"


def brute_pii(text, key):
    out, spans, at, n = [], [], 0, 0
    for x in re.finditer(pii.PATTERN, text or ""):
        new, kind = brute_pseudonym(x[0], key)
        out += [text[at : x.start()], new]
        n += x.start() - at
        spans += [(kind, n, len(new))] if kind else []
        n, at = n + len(new), x.end()
    return (None if text is None else "".join(out) + text[at:]), spans


def test_op5_against_brute_force(spark, sf):
    """The query on whole tables, and the operator on texts that are full of values, against the same rules in plain Python."""
    d = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.n_pii, r.spans) for r in queries.op5_pii(spark, d).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        new, spans = brute_pii(t, queries.KEY)
        assert got[i][:2] == (new, len(spans)) and [tuple(s.values()) for s in json.loads(got[i][2])] == spans, i
    r = random.Random(8)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = [
        lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"+1 {digit(3)}.{digit(3)}.{digit(4)}", lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        lambda: f"{r.randrange(1890, 2110)}-{r.randrange(0, 14):02d}-{r.randrange(0, 33):02d}", lambda: f"{r.randrange(0, 33):02d}{(c := r.choice('/.'))}{r.randrange(0, 33):02d}{c}{r.randrange(1895, 2105)}",
        lambda: f"02/29/{r.randrange(1900, 2100)}", lambda: digit(r.randrange(12, 18)), lambda: r.choice(["4111 1111 1111 1111", "5500005555555559", "378282246310005"]), lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 33, 40, 64]))),
        lambda: f"{r.choice('abc')}@m{digit(1)}.org", lambda: r.choice(["é", "word", "a_1", "7", ".", ",", "x" * 70 + "@y.com"]),
    ]
    values = [r.choice([" ", ", ", "; ", "\n"]).join(r.choice(make)() for _ in range(r.randrange(1, 12))) for _ in range(800)]
    for t, (new, spans) in zip(values, one(spark, values), strict=True):
        assert (new, spans) == brute_pii(t, "k"), t


def test_op5_leaves_no_valid_value(spark, sf):
    d = sf.replace("0.001", "0.01")
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    new = {r.doc_id: r.text for r in queries.op5_pii(spark, d).collect()}
    assert set(old) == set(new)
    seen = 0
    for i, t in old.items():
        for m in re.findall(r"(?<![\w.])(?:\d{16}|\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4})(?![\w])", t):
            if not re.fullmatch(r"\d+", m) or luhn(m):
                seen += 1
                assert m not in new[i], m
    assert seen > 30


def test_token_workers_keep_their_words_and_give_back_the_rest(monkeypatch):
    kept, calls = {1: "words"}, []
    monkeypatch.setattr(common, "MEMORIES", [kept.clear])
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.released(iter, forget=False)([1, 2])) == [1, 2] and kept and len(calls) == 1
    assert list(common.released(iter)([1, 2])) == [1, 2] and not kept and len(calls) == 2


# 6


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and i is not None and j is not None and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return Counter((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates_lose_no_link(spark, block):
    rows = random_docs(250, 3) + [(1000 + i, t) for i, t in random_docs(60, 4, words=9, vocabulary=6)]
    got = mh.near_duplicates(frame(spark, rows), block=block).collect()
    assert Counter(map(tuple, got)) == brute_near(rows)


def test_near_duplicates_of_edge_rows(edge, none):
    assert Counter(map(tuple, mh.near_duplicates(edge).collect())) == brute_near(EDGE)
    assert mh.near_duplicates(none).count() == 0


def test_near_duplicates_of_documents(spark, sf):
    d = sf.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    index = defaultdict(set)  # only documents that share a shingle can link
    sets = {i: shingles(t) for i, t in rows}
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    edges = {(min(a, b), max(a, b)) for i, s in sets.items() for x in s for a, b in [(i, j) for j in index[x] if j != i]}
    root = {i: i for i in sets}
    for _ in range(50):
        for a, b in sorted(edges):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_minhash_dedup(spark, d).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_large_near_copy_groups(spark):
    r = random.Random(6)
    base = ["b%d" % i for i in range(90)]
    rows = []
    for i in range(150):  # neighbours of the threshold on both sides
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(90)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    assert Counter(map(tuple, mh.near_duplicates(frame(spark, rows), block=20).collect())) == brute_near(rows)


def test_encoding_takes_few_times_its_text(sf):
    """Places of ids are laid out by rows, pieces are cut by slices: neither is held for a whole pass."""
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").combine_chunks().fill_null("").cast(pa.large_string())
    e = tokenise.encoder(open(queries.tokenizer_path()).read())
    one, ends = e.encode(texts)  # its words are known from here on
    times = -(-(8 << 20) // texts.nbytes)
    many = pa.concat_arrays([texts] * times)
    default = pa.default_memory_pool()
    pa.set_memory_pool(own := pa.proxy_memory_pool(default))
    tracemalloc.start()
    try:
        flat, off = e.encode(many)
        peak = tracemalloc.get_traced_memory()[1] + own.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(default)
    assert np.array_equal(flat, np.tile(one, times)) and np.array_equal(np.diff(off), np.tile(np.diff(ends), times))
    assert peak < 8 * many.nbytes, peak / many.nbytes


def test_a_near_group_meets_once_for_all_bands(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(150):
        w = ["b%d" % x for x in range(90)]
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(90)] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    pairs, met = mh.block_pairs, []
    monkeypatch.setattr(mh, "block_pairs", lambda *a: met.append((x := pairs(*a)).count()) or x)
    got = mh.near_duplicates(frame(spark, rows), block=20).collect()
    assert Counter(map(tuple, got)) == brute_near(rows)
    assert met[0] < 2 * 150 * 8  # rows by signature: each of 150 in 8 blocks, not in the blocks of each band


def test_hot_centers_are_split_without_loss(spark):
    rows = random_docs(120, 11) + [(1000 + i, t + f" tail{i % 9}") for i, t in enumerate(["c%d " % (k % 70) * 1 + " ".join("c%d" % x for x in range(40)) for k in range(130)])]
    assert Counter(map(tuple, mh.near_duplicates(frame(spark, rows), block=16, share=4).collect())) == brute_near(rows)


@pytest.mark.parametrize("n", [20, 300, 1000, 5000])
def test_signatures_tell_unrelated_documents_apart(n):
    r = np.random.default_rng(n)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**7, n + 4)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    sigs = np.concatenate([np.frombuffer(b"".join(x.column("sig").to_pylist()), np.uint8).reshape(-1, 200) for x in mh.signer(40, 5, 5, 5)(iter([batch]))])
    same = (sigs[:, None] == sigs[None]).sum(2)[np.triu_indices(60, 1)]
    assert (same >= mh.least_agreement(75, 200)).mean() < 0.01 and same.mean() < 3


@pytest.mark.parametrize("bound", [0, 10**6])
def test_components_of_a_long_path(spark, bound):
    r = random.Random(1)
    ids = list(range(300))
    r.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(149)] + [(ids[i], ids[i + 1]) for i in range(150, 299)] + [(7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), broadcast_rows=bound).collect()}
    assert got == {i: min(ids[:150]) if k < 150 else min(ids[150:]) for k, i in enumerate(ids)}


def test_word_kernel():
    import pyarrow as pa

    texts = ["a b", "b a", None, "", "ab", "A  b\n", "b", "é a"]
    w, off = textkernel.words(*textkernel.raw(pa.array(texts)))
    own = [w[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert own[0] == own[5] == own[1][::-1] and own[2] == own[3] == [] and len(set(own[0] + own[4] + own[6] + own[7])) == 4


# 7


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def word_list(t):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", lower(t))


def test_contamination_against_brute_force(spark):
    r = random.Random(9)
    pool = ["v%d" % i for i in range(300)]
    items = [(k, " ".join(r.choice(pool) for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 9, 10, 14, 15, 20, 33, 60])] + [(99, None), (98, ""), (97, "?!")]
    docs = [(0, None), (1, ""), (2, "v1"), (3, items[4][1])]
    for d in range(4, 120):
        w = [r.choice(pool) for _ in range(r.randrange(0, 80))]
        for k in r.sample(range(11), 2):
            p = items[k][1].split()
            for _ in range(r.randrange(0, len(p) // 4 + 1)):
                at, what = r.randrange(len(p)), r.randrange(3)
                p[at : at + 1] = [[], [r.choice(pool)], [p[at], r.choice(pool)]][what]
                p = p or ["v0"]
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        docs.append((d, r.choice([" ", ", ", ".\n"]).join(w).upper()))
    df, it = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find_contamination(df, it).collect()}
    want = {}
    for d, t in docs:
        for k, p in items:
            if (m := word_list(p or "")) and (e := edits(m, word_list(t or ""))) <= len(m) // 5:
                want[(d, k)] = e
    assert got.keys() <= want.keys() and len(want.keys() - got.keys()) <= 0.01 * len(want) and all(got[k] >= want[k] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got) and len(want) > 150
    in_blocks = decontaminate.find_contamination(df, it, block_bytes=100)
    assert {(x.doc_id, x.item_id): x.distance for x in in_blocks.collect()} == got
    clean = decontaminate.decontaminate(df, it)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


@pytest.mark.parametrize("m", [5, 6, 8, 10, 15, 20])
def test_short_items_at_d_edits_reach_the_stated_recall(m):
    n, rng = 3000, np.random.default_rng(m)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 50_000, k)]
    own = [word(m) for _ in range(n)]
    rule, texts = decontaminate.Rule(), []
    for x in own:
        y = list(x)
        for _ in range(int(m * rule.max_edit + 1e-9)):
            kind, p = rng.integers(3), int(rng.integers(len(y)))
            y[p : p + int(kind != 0)] = word(int(kind != 1))
        texts.append(" ".join(word(30) + y + word(30)))
    items = decontaminate.Items(list(range(n)), [" ".join(x) for x in own], rule)
    found = decontaminate.matches(items, *textkernel.words(*textkernel.raw(pa.array(texts, pa.large_string())), textkernel.ALNUM_WORDS))
    assert sum(i in [f["item_id"] for f in found.get(i, [])] for i in range(n)) >= rule.recall * n


@pytest.mark.parametrize("m", [5, 6, 7, 9, 10, 15, 25, 40, 59])
def test_the_tables_alone_reach_the_stated_recall(m):
    """Windows that meet an item in a table, before any filter: of items at exactly d random edits, and beside random texts."""
    n, rng = 3000, np.random.default_rng(100 + m)
    word = lambda k: rng.integers(1, 2**62, k).astype(np.uint64)
    own, rule, texts = [word(m) for _ in range(n)], decontaminate.Rule(), []
    for x in own:
        y = list(x)
        for _ in range(m // 5):
            kind, p = rng.integers(3), int(rng.integers(len(y)))
            y[p : p + int(kind != 0)] = list(word(int(kind != 1)))
        texts.append(np.concatenate((word(25), np.array(y, np.uint64), word(25))))
    items = decontaminate.Items([0], ["x"], rule)
    items.ids, items.words, items.m = list(range(n)), own, np.full(n, m)
    items.lsh = [items._tables(walk, rule.steps_of(m)) for walk in range(rule.walks)]
    off = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    row, item, _ = decontaminate.candidates(items, np.concatenate(texts), off)
    assert len(set(row[row == item].tolist())) >= rule.recall * n and (row != item).sum() == 0


@pytest.mark.parametrize("m", [5, 20, 25, 59, 100, 200, 400])
def test_the_tables_reach_the_recall_wherever_the_edits_are(m):
    """Items of all lengths at exactly d edits: at random places, evenly spread, at the beginning, and at both ends."""
    n, d, rng, rule = 1000, m // 5, np.random.default_rng(m), decontaminate.Rule()
    word = lambda k: rng.integers(0, 50_000, k)
    own = [word(m) for _ in range(n)]
    text = lambda x: " ".join(f"w{i}" for i in x)
    items = decontaminate.Items(list(range(n)), [text(x) for x in own], rule)
    ends = [*range(d // 2), *range(m - (d - d // 2), m)]
    places = {"random": None, "even": [k * m // d for k in range(d)], "first": range(d), "ends": ends, "ends, deleted": ends}
    for pattern, at in places.items():
        texts = []
        for x in own:
            y = x.tolist()
            for p in sorted(rng.choice(m, d, replace=False).tolist() if at is None else at, reverse=True):
                kind = int(rng.integers(3)) if at is None else 0 if "deleted" in pattern else 1
                y[p : p + int(kind < 2)] = word(int(kind > 0)).tolist()
            texts.append(text([*word(25), *y, *word(25)]))
        w, off = textkernel.words(*textkernel.raw(pa.array(texts, pa.large_string())), textkernel.ALNUM_WORDS)
        row, item, _ = decontaminate.candidates(items, w, off)
        assert len(set(row[row == item].tolist())) >= rule.recall * n, pattern


def test_repeated_items_are_one(spark):
    rows = spark.createDataFrame([(1, "a b c d e f")] * 50 + [(2, "a b c d e f")], "item_id long, text string")
    assert [len(ids) for ids, _ in decontaminate.blocks(rows, 1 << 20)] == [2]
    docs = frame(spark, [(7, "x a b c d e f y")])
    assert sorted(r.item_id for r in decontaminate.find_contamination(docs, rows).collect()) == [1, 2]


def test_windows_that_meet_without_the_shared_words_are_dropped():
    rule = decontaminate.Rule()
    own = " ".join(f"w{i}" for i in range(30))
    items = decontaminate.Items([1], [own], rule)
    far = " ".join(f"w{i}" if i < 12 else f"x{i}" for i in range(30))  # meets by its beginning alone
    w, off = textkernel.words(*textkernel.raw(pa.array([far, own], pa.large_string())), textkernel.ALNUM_WORDS)
    assert 0 in decontaminate.candidates(items, w, off)[0] and list(decontaminate.matches(items, w, off)) == [1]
    assert decontaminate.matches(items, w[:30], off[:2]) == {}


def test_clashing_columns_of_contaminated_documents(spark):
    rows = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem", "a", 1, 2), (2, "fine", "b", 3, 4)], "doc_id long, text string, _found string, found int, row int")
    it = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(rows, it).collect()] == [(2, "fine", "b", 3, 4)]
    assert [tuple(r) for r in decontaminate.find_contamination(rows, it).collect()] == [(1, 1, 0, 6, 0)]


def test_contamination_of_edge_rows(spark, edge, none):
    it = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    assert sorted(x.doc_id for x in decontaminate.find_contamination(edge, it).collect()) == [7, 8]
    assert decontaminate.decontaminate(edge, it).count() == len(EDGE) - 2
    assert decontaminate.decontaminate(none, it).count() == 0
    assert decontaminate.decontaminate(edge, it.limit(0)).count() == len(EDGE) and decontaminate.find_contamination(edge, it.limit(0)).count() == 0


def test_items_without_an_id_count(spark, edge):
    it = spark.createDataFrame([(None, "lorem ipsum dolor sit amet lorem"), (None, "one two"), (1, "one two")], "item_id long, text string")
    found = decontaminate.find_contamination(edge, it)
    assert Counter((r.doc_id, r.item_id) for r in found.collect()) == Counter([(7, None), (8, None), *[(k, i) for k in (4, 5, 5, 6, None) for i in (None, 1)]])
    in_blocks = decontaminate.find_contamination(edge, it, block_bytes=10)
    assert Counter(in_blocks.collect()) == Counter(found.collect())
    assert decontaminate.decontaminate(edge, it).count() == len(EDGE) - 7


def test_op7_finds_whole_items(spark, sf):
    d = sf.replace("0.001", "0.01")
    items = {r.item_id: " ".join(word_list(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    want = {(r.doc_id, k) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for k, p in items.items() if f" {p} " in f" {' '.join(word_list(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontaminate(spark, d).filter("distance = 0").collect()}
    assert got == want and want


# 9


def test_wavelet_matrix():
    r = np.random.default_rng(2)
    for n, width in ((0, 4), (1, 1), (700, 3), (1500, 16), (513, 17)):
        v = r.integers(0, min(2**width, 40), n)
        m = wavelet.WaveletMatrix.build(v, width)
        assert (m.tokens() == v).all() and (m.access(np.arange(n)) == v).all()
        for t in {*v[:4].tolist(), 0, 2**width - 1, 2**width}:
            assert m.count(t) == (v == t).sum() and m.rank(t, n // 2) == (v[: n // 2] == t).sum()
            if t < 2**width:
                assert (m.select(t, np.arange(m.count(t))) == np.flatnonzero(v == t)).all()


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_have_the_ids_of_whole_texts(monkeypatch):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "don't", "'s", " '", "42", "é", "漢字", " ", " ", "\x1c", "\x85", "<|endoftext|>", "###", "\U0001f600", "A", "the"]
    texts = ["", " ", "a", " a", "a ", *("".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(3000))]
    e = tokenise.Encoder(open(queries.tokenizer_path()).read())
    assert e.by_piece
    for a in range(0, len(texts), 97):
        flat, off = e.encode(pa.array(texts[a : a + 97]))
        assert [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == whole_ids(texts[a : a + 97])
    short = tokenise.Encoder(open(queries.tokenizer_path()).read())
    monkeypatch.setattr(tokenise, "MOST", 20)  # words are forgotten and met again
    for a in range(0, 900, 7):
        flat, off = short.encode(pa.array(texts[a : a + 7]))
        assert [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == whole_ids(texts[a : a + 7])
    assert len(short.memory.number) < 200 and len(short.old.number) > 20
    e.by_piece = False
    flat, off = e.encode(pa.array(texts[:50]))
    assert [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == whole_ids(texts[:50])


def test_texts_are_cut_into_words_by_their_bytes(monkeypatch):
    """Words of ASCII and Latin letters, digits and marks need no pattern: not when they are first met, and not later."""
    r = random.Random(6)
    parts = [*[" "] * 6, "\n", "a", "The", "42", "é", "À", "ß", "ȿ", ".", "$$", "_", "`"]
    texts = ["".join(r.choice(parts) for _ in range(30)) for _ in range(300)]
    texts = [re.sub(r"\s\s+", " ", x).strip() for x in texts]
    words, count = tokenise.cut(pa.array(texts, pa.large_string()))
    assert words.to_pylist() == [w for x in texts for w in tokenise.WORD.findall(x)]
    assert count.tolist() == [len(tokenise.WORD.findall(x)) for x in texts]

    class Never:
        def findall(self, text):
            assert not text, text
            return []

    monkeypatch.setattr(tokenise, "WORD", Never())
    e = tokenise.Encoder(open(queries.tokenizer_path()).read())
    for _ in range(2):
        flat, off = e.encode(pa.array(texts))
        assert [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == whole_ids(texts)


def test_odd_pieces_and_white_space_have_the_ids_of_whole_texts():
    r = random.Random(7)
    parts = [*[" "] * 8, *[chr(c) for c in range(1, 0x250)], "×", "÷", "ɀ", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u0301", "'ll", "'LL", "漢字", "б", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(4000)]
    texts += [f"a{x}b {x}c{x} d" for x in parts]
    e = tokenise.Encoder(open(queries.tokenizer_path()).read())
    flat, off = e.encode(pa.array(["not read", *texts]).slice(1))
    assert [flat[x:y].tolist() for x, y in zip(off[:-1], off[1:], strict=True)] == whole_ids(texts)


def test_token_files_round_trip(spark, edge, none, tmp_path):
    path = str(tmp_path / "t")
    wavelet.write_tokens(edge, path, queries.tokenizer_path(), 2, shard_bytes=50_000, most_tokens=1000)
    rows = sorted(EDGE, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, start = [], 0
    for (i, _), ids in zip(rows, whole_ids([t or "" for _, t in rows]), strict=True):
        a = np.array([*ids, 2], "<u4")
        want.append((i, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    got = wavelet.read_tokens(spark, path)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == Counter(want)
    assert spark.read.parquet(path).select("shard").distinct().count() > 1
    token = whole_ids(["lorem ipsum"])[0][-1]
    places = wavelet.find_token(spark, path, token)
    n = sum(x.n for x in wavelet.count_token(spark, path, token).collect())
    assert n == places.count() == sum(x.count(token) for x in whole_ids([t or "" for _, t in EDGE]))
    assert {r.doc_id for r in places.collect()} == {7, 8}
    assert queries.token_digest(none).count() == 0


def test_op9(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = set(), 0
    for r, ids in zip(rows, whole_ids([r.text or "" for r in rows]), strict=True):
        a = np.array([*ids, 2], "<u4")
        want.add((r.doc_id, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    assert {tuple(r) for r in queries.op9_token_ids(spark, sf).collect()} == want


def test_op9_reads_control_strings_as_the_library_does(spark, none):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "plain text"]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.token_digest(frame(spark, list(enumerate(texts)))).collect()}
    assert whole_ids(texts[:1]) == [[87, 220, 50256, 331]]
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(whole_ids(texts))}


def test_rank_opens_few_chunks():
    r = np.random.default_rng(3)
    n = 3 * wavelet.CHUNK + 77
    v = r.integers(0, 5000, n)
    row = wavelet.shard_row(0, 0, np.array([1]), np.array([True]), np.array([n]), v, 13)
    s = wavelet.Shard(row)
    assert len(row["planes"]) == 13 * 4 and (s.matrix.access(np.array([0, n - 1])) == v[[0, -1]]).all()
    assert s.matrix.rank(int(v[9]), n // 2) == (v[: n // 2] == v[9]).sum() and s.matrix.count(int(v[9])) == (v == v[9]).sum()
    one = wavelet.Shard(row)
    assert one.matrix.count(17) == (v == 17).sum() and len(one.opened) <= 2 * 13
    assert (wavelet.Shard(row).matrix.tokens() == v).all()


# 10

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 4, "assistant", "END", 0.5), (2, 9, 77, None, None, None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (None, 1, None, "user", "null tree", 1.0)]
    nodes = spark.createDataFrame(rows + rows[:2], NODES)
    paths = [(r.tree, r["rank"], r.above, r.node) for r in chat.root_paths(nodes, top=2).collect()]
    branch = lambda t, k: [n for x, y, a, n in sorted(paths, key=lambda p: -p[2]) if (x, y) == (t, k)]
    assert branch(1, 1) == [1, 3, 4, 5] and branch(1, 2) == [1, 3, 4, 6] and branch(2, 1) == [9] and branch(None, 1) == [1] and not branch(3, 1)
    assert sorted((r.tree, r.node) for r in chat.cycles(nodes).collect()) == [(3, 1), (3, 2)]
    assert chat.format_paths(chat.root_paths(nodes.limit(0))).count() == 0


def test_formats_are_reversible(spark):
    evil = ["\n</turn>\n", "\\", "\\\\<", "### user ###\n", " ###\n", "", None, "a\n\n</turn>", "\\### Assistant: </turn> ok", "\U0001f600é", "x" * 100000, "#" * 3000 + "<\\" * 3000]
    rows = [(1, i, i - 1 if i else None, r, t, 0.0) for i, (r, t) in enumerate((r, t) for r in ("assistant", "us ###\ner", None, "a\\") for t in evil)]
    out = chat.parse(chat.format_paths(chat.root_paths(spark.createDataFrame(rows, NODES)))).collect()
    assert len(out) == 1 and [(t.role, t.text) for t in out[0].turns] == [(r[3] or "", r[4] or "") for r in rows]
    assert out[0].loss_text == "".join(t or "" for t in evil)


def test_deep_conversations(spark):
    rows = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"{c}.{t}") for c, n in ((1, 400), (2, 1), (3, 37)) for t in range(n)], "conv_id long, turn long, role string, text string")
    out = {r.tree: [t.text for t in r.turns] for r in chat.parse(chat.format_paths(chat.root_paths(chat.linear(rows)))).collect()}
    assert out == {c: [f"{c}.{t}" for t in range(n)] for c, n in ((1, 400), (2, 1), (3, 37))}


# the pipeline


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    by = []
    for _, stage in cp.STAGES:
        docs = Scratch(spark, "t").write(stage(spark, docs, sf), "x")
        by.append({r.doc_id: r.asDict() for r in docs.collect()})
        if len(by) < 5:
            assert docs.columns == first.columns
    lang, near, clean, mixed, ids = by
    whole = {r.doc_id: r.text for r in first.collect()}
    assert len(lang) >= 0.97 * len(whole) and all(r["text"] == whole[i] for i, r in lang.items())
    want = {i for (i, _, c, kept) in brute_near([(i, r["text"]) for i, r in lang.items()]) if kept}
    assert set(near) == want
    items = [word_list(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, r in near.items() if any(f" {' '.join(p)} " in f" {' '.join(word_list(r['text']))} " for p in items)}
    assert not leaks & set(clean) and len(clean) >= len(near) - len(leaks) - 2
    assert set(mixed) <= set(clean) and len(mixed) > 0.4 * len(clean) and set(ids) == set(mixed)
    assert {tuple(r.values()) for r in ids.values()} == {tuple(r) for r in cp.run(spark, sf).collect()}


def test_the_sample_is_bounded_where_rows_share_an_id(spark):
    from rosterforge.llm import ngrams

    rows = [(i, f"t{i}", i % 2) for i in range(300)] + [(7, f"x{i}", 1) for i in range(400)] + [(8, "same", 0)] * 400 + [(None, "n", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    sizes = {c: sum(r[2] == c for r in rows) for c in (0, 1)}
    for per_class in (20, 100, 2000):
        got = ngrams.bounded_sample(df, "y", per_class, "doc_id", sizes).collect()
        assert max(Counter(r.y for r in got).values()) <= per_class and set(map(tuple, got)) <= set(rows)
    assert Counter(map(tuple, got)) == Counter(rows)
    few = [ngrams.bounded_sample(df.filter("doc_id IN (7, 8)"), "y", 30, "doc_id", {0: 30, 1: 30}).collect() for _ in range(2)]
    assert Counter(r.y for r in few[0]) == {0: 2, 1: 30}
    assert sorted(map(tuple, few[0])) == sorted(map(tuple, few[1]))


def test_shards_follow_the_total(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARDS", 3)
    path = Scratch(spark, "few").path("t")
    docs = frame(spark, [(i, "word " * 20) for i in range(50)])
    wavelet.write_tokens(docs, path, queries.tokenizer_path(), 2)
    assert spark.read.parquet(path).select("shard").distinct().count() == 1  # small shards would be below 16 MB
    assert wavelet.read_tokens(spark, path).count() == 50
