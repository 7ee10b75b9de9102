import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sessionlake.llm import pitman_yor as py


def test_packing_and_parts():
    x = np.array([5, -3, 1 << 40], np.int64)
    assert (py.unpacked(py.packed(x), "<i8") == x).all() and len(py.unpacked(py.packed(x[:0]), "<i8")) == 0
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    part = py.dealt(h, 7)
    assert (np.diff(part) >= 0).all() and set(part) == set(range(7)) and set(py.dealt(h, 3, low=True)) == {0, 1, 2}
    w, u = py.unfold(np.array([2, 0, 3]), np.array([4, 3, 1, 1, 5]))
    assert w.tolist() == [0, 0, 2, 2, 2] and u.tolist() == [4, 7, 1, 2, 7]


def stirling(d, most):
    """By the recursion, as logarithms: S[c][t]."""
    s = [[-math.inf] * (most + 2) for _ in range(most + 1)]
    s[1][1] = 0.0
    for c in range(1, most):
        for t in range(1, c + 2):
            s[c + 1][t] = np.logaddexp(s[c][t - 1], (math.log(c - d * t) if c > d * t else -math.inf) + s[c][t])
    return s


def test_ratios():
    d = 0.7
    s, exact = stirling(d, 40), py.Ratios(d, 64)
    for c in range(2, 41):
        t = np.arange(1, c)
        assert np.allclose(exact(np.full(c - 1, c), t), [math.exp(s[c][i + 1] - s[c][i]) for i in t])
    law, whole = py.Ratios(d), py.Ratios(d, 4096)
    t = np.unique(np.geomspace(1, 4096**d * 2, 60).astype(np.int64))
    assert np.abs(law(np.full(len(t), 4096), t) / whole(np.full(len(t), 4096), t) - 1).max() < 0.01


def test_draw_follows_the_posterior():
    """Against all numbers of tables, weighted by hand; few and many tables, so a peak at one and further on."""
    rng, d, n = np.random.default_rng(0), 0.6, 40_000
    s = stirling(d, 12)
    for c, rest, slope in ((3, 0.3, 0.05), (2, 4.0, 0.5), (12, 3.0, 0.6), (12, 0.01, 0.001), (1, 1.0, 1.0)):
        got = np.bincount(py.draw(np.full(n, c), lambda i, t: rest + slope * t, py.Ratios(d, 64), rng), minlength=c + 1)[1:] / n
        want = np.exp([s[c][t] + sum(math.log(rest + slope * i) for i in range(1, t)) for t in range(1, c + 1)])
        assert np.abs(got - want / want.sum()).max() < 0.012


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return lower.encode().split() + [None]


def predictive(pairs, d1, d2, s, v):
    """Mean of P(w | u) over all tables of a two-level model, each weighted by its probability; None stands for an unknown word or context."""
    st1, st2 = stirling(d1, 16), stirling(d2, 16)
    rising = lambda n, d: sum(math.log(s + d * i) for i in range(n))
    keys = sorted(pairs, key=str)
    contexts, words = {u for u, _ in keys}, {w for _, w in keys}
    total, sums = 0.0, Counter()
    for ts in itertools.product(*[range(1, pairs[k] + 1) for k in keys]):
        of_u, of_w = Counter(), Counter()
        for (u, w), t in zip(keys, ts):
            of_u[u] += t
            of_w[w] += t
        low = sum(st2[pairs[k]][t] for k, t in zip(keys, ts)) + sum(rising(n, d2) for n in of_u.values())
        order = sorted(of_w, key=str)
        c1 = sum(of_w.values())
        for tp in itertools.product(*[range(1, of_w[w] + 1) for w in order]):
            t1 = sum(tp)
            p = math.exp(low + sum(st1[of_w[w]][t] for w, t in zip(order, tp)) + rising(t1, d1) - rising(c1, 1.0) - t1 * math.log(v + 1))
            total += p
            parent = {w: (of_w[w] - d1 * t + (s + d1 * t1) / (v + 1)) / (s + c1) for w, t in zip(order, tp)} | {"?": (s + d1 * t1) / (v + 1) / (s + c1)}
            for u, w in itertools.product([*contexts, "?"], [*words, "?"]):
                c_u = sum(n for (a, _), n in pairs.items() if a == u)
                t = dict(zip(keys, ts)).get((u, w), 0)
                sums[u, w] += p * (pairs.get((u, w), 0) - d2 * t + (s + d2 * of_u[u]) * parent[w]) / (s + c_u)
    return {k: x / total for k, x in sums.items()}


def test_scores_of_enumerated_seatings(spark):
    """Probabilities of texts against all seatings of both levels, weighted by hand."""
    rows = [(i, t) for i, t in enumerate(["a b a b", "a b", "a a", "b", "b a"])] + [(100, "a b zz"), (101, "zz a"), (102, "b b")]
    got = {r.doc_id: r.score for r in py.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, samples=4000, burn=1, ranges=1).collect()}
    pairs = Counter()
    for i, t in rows:
        if i < 100:
            pairs.update(zip([None, *tokens(t)[:-1]], tokens(t)))
    words = {w for _, w in pairs}
    d2 = py.discount(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    types = Counter(w for _, w in pairs)
    d1 = py.discount(sum(c == 1 for c in types.values()), sum(c == 2 for c in types.values()))
    p = predictive(pairs, d1, d2, 1.0, len(words))
    for i, t in rows:
        x = tokens(t)
        known = lambda w: w if w in words else "?"
        want = sum(math.log10(p[known(u), known(w)]) for u, w in zip([None, *x[:-1]], x))
        assert abs(got[i] - want) < 0.02 * len(x), (t, got[i], want)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    follow = {w: rng.choice(words, 3) for w in words}
    rows = []
    for i in range(400):
        w, out = rng.choice(words), []
        for _ in range(30):
            out.append(w)
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out), 0))
    return rows


def test_scores(spark):
    rows = corpus()
    rows += [(1000, None, 0), (1001, "", 0), (1002, " NEW  Word\x1c\n", 0), (None, "w1 w2", 0), ((1 << 53) + 1, "w1", 0), (7, rows[7][1], 0), (1003, "w1 " * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    held = lambda k: zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2
    got = py.score(docs, py.crc_mod("doc_id", 7) == 2).collect()
    assert len(got) == len(rows)
    counts = Counter(t for k, text, _ in rows if not held(k) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for k, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    perplexity = lambda column: 10 ** (-sum(r[column] for r in out) / sum(r.n_tokens for r in out))
    assert perplexity("score") < 8 and perplexity("base_score") > 40
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_parts_agree(spark):
    """One part, many, and words dealt by their contexts too: the same counts, and nearly the same scores."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score int").repartition(2)
    one, *others = [{r.doc_id: r for r in py.score(docs, py.crc_mod("doc_id", 7) == 2, ranges=a, groups=b).collect()} for a, b in ((1, 1), (9, 1), (3, 4))]
    for other in others:
        assert other.keys() == one.keys()
        for k, r in one.items():
            assert (r.n_known, round(r.base_score, 9)) == (other[k].n_known, round(other[k].base_score, 9)) and abs(r.score - other[k].score) < 0.03 * r.n_tokens


def test_long_text_is_cut(spark, monkeypatch):
    text = " ".join(f"x{i % 7}" for i in range(1000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x1 x2"), (None, text)], "doc_id long, text string").coalesce(1)
    table = py.chunks(docs, "doc_id", "text", F.lit(False), chunk=300).collect()
    assert len(table) > 3 and sum(r.n for r in table) == 3 * 1001 + 3 + sum(int(py.unpacked(r.skips, "|b1").sum()) for r in table)
    whole, chunks = py.score(docs, F.lit(False)).collect(), py.chunks
    monkeypatch.setattr(py, "chunks", lambda *a: chunks(*a, chunk=300))
    order = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    cut = py.score(docs, F.lit(False)).collect()
    assert order(cut) == order(whole) and abs(sum(r.score for r in cut) - sum(r.score for r in whole)) < 2


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, n_tokens int")
    (r,) = py.score(docs, F.lit(True)).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0.0) and abs(r.score) < 1e-6
    assert py.score(docs.filter("false"), F.lit(True)).count() == 0


def test_base_alone_draws_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c", "", None, "A c c zz"])], "doc_id long, text string")
    base = lambda rows: sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    whole = py.score(docs, F.col("doc_id") >= 4, ranges=3, groups=2).collect()

    def no(*_, **__):
        raise AssertionError("a visit")

    monkeypatch.setattr(py.Model, "visit", no)
    alone = py.score(docs, F.col("doc_id") >= 4, ranges=3, groups=2, base_only=True).collect()
    assert base(alone) == base(whole) and all(r.score is None for r in alone)
