import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sessionlake.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab é\n\t\r#|\x1c\xa0", max_size=80)))
def test_statistics(text):
    text = text.encode(errors="replace").decode()
    assert quality.text_statistics(text.encode()) == plain(text)


def test_statistics_null():
    assert quality.text_statistics(None) == plain(None) == (0, 0, 0, 0, 0)


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_quantile(0.95, 2) - 5.9915) < 1e-3


def steps_of(x):
    words, chars = np.exp(x[:, 0].mean()), np.exp(x[:, 0].mean() + x[:, 1].mean())
    return np.maximum([np.log1p(1 / words), np.log1p(1 / chars), np.log1p(1000 / chars), np.log1p(6000 / words), np.log(2)], 0.1)


def brute(x, alpha, tries=400):
    """The least log determinant of many more starts over all rows of one group in memory, by exact quantiles; and the reweighted distances of it."""
    rng, floor, best = np.random.default_rng(5), np.diag(np.square(steps_of(x))), (np.inf, None, None)
    scale = lambda share: share / quality.chi2_cdf(quality.chi2_quantile(share, 5), 7)
    dist = lambda m, cov: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov + floor), x - m)
    for _ in range(tries):
        few = x[rng.permutation(len(x))[:6]]
        m, cov, last = few.mean(0), np.cov(few.T, bias=True), np.inf
        while True:
            d = dist(m, cov)
            inner = x[d <= np.sort(d)[int(np.ceil(alpha * len(x))) - 1]]
            m, cov = inner.mean(0), scale(len(inner) / len(x)) * np.cov(inner.T, bias=True)
            now = np.linalg.slogdet(cov + floor)[1]
            if last - now < 1e-9:
                break
            last = now
        best = min(best, (now, m, cov), key=lambda b: b[0])
    inner = x[dist(*best[1:]) <= quality.chi2_quantile(0.975, 5)]
    return best[0], dist(inner.mean(0), scale(0.975) * np.cov(inner.T, bias=True))


def test_least_determinant(spark):
    """A group with a tight third of outliers, and one with a statistic that is all but constant."""
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(5, 5)) * 0.4
    a = rng.normal(size=(600, 5)) @ mix + [5.5, 1.5, 0, 0, 0]
    a[:140] = rng.normal(size=(140, 5)) * 0.05 + [8, 3, 4, 4, 2]
    b = rng.normal(size=(400, 5)) @ mix.T + [5.0, 1.6, 0, 0, 0]
    b[:, 4] = (np.arange(400) < 6) * 1.1
    rows = [(g, *map(float, r)) for g, x in (("a", a), ("b", b)) for r in x]
    table = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.XS)).repartition(5)
    got = {r.grp: r for r in quality.least_determinant(table).collect()}
    for g, x in (("a", a), ("b", b)):
        _, want = brute(x, 0.75)
        r = got[g]
        inverse = np.array([[r[f"a{min(i, j)}{max(i, j)}"] / (1 + (i != j)) for j in range(5)] for i in range(5)])
        c = x - [r[m] for m in quality.MEANS]
        d = np.einsum("ni,ij,nj->n", c, inverse, c)
        assert np.median(abs(d / want - 1)) < 0.1 and np.corrcoef(d, want)[0, 1] > 0.99
    assert got["a"].m0 < 6.2


def test_least_determinant_before_reweighting(spark):
    """The steps end near the least determinant that far more starts find."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 5)), rng.normal(size=(200, 5)) * 3 + 2]) * 0.5 + [5, 1.5, 1, 1, 1]
    table = quality.save(spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in quality.XS)), "t")
    last, steps = [], quality.step

    def noted(rows, groups, *more):
        fell = steps(rows, groups, *more)
        last.append(groups.logdet.min())
        return fell

    try:
        quality.step = noted
        quality.least_determinant(table)
    finally:
        quality.step = steps
    found = last
    assert found[-1] < brute(x, 0.75, 300)[0] + 0.02 and len(last) < 20


def test_joins_by_salt(spark):
    """More estimates than are broadcast: each row meets its own once."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("g"), "id")
    few = quality.save(spark.range(6).select(F.col("id").alias("g"), (F.col("id") * 10).alias("x")), "few")
    salted = quality.met(rows, few, ["g"], salts=4, most=3)
    assert sorted(map(tuple, salted.collect())) == sorted((i % 7, i, i % 7 * 10) for i in range(5000) if i % 7 < 6)


def test_outliers(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("etaoinsh"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, int(np.exp(rng.normal(5, 0.4))))), ["en", None][i % 2], "s1", 1) for i in range(400)]
    rows += [(900 + i, "".join(f"{w}$$$ ### " for w in rng.choice(words, 100)), "en", "s1", 2) for i in range(5)]
    rows += [(950, None, "en", "s1", 3), (951, "", None, None, 3), (952, "one two", "en", None, 3), (None, rows[0][1], "en", "s9", 3), (0, rows[0][1], "en", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").repartition(3)
    got = quality.judge(quality.statistics(docs), least=20).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if not r.kept} == {*range(900, 905), 950, 951, 952}
    assert all(r.base_failed == (r.doc_id in (950, 951, 952)) for r in got)
    own = [r for r in got if r.lang == "en" and r.source == "s1" and not r.base_failed]
    x = np.log(np.array([[max(r.n_words, 1), (r.word_chars + 100) / (r.n_words + 20), 1 + 1000 * r.n_symbols / (r.word_chars + 100), 1 + 1000 * r.n_repeat_words / (r.n_words + 20), 1 + r.n_dup_lines] for r in own]))
    assert np.corrcoef(np.log(brute(x, 0.75, 300)[1]), np.log([r.distance for r in own]))[0, 1] > 0.97


def test_empty(spark):
    assert quality.judge(quality.statistics(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))).count() == 0


def test_waves_and_layout(spark):
    """Many groups in waves give what one wave gives, and other files give the same; a quantile far from where it is looked for is found."""
    rng = np.random.default_rng(6)
    rows = [(f"g{g}", *map(float, r)) for g in range(7) for r in rng.normal(size=(60 + g, 5)) * 10.0 ** (g - 3) + 5]
    rows += [("same", 5.0, 1.0, 0.0, 0.0, 0.0)] * 50
    table = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in quality.XS))
    one = {r.grp: r for r in quality.least_determinant(table.repartition(2)).collect()}
    many = {r.grp: r for r in quality.least_determinant(table.repartition(5), wave=3).collect()}
    assert one.keys() == many.keys() and len(one) == 8
    for g in one:
        assert np.allclose(np.array(one[g][1:]), np.array(many[g][1:]), rtol=1e-6), g


def test_a_group_of_copies_has_an_estimate(spark):
    rows = [("g", i % 2, 5.0 + i % 2, 1.0, 0.0, 0.0, 0.0) for i in range(900)]
    table = spark.createDataFrame(rows, "grp string, h long, " + ", ".join(f"{x} double" for x in quality.XS))
    for sample in (1, 20, 2000):
        (r,) = quality.least_determinant(table, sample=sample).collect()
        assert 5 <= r.m0 <= 6


def test_bins_in_order():
    t = np.sort(np.concatenate([np.linspace(-40, 40, 2001), np.linspace(-0.2, 0.2, 999)]))
    b = quality.bin_of(t)
    assert (np.diff(b) >= 0).all() and b.min() == -quality.FINE - 1 - quality.MOST_WIDE and b.max() == quality.FINE + quality.MOST_WIDE
    assert len(set(b.tolist())) == 2 * (quality.FINE + quality.MOST_WIDE + 1)
