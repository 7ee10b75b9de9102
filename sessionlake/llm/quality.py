"""Quality rules: text statistics, fixed base rules, and robust multivariate outliers per language and source.

The estimate is the minimum covariance determinant, found as FAST-MCD does (Rousseeuw and Van Driessen 1999). For each
group, many small subsets of a bounded sample are concentrated, as are medians with median absolute deviations; the few of least determinant start
concentration steps over all rows: distances of all rows, their alpha-quantile, mean and covariance of the rows within
it. After two such steps the one of least determinant goes on until a step lowers its logarithm by no more than 1e-3. Rows within the 0.975 quantile
of the chi-squared distribution by that estimate then give the final one (one-step reweighting).

Many statistics are zero for most texts, so a covariance alone may be singular. As in the regularised estimate (Boudt
et al. 2020), a fixed diagonal is added to it: the squares of what one count more makes of each statistic in a text of the
group's middle length, since no statistic is known more finely than that, and of LEAST_SPREAD at least: statistics are
logarithms, and texts that differ by less than a tenth do not differ in quality, however alike a group's texts are.

A step is one aggregate over the table of statistics, for all groups and starts: counts, sums and sums of products of the rows
in each bin of distance. Bins are narrow, 0.5 %, around the quantile of the step before, and wide elsewhere, so a start has some seventy; tasks
add up what they read, and the driver gets one row a bin for as many groups as it takes at once (`wave`). So rows of a group never meet in one
task, and a hot source is no different from others. Rows meet the final estimates by a broadcast of checked size, or else by salted keys. Groups of fewer rows than
`least` use their language's estimate, or else that of all rows. Samples go by a hash of key and text, not by the files that rows are in.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import CARRIED, map_rows, save, scratch, whole

BLANK, SYMBOLS, WINDOW = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 5
LATER = bytes(range(0x80, 0xC0))  # second and later bytes of a character
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS, PRIOR, PRIOR_CHARS = 5, 20, 5
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
XS, MEANS, STEPS = [f"x{i}" for i in range(DIMS)], [f"m{i}" for i in range(DIMS)], [f"f{i}" for i in range(DIMS)]
LEAST_SPREAD = 0.1
SUMS = ["n", *[f"v{i}" for i in range(DIMS + len(PAIRS))]]
BINS = 200  # of log distances, to each unit
FINE, MOST_WIDE, WIDE = 25, 9, 0.25  # fine bins on each side of where a quantile is looked for, wide ones beyond, and their width
BROADCAST_ROWS = 20_000  # estimates of about 0.4 kB


def text_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The five counts of STATS for one text; words are runs of other than ASCII white space, a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    n, repeated = len(words), 0
    if n > WINDOW:
        number: dict[bytes, int] = defaultdict(count().__next__)
        x = np.fromiter(map(number.__getitem__, words), np.uint64, n) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        windows = x[: n - WINDOW + 1].copy()
        for i in range(1, WINDOW):
            windows = windows * np.uint64(0x94D049BB133111EB) + x[i : n - WINDOW + 1 + i]
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        if same.any():
            twice = order[np.append(same, False) | np.insert(same, 0, False)]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + WINDOW, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    return n, len(text.translate(None, BLANK + LATER)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source"), carry: bool = False) -> DataFrame:
    """A row for each document: doc_id, lang, source, text_hash, the counts of STATS and base_failed; with `carry` the row itself too, as one column."""

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            found = np.array([text_statistics(t) for t in p["text"]], np.int64).reshape(-1, len(STATS))
            yield {k: p[k] for k in ("doc_id", "lang", "source", "text_hash")} | {s: found[:, i] for i, s in enumerate(STATS)} | {"base_failed": (found[:, 0] < 10) | (100 * found[:, 4] > 20 * found[:, 0])}

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(groups[0]).alias("lang"), F.col(groups[1]).alias("source"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), *whole(docs, carry))
    return map_rows(own, "doc_id long, lang string, source string, text_hash long, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean", rows)


def transformed() -> list[Column]:
    """The vector that distances are taken of. Shares are of the text with PRIOR words of PRIOR_CHARS added, so that those of short texts spread no wider."""
    words, chars = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR * PRIOR_CHARS
    return [F.log(F.greatest(F.col("n_words"), F.lit(1))), F.log(chars / words), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(1000 * F.col("n_repeat_words") / words), F.log1p("n_dup_lines")]


def chi2_cdf(x: float, dims: int) -> float:
    """Distribution function of the chi-squared distribution."""
    k = 2 - dims % 2
    p = math.erf(math.sqrt(x / 2)) if k == 1 else 1 - math.exp(-x / 2)
    while k < dims:
        p, k = p - (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1), k + 2
    return p


def chi2_quantile(p: float, dims: int) -> float:
    """By bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dims) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """By how much the covariance of the inner share of normal rows is too small."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, DIMS), DIMS + 2)


def met(rows: DataFrame, few: DataFrame, on: list[str], salts: int = 64, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with the rows of `few`, a written table. It is broadcast if it has `most` rows at most; else both sides get a salt, so that no key is hot."""
    if few.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(few), on)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*on, "salt"]).drop("salt")


ESTIMATE = "grp string, " + ", ".join([f"{c} double" for c in MEANS] + [f"a{i}{j} double" for i, j in PAIRS] + ["logdet double"])


def concentrated(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, steps: np.ndarray, alpha: float, times: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and log determinant after concentration steps over the rows of x, until the determinant stays or for some times."""
    floor, scale, last = np.diag(np.square(steps)), consistency(alpha), math.inf
    for _ in range(times):
        far = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov + floor), x - mean)
        inner = x[far <= np.partition(far, k := max(0, math.ceil(alpha * len(x)) - 1))[k]]
        mean, cov = inner.mean(0), scale * np.cov(inner.T, bias=True).reshape(DIMS, DIMS)
        now = float(np.linalg.slogdet(cov + floor)[1])
        if last - now < 1e-9:
            break
        last = now
    return mean, cov, now


def _starts(alpha: float, tries: int, starts: int):
    def find(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", *XS])
        x, steps, rng = np.repeat(own[XS].to_numpy(), own["copies"], axis=0), own[STEPS].iloc[0].to_numpy(float), np.random.default_rng(len(own))
        middle = np.median(x, axis=0)
        found = [concentrated(x, middle, np.diag(np.square(1.4826 * np.median(abs(x - middle), axis=0))), steps, alpha, 2)]
        for _ in range(tries):
            few = x[rng.permutation(len(x))[: DIMS + 1]]
            found.append(concentrated(x, few.mean(0), np.cov(few.T, bias=True).reshape(DIMS, DIMS), steps, alpha, 2))
        best = [concentrated(x, m, c, steps, alpha, 30) for m, c, _ in sorted(found, key=lambda f: f[2])[:starts]]
        best += [best[0]] * (starts - len(best))
        return pd.DataFrame({"grp": own["grp"].iloc[0], "start": range(starts), "mean": [b[0] for b in best], "cov": [b[1].ravel() for b in best]})

    return find


class Groups:
    """Means, covariances and log determinants of some groups, `starts` of each, on the driver: some 600 bytes a start."""

    def __init__(self, names: list[str], steps: np.ndarray, middle: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> None:
        self.names, self.steps, self.middle = names, steps, middle
        self.floor = np.square(steps)[:, None, :, None] * np.eye(DIMS)
        self.set(mean, cov)
        self.logdet = np.full(mean.shape[:2], np.inf)
        self.cut = np.full(mean.shape[:2], math.log(chi2_quantile(0.75, DIMS)))

    def set(self, mean: np.ndarray, cov: np.ndarray) -> None:
        self.mean, self.cov = mean, cov
        self.inverse = np.linalg.inv(cov + self.floor)

    def best(self) -> None:
        """Only the start of least determinant of each group stays."""
        at = np.arange(len(self.names)), self.logdet.argmin(1)
        self.logdet, self.cut = self.logdet[at][:, None], self.cut[at][:, None]
        self.set(self.mean[at][:, None], self.cov[at][:, None])

    def rows(self) -> list[tuple]:
        """Rows of ESTIMATE for the first start of each group."""
        return [(n, *map(float, m[0]), *[float(v[0][i, j] * (1 + (i != j))) for i, j in PAIRS], float(d[0])) for n, m, v, d in zip(self.names, self.mean, self.inverse, self.logdet)]


def bin_of(t: np.ndarray) -> np.ndarray:
    """The bin of a log distance that lies t from where the quantile is looked for: fine ones of 1 / BINS near it, wide ones of a quarter further off."""
    wide = np.minimum((abs(t) - FINE / BINS) // WIDE, MOST_WIDE)
    return np.where(abs(t) < FINE / BINS, np.floor(t * BINS), np.where(t < 0, -FINE - 1 - wide, FINE + wide)).astype(np.int64)


def _sums(vectors: DataFrame, groups: Groups, active: np.ndarray, within: float | None = None) -> pd.DataFrame:
    """g, start, bin, n, and sums of values and of products, less the group's middle, of the rows of active groups. within: only rows up to this distance, as one bin.

    A task adds up what it reads before anything is shuffled. At most MOST_WIDE * 2 + FINE * 2 + 2 rows a start come back.
    """
    names, mean, inverse, cut, middle, starts = groups.names, groups.mean, groups.inverse, groups.cut, groups.middle, groups.mean.shape[1]
    bins = 2 * (FINE + MOST_WIDE + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def out() -> pd.DataFrame:
            keys = np.fromiter(held, np.int64, len(held))
            values = np.array(list(held.values())).reshape(len(held), len(SUMS))
            held.clear()
            return pd.DataFrame({"g": keys // (starts * bins), "start": keys // bins % starts, "bin": keys % bins - FINE - MOST_WIDE - 1} | {c: values[:, i] for i, c in enumerate(SUMS)})

        for p in batches:
            g = pd.Categorical(p["grp"], categories=names).codes.astype(np.int64)
            own = np.flatnonzero((g >= 0) & active[g])
            g, x = g[own], p[XS].to_numpy(float)[own]
            y = x - middle[g]
            values = np.stack([np.ones(len(y)), *y.T, *[y[:, i] * y[:, j] for i, j in PAIRS]], 1)
            for s in range(starts):
                c = x - mean[g, s]
                d = np.maximum(np.einsum("ni,nij,nj->n", c, inverse[g, s], c), 0)
                b = bin_of(np.log(d + 1e-12) - cut[g, s]) if within is None else np.where(d <= within, 0, FINE)
                keys, at = np.unique((g * starts + s) * bins + b + FINE + MOST_WIDE + 1, return_inverse=True)
                totals = np.zeros((len(keys), len(SUMS)))
                np.add.at(totals, at, values)
                for k, v in zip(keys.tolist(), totals):
                    held[k] = held[k] + v if k in held else v
            if len(held) > 50_000:
                yield out()
        yield out()

    schema = "g long, start long, bin long, " + ", ".join(f"{c} double" for c in SUMS)
    found = vectors.select("grp", *XS).mapInPandas(run, schema)
    return found.groupBy("g", "start", "bin").agg(*[F.sum(c).alias(c) for c in SUMS]).toPandas()


def _moments(groups: Groups, g: int, total: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scaled covariance from a row of sums."""
    m, cov = total[1 : DIMS + 1] / total[0], np.zeros((DIMS, DIMS))
    for (i, j), v in zip(PAIRS, total[DIMS + 1 :]):
        cov[i, j] = cov[j, i] = consistency(share) * (v / total[0] - m[i] * m[j])
    return m + groups.middle[g], cov


def step(vectors: DataFrame, groups: Groups, alpha: float, active: np.ndarray) -> np.ndarray:
    """A concentration step over all rows of active groups: the rows within the alpha-quantile of distances make the next estimate.

    Returns by how much each log determinant fell; where it did not fall the estimate stays as it was. A quantile that lies in a wide bin is looked for again there.
    """
    mean, cov, logdet = groups.mean.copy(), groups.cov.copy(), np.full_like(groups.logdet, np.inf)
    todo = active.copy()
    while todo.any():
        sums, again = _sums(vectors, groups, todo), np.zeros_like(todo)
        for (g, s), own in sums.sort_values("bin").groupby(["g", "start"]):
            upto = own["n"].cumsum().to_numpy()
            k = int(np.searchsorted(upto, alpha * upto[-1] - 1e-9))
            b = int(own["bin"].iloc[k])
            if -FINE <= b < FINE:
                groups.cut[g, s] += (b + 0.5) / BINS
                mean[g, s], cov[g, s] = _moments(groups, g, own[SUMS].to_numpy()[: k + 1].sum(0), upto[k] / upto[-1])
                logdet[g, s] = np.linalg.slogdet(cov[g, s] + np.diag(np.square(groups.steps[g])))[1]
            else:
                wide = b - FINE if b >= FINE else -b - FINE - 1
                groups.cut[g, s] += (1 if b >= FINE else -1) * (FINE / BINS + WIDE * (wide + 0.5))
                again[g] = True
        todo = again
    fell = np.where(np.isinf(groups.logdet), np.inf, groups.logdet - logdet)
    fell[~active] = 0
    better = fell > 0
    groups.logdet = np.where(better, logdet, groups.logdet)
    groups.set(np.where(better[..., None], mean, groups.mean), np.where(better[..., None, None], cov, groups.cov))
    return fell


def _determinants(vectors: DataFrame, sizes: pd.DataFrame, alpha: float, sample: int, tries: int, starts: int, least: float) -> list[tuple]:
    """Rows of ESTIMATE for the groups in sizes."""
    spark = vectors.sparkSession
    few = F.broadcast(spark.createDataFrame(sizes[["grp", "n", *STEPS]]))
    share = F.least(F.lit(float(sample)) / F.col("n"), F.lit(1.0))
    some = vectors.join(few, "grp").filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    some = some.groupBy("grp", "h", *XS, *STEPS).agg(F.ceil(F.count("*") * F.max(share) - 1e-9).alias("copies"))  # repeated rows come in proportion
    first = some.groupBy("grp").applyInPandas(_starts(alpha, tries, starts), "grp string, start int, mean array<double>, cov array<double>").toPandas()
    found = {(g, s): (m, c) for g, s, m, c in zip(first["grp"], first["start"], first["mean"], first["cov"])}
    means = sizes[MEANS].to_numpy(float)
    # Where copies of few rows make up a group its sample may be empty: such a group starts from its mean.
    begin = [[found.get((g, s), (m, np.zeros(DIMS * DIMS))) for s in range(starts)] for g, m in zip(sizes["grp"], means)]
    mean, cov = (np.array([[b[k] for b in own] for own in begin], float) for k in (0, 1))
    groups = Groups(sizes["grp"].tolist(), sizes[STEPS].to_numpy(float), means, mean, cov.reshape(*mean.shape, DIMS))
    active, number = np.ones(len(sizes), bool), 0
    while active.any():
        fell, number = step(vectors, groups, alpha, active), number + 1
        if number == 2:
            groups.best()
        if number > 2:
            active = active & (fell[:, 0] > least)
    for g, own in _sums(vectors, groups, np.ones(len(sizes), bool), chi2_quantile(0.975, DIMS)).query("bin == 0").groupby("g"):
        groups.mean[g, 0], groups.cov[g, 0] = _moments(groups, g, own[SUMS].to_numpy()[0], 0.975)
    groups.set(groups.mean, groups.cov)
    groups.logdet = np.linalg.slogdet(groups.cov + groups.floor)[1]
    return groups.rows()


def least_determinant(rows: DataFrame, alpha: float = 0.75, sample: int = 2000, tries: int = 100, starts: int = 3, least: float = 1e-3, wave: int = 1000) -> DataFrame:
    """ESTIMATE for each group of rows (grp, x0 ..., and h, a hash that samples go by): the reweighted minimum covariance determinant.

    sample: about how many rows of a group the starts are sought in; all else takes all rows. tries: subsets there. A group is
    done when a step lowers its log determinant by no more than `least`; as it can't fall for ever, all groups come to an end. wave: how many groups are estimated at once, as
    their sums are added up on the driver, some 70 rows a start; each wave reads its own rows. rows: a written table.
    """
    spark = rows.sparkSession
    if "h" not in rows.columns:
        rows = rows.withColumn("h", F.xxhash64(*XS))
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), *[F.avg(x).alias(m) for x, m in zip(XS, MEANS)])
    words, chars = F.exp("m0"), F.exp(F.col("m0") + F.col("m1"))
    one_more = [F.log1p(1 / words), F.log1p(1 / chars), F.log1p(1000 / chars), F.log1p(1000 * (WINDOW + 1) / words), F.log(F.lit(2.0))]
    sizes = sums.select("grp", "n", *MEANS, *[F.greatest(c, F.lit(LEAST_SPREAD)).alias(f) for c, f in zip(one_more, STEPS)])
    first = sizes.limit(wave + 1).toPandas()
    if len(first) <= wave:
        return spark.createDataFrame(_determinants(rows, first, alpha, sample, tries, starts, least) if len(first) else [], ESTIMATE)
    sizes = save(sizes, "sizes")
    waves = -(-2 * sizes.count() // wave)
    dealt = scratch(spark, "waves")
    part = F.pmod(F.xxhash64("grp"), F.lit(waves)).cast("int").alias("wave")
    rows.select("grp", "h", *XS, part).repartition("wave", F.pmod("h", F.lit(16))).write.partitionBy("wave").parquet(dealt)
    out = scratch(spark, "estimates")
    for w in range(waves):
        own = sizes.select("*", part).filter(F.col("wave") == w).toPandas()
        if len(own):
            found = _determinants(spark.read.parquet(dealt).filter(F.col("wave") == w), own, alpha, sample, tries, starts, least)
            spark.createDataFrame(found, ESTIMATE).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def judge(stats: DataFrame, level: float = 0.9999, least: int = 200, **estimate: float) -> DataFrame:
    """Adds grp, distance (null where base_failed) and kept to statistics().

    Null languages and sources are groups of their own. Rows that fail the base rules have no part in estimates and are
    not kept. A table without other rows has no estimate and keeps nothing. estimate: parameters of least_determinant().
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    table = save(stats.withColumns({f"x{i}": x for i, x in enumerate(transformed())}).withColumns({"lang_key": part("lang"), "source_key": part("source")}), "stats")
    good = table.filter("not base_failed")
    of_lang = Window.partitionBy("lang_key")
    sizes = good.groupBy("lang_key", "source_key").count().withColumn("of_lang", F.sum("count").over(of_lang))
    grp = F.when(F.col("count") >= least, F.concat_ws("\x1f", "lang_key", "source_key")).when(F.col("of_lang") >= least, F.col("lang_key")).otherwise("")
    # A language's estimate is that of all its rows, not of those of small groups alone.
    names = save(sizes.withColumn("grp", grp).withColumn("wide", F.max(F.col("grp") == F.col("lang_key")).over(of_lang)).select("lang_key", "source_key", "grp", "wide"), "names")
    every = names.filter("grp = ''").limit(1).count() > 0
    own = met(good, names, ["lang_key", "source_key"])
    parts = F.array_compact(F.array(F.when(F.col("grp").contains("\x1f"), F.col("grp")), F.when(F.col("wide"), F.col("lang_key")), F.lit("") if every else F.lit(None).cast("string")))
    vectors = save(own.select(F.explode(parts).alias("grp"), F.xxhash64("doc_id", "text_hash").alias("h"), *XS), "vectors")
    found = least_determinant(vectors, **estimate)
    columns = ["doc_id", "lang", "source", "text_hash", *STATS, "base_failed", *[c for c in stats.columns if c == CARRIED]]
    d = sum((F.col(f"a{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) for i, j in PAIRS), F.lit(0.0))
    judged = met(own.select(*columns, "grp", *XS), found, ["grp"]).withColumn("d", F.greatest(d, F.lit(0.0))).select(*columns, (F.col("d") <= chi2_quantile(level, DIMS)).alias("kept"), "grp", F.col("d").alias("distance"))
    return judged.unionByName(table.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("string").alias("grp"), F.lit(None).cast("double").alias("distance")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    found = judge(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", *STATS, "base_failed", "kept", "distance")
