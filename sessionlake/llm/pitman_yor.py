"""A hierarchical Pitman-Yor language model of word pairs, seated by Gibbs sampling, and texts' probabilities under it.

Every word before is a context with a restaurant of its own; its customers are the words that follow it in the
training texts, and each of its tables is a customer of the parent restaurant of single words, whose base is uniform
over the training words and one more for all others:

    P(w)     = (c(w) - d1 t(w) + (s + d1 T) / (V + 1)) / (s + C)
    P(w | u) = (c(u, w) - d2 t(u, w) + (s + d2 T(u)) P(w)) / (s + C(u))

c are customers, t tables, capitals sums over words. In the parent, c(w) is the sum of t(u, w) over contexts. What is sampled
are the tables. A Gibbs step takes all customers of a dish from their tables and seats them again: the number of their
tables is drawn from its exact distribution given all else,

    p(t) ~ S(c, t) A(1) ... A(t - 1),   A(i) = (s + d2 (T(u) + i)) P(w with i customers more)

where S are generalised Stirling numbers, which count the ways to seat c customers at t tables by weight, and T(u) and P
leave out the dish's own. A sweep seats every dish of every context and of the parent so. Dishes of one context, or of
one word, that are seated in the same half of a sweep see each other as they were before it; two halves are drawn at random each time.

Pairs are dealt by ranges of the second word's hash, so a word's contexts and its dish in the parent are in one part; only
a context's tables T(u) are spread over parts. Where the vocabulary is large a word's contexts are dealt again by their own
hash (`groups`), so no part grows with the vocabulary, and a frequent context is spread over parts. A frequent word is not, below that
size: all chunks' pairs of it come to one part, unsummed. Messages grow as chunks times parts. Sums over parts are exchanged after each visit of `inner` sweeps, by messages of packed arrays from each part to each owner of
words; a part moves its own share of the sums with every sweep. Parts and chunks are bucketed tables, so only messages
are shuffled. Words are told apart by 64-bit hashes alone: two of a billion words would share one with a probability of 0.03.

The last visit's sweeps are the samples. t(u, w), T(u) and P(w) are averaged over them each for itself; the predictive
probability is linear in the first and in the product of the others, whose covariance over samples is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import WordIndex, crc_mod, drop, map_rows, save

END = np.uint64(0x9E3779B97F4A7C15)  # the hash of the end of a text, which is also what stands before its first word
EMPTY = np.uint64(xxhash.xxh3_64_intdigest(""))  # what splitting gives where a text begins or ends with white space
CHUNK = 2_000_000  # tokens
SAMPLED = 1024  # one of so many words counts for the size of the vocabulary
CODEC = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """An array as bytes: those of one rank together, then compressed, after their number."""
    x = np.ascontiguousarray(x)
    if not x.nbytes:
        return b""
    data = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not len(data):
        return np.zeros(0, kind)
    raw = np.frombuffer(CODEC.decompress(data[8:], int.from_bytes(data[:8], "little")), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def packed_steps(x: np.ndarray) -> bytes:
    """packed() for numbers in order: their differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)


def dealt(hashes: np.ndarray, n: int, low: bool = False) -> np.ndarray:
    """One of n ranges of hashes for each: by the high half, so that hashes in order are in order of their ranges, or by the low half."""
    half = hashes & np.uint64(0xFFFFFFFF) if low else hashes >> np.uint64(32)
    return (half * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Ratios:
    """S(c, t + 1) / S(c, t) of the generalised Stirling numbers of discount d, for c customers at t tables.

    Up to `most` customers they are exact. Beyond, t over the d-th power of c has a limit law (Pitman 2006), so they are those
    of `most` customers where that is the same: within 1 % at 4096 customers.
    """

    def __init__(self, d: float, most: int = 1024) -> None:
        self.d, self.most = d, most
        self.at = np.zeros(most * (most + 1) // 2 + 1)
        row = np.zeros(1)  # one customer
        for c in range(1, most):
            t = np.arange(1, c + 1)
            above = np.divide(1.0, np.concatenate([[np.inf], row[:-1]]))
            row = np.append((1 + (c - d * (t + 1)) * row) / (above + c - d * t), 0.0)
            self.at[c * (c + 1) // 2 : c * (c + 1) // 2 + c + 1] = row
        self.last = np.concatenate([[1 / d], row * np.arange(1, most + 1)])  # times t, from t = 0

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        if not (large := c > self.most).any():
            return self.at[c * (c - 1) // 2 + t - 1]
        out = np.empty(len(c))
        out[~large] = self.at[c[~large] * (c[~large] - 1) // 2 + t[~large] - 1]
        x = np.minimum(t[large] * (self.most / c[large]) ** self.d, self.most - 1e-9)
        i = x.astype(np.int64)
        out[large] = np.where(t[large] < c[large], (self.last[i] + (x - i) * (self.last[i + 1] - self.last[i])) / t[large], 0.0)
        return out


def draw(c: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], ratios: Ratios, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish of c customers, p(t) in proportion to S(c, t) weight(1) ... weight(t - 1).

    weight(dishes, t): that of one more table than t, for some dishes. The distribution has one peak; from there all t are
    gone through up and down until the rest has no weight to speak of, and one is drawn on the way.
    """
    every = np.arange(len(c))
    peak = np.ones(len(c), np.int64)
    up = lambda i, t: weight(i, t) * ratios(c[i], t)
    rise = np.flatnonzero((c > 1) & (up(every, peak) > 1))
    low, high = peak[rise], c[rise]  # w(t + 1) > w(t) at low, and not at high
    while (open_ := np.flatnonzero(high - low > 1)).size:
        mid = (low[open_] + high[open_]) // 2
        more = up(rise[open_], mid) > 1
        low[open_[more]], high[open_[~more]] = mid[more], mid[~more]
    peak[rise] = high
    out, total = peak.copy(), np.ones(len(c))
    for step in (1, -1):
        at = np.flatnonzero(peak < c) if step > 0 else rise
        t, now = peak[at], np.ones(len(at))
        while at.size:
            now = now * up(at, t) if step > 0 else now / up(at, t - 1)
            t = t + step
            total[at] += now
            hit = rng.random(len(at)) * total[at] < now
            out[at[hit]] = t[hit]
            live = (now > 1e-9 * total[at]) & (t < c[at] if step > 0 else t > 1)
            at, t, now = at[live], t[live], now[live]
    return out


def chunks(docs: DataFrame, key: str, text: str, held: Column, chunk: int = CHUNK) -> DataFrame:
    """Texts as numbers of words, `chunk` tokens or so in a row; a longer text is cut, and each later piece begins with the word before it, which is marked by `skips`.

    chunk, keys, nulls, held, text (a number of the text), skips, sizes: arrays of pieces; words: hashes in order; tokens: places among these.
    """

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        index, hashes, number = WordIndex(400_000), np.array([END]), TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        count, texts = 0, number

        def made() -> dict[str, list]:
            nonlocal count
            keys, held_, text_, skips, flats = zip(*pieces)
            flat, sizes = np.concatenate(flats), np.array([len(x) for x in flats], np.int64)
            distinct = np.flatnonzero(np.bincount(np.append(flat, 0)))  # the end is always a word, as it may be the first one's context
            order = np.argsort(hashes[distinct])
            words, at = hashes[distinct[order]], np.zeros(len(hashes), np.int32)
            at[distinct[order]] = np.arange(len(words))
            pieces.clear()
            count = 0
            return {
                "chunk": [number], "keys": [packed(np.array([k or 0 for k in keys], np.int64))], "nulls": [packed(np.array([k is None for k in keys]))], "held": [packed(np.array(held_, bool))], "text": [packed_steps(np.array(text_, np.int64))],
                "skips": [packed(np.array(skips, bool))], "sizes": [packed(sizes)], "words": [packed_steps(words)], "tokens": [packed(at[flat])], "n": [len(flat)], "sample": [words[words % np.uint64(SAMPLED) == 0].view(np.int64)],
            }

        for p in parts:
            if pieces and (count >= chunk or len(index.words) > index.keep):  # then words get new numbers
                yield made()
                number += 1
            known, cuts, new = index.look_up(pc.ascii_lower(pa.array(p["text"], pa.binary()).fill_null(b"").cast(pa.string())))
            fresh = np.array([xxhash.xxh3_64_intdigest(w) for w in new.to_pylist()], np.uint64)
            hashes = np.concatenate([[END] if len(new) == len(index.words) else hashes, fresh])
            for k, h, a, b in zip(p["key"], p["held"], cuts, cuts[1:]):
                own = known[a:b] + 1  # number 0 is the end
                if len(own) and (hashes[own[[0, -1]]] == EMPTY).any():
                    own = own[hashes[own] != EMPTY]
                own = np.append(own, 0)
                for begin in range(0, len(own), chunk):
                    piece = own[max(0, begin - 1) : begin + chunk]
                    pieces.append((k, h, texts, begin > 0, piece))
                    count += len(piece)
                    if count >= 2 * chunk:
                        yield made()
                        number += 1
                texts += 1
        if pieces:
            yield made()

    source = docs.select(F.col(key).cast("long").alias("key"), held.alias("held"), F.col(text).alias("text"))
    return map_rows(source, CHUNKS, rows, batch=512)


CHUNKS = "chunk long, keys binary, nulls binary, held binary, text binary, skips binary, sizes binary, words binary, tokens binary, n long, sample array<long>"


def pairs_of(row: pd.Series, words: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct pairs, by the second word and then the first: places of both, the pair of each token, and counts in training."""
    tokens, sizes = unpacked(row["tokens"], "<i4").astype(np.int64), unpacked(row["sizes"], "<i8")
    begin, skips = np.cumsum(sizes) - sizes, unpacked(row["skips"], "|b1")
    before = np.concatenate([[end], tokens[:-1]])
    before[begin] = end
    both, pair = np.unique(tokens * words + before, return_inverse=True)
    learns = np.repeat(~unpacked(row["held"], "|b1"), sizes)
    learns[begin[skips]] = False
    return both // words, both % words, pair, np.bincount(pair[learns], minlength=len(both))


def of_parts(words: np.ndarray, w: np.ndarray, u: np.ndarray, ranges: int, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The parts that a chunk's pairs go to: number, which words it has there (all of the range in the first group), which pairs."""
    edges = np.searchsorted(dealt(words, ranges), np.arange(ranges + 1))
    cuts, group = np.searchsorted(w, edges), dealt(words, groups, low=True)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        whole = np.arange(cuts[i], cuts[i + 1])
        for j in range(groups):
            own = whole[group[u[whole]] == j] if groups > 1 else whole
            if not j:
                yield i * groups, np.arange(edges[i], edges[i + 1]), own
            elif len(own):
                yield i * groups + j, np.unique(w[own]), own


REQUESTS = "part long, chunk long, words binary, each binary, us binary, u binary, c binary"
STATE = "part long, chunks array<long>, at array<binary>, word_at array<binary>, words binary, each binary, us binary, u binary, c binary, once long, twice long, tables long"
ANSWERS = "part long, owner long, at binary, tables binary, customers binary"
VISITS = "kind int, part long, owner long, at binary, tables binary, customers binary, mass binary, chunk long, c binary, t binary, own_t binary, t1 double, c1 double"
MOVED, SENT, TOLD = 0, 1, 2  # kinds of rows of a visit: a part's tables, its messages, and its answers to chunks


def requests(table: DataFrame, ranges: int, groups: int) -> DataFrame:
    """From each chunk to each part that has pairs of it: words, how many pairs each has, contexts, their places by pair, counts."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in rows:
            for _, row in p.iterrows():
                words = unpacked_steps(row["words"], "<u8")
                w, u, _, c = pairs_of(row, len(words), np.searchsorted(words, END))
                out: dict[str, list] = {k.split()[0]: [] for k in REQUESTS.split(", ")}
                for part, own, pairs in of_parts(words, w, u, ranges, groups):
                    us, places = np.unique(u[pairs], return_inverse=True)
                    first = np.diff(w[pairs], prepend=-1) != 0
                    steps = np.where(first, places, np.diff(places, prepend=0))
                    each = np.bincount(np.searchsorted(own, w[pairs]), minlength=len(own))
                    for to, v in zip(out.values(), (part, row["chunk"], packed_steps(words[own]), packed(each.astype(np.int32)), packed_steps(words[us]), packed(steps.astype(np.int32)), packed(c[pairs].astype(np.int32)))):
                        to.append(v)
                yield pd.DataFrame(out)

    return table.select("chunk", "held", "skips", "sizes", "words", "tokens").mapInPandas(run, REQUESTS)


def unfold(each: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and of the contexts of pairs, from the number of pairs each word has and the steps between its contexts."""
    w = np.repeat(np.arange(len(each)), each)
    if not len(w):
        return w, steps.astype(np.int64)
    total = np.cumsum(steps, dtype=np.int64)
    begin = (np.cumsum(each) - each)[each > 0]
    return w, total - np.repeat(total[begin] - steps[begin], each[each > 0])


def begin(own: pd.DataFrame) -> pd.DataFrame:
    """A part from the requests to it: distinct pairs in order of words and contexts, their counts, and where each chunk's are among them."""
    own = own.sort_values("chunk")
    words_, us_ = [unpacked_steps(x, "<u8") for x in own["words"]], [unpacked_steps(x, "<u8") for x in own["us"]]
    words, us = np.unique(np.concatenate(words_)), np.unique(np.concatenate(us_))
    word_at, keys = [], []
    for a, b, each, steps in zip(words_, us_, own["each"], own["u"]):
        w, u = unfold(unpacked(each, "<i4"), unpacked(steps, "<i4"))
        word_at.append(np.searchsorted(words, a))
        keys.append(word_at[-1][w] * np.int64(max(1, len(us))) + np.searchsorted(us, b)[u])
    sizes = [len(k) for k in keys]
    both, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(at, np.concatenate([unpacked(x, "<i4") for x in own["c"]]), len(both)).astype(np.int64)
    w, u = both // max(1, len(us)), both % max(1, len(us))
    steps = np.where(np.diff(w, prepend=-1) != 0, u, np.diff(u, prepend=0))
    return pd.DataFrame({
        "part": [own["part"].iloc[0]], "chunks": [own["chunk"].to_numpy()], "at": [[packed_steps(x.astype(np.int32)) for x in np.split(at, np.cumsum(sizes)[:-1])]], "word_at": [[packed_steps(x.astype(np.int32)) for x in word_at]],
        "words": [packed_steps(words)], "each": [packed(np.bincount(w, minlength=len(words)).astype(np.int32))], "us": [packed_steps(us)], "u": [packed(steps.astype(np.int32))], "c": [packed(c)],
        "once": [int((c == 1).sum())], "twice": [int((c == 2).sum())], "tables": [int((c > 0).sum())],
    })


class Part:
    """A part's pairs, and the words whose sums it shares with others: ids, in order, those of an owner together."""

    def __init__(self, row: pd.Series, ranges: int) -> None:
        words, us = unpacked_steps(row["words"], "<u8"), unpacked_steps(row["us"], "<u8")
        self.w, self.u = unfold(unpacked(row["each"], "<i4"), unpacked(row["u"], "<i4"))
        self.c, self.words, self.contexts = unpacked(row["c"], "<i8"), len(words), len(us)
        self.ids = np.union1d(words, us)
        self.of_words, self.of_us = np.searchsorted(self.ids, words), np.searchsorted(self.ids, us)
        owner = dealt(self.ids, ranges)
        self.owners, first = np.unique(owner, return_index=True)
        self.cuts = first[1:]

    def by_owner(self, words: np.ndarray | None, contexts: np.ndarray | None, kind: type) -> list[bytes]:
        """Values of words or of contexts as messages to owners."""
        out = np.zeros(len(self.ids), kind)
        if words is not None:
            out[self.of_words] = words
        if contexts is not None:
            out[self.of_us] = contexts
        return [packed(x) for x in np.split(out, self.cuts)]


def first_messages(state: DataFrame, ranges: int) -> DataFrame:
    """part, owner, ids, tables of contexts, customers of words in the parent, and counts of words, with a table for each pair."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in rows:
            for _, row in p.iterrows():
                x = Part(row, ranges)
                seen = x.c > 0
                t, cp = np.bincount(x.u[seen], minlength=x.contexts), np.bincount(x.w[seen], minlength=x.words)
                n = np.bincount(x.w, x.c, x.words)
                yield pd.DataFrame({"part": row["part"], "owner": x.owners, "ids": [packed_steps(i) for i in np.split(x.ids, x.cuts)], "tables": x.by_owner(None, t, np.int64), "customers": x.by_owner(cp, None, np.int64), "counts": x.by_owner(n, None, np.int64)})

    return state.select("part", "words", "each", "us", "u", "c").mapInPandas(run, "part long, owner long, ids binary, tables binary, customers binary, counts binary")


def first_sums(own: pd.DataFrame) -> pd.DataFrame:
    """An owner's sums over parts, told to each of them with the places of its ids; and for itself the counts of its words."""
    asked = [unpacked_steps(x, "<u8") for x in own["ids"]]
    ids, at = np.unique(np.concatenate(asked), return_inverse=True)
    edges = np.cumsum([len(x) for x in asked])[:-1]
    tables, customers, counts = (np.bincount(at, np.concatenate([unpacked(x, "<i8") for x in own[k]]), len(ids)).astype(np.int64) for k in ("tables", "customers", "counts"))
    told = pd.DataFrame({"part": own["part"], "owner": own["owner"], "at": [packed_steps(x.astype(np.int32)) for x in np.split(at, edges)], "tables": [packed(x) for x in np.split(tables[at], edges)], "customers": [packed(x) for x in np.split(customers[at], edges)], "counts": None, "n": 0, "v": 0, "once": 0, "twice": 0})
    whole = pd.DataFrame({"part": [-1], "owner": [own["owner"].iloc[0]], "at": [None], "tables": [None], "customers": [None], "counts": [packed(counts)], "n": [counts.sum()], "v": [(counts > 0).sum()], "once": [(customers == 1).sum()], "twice": [(customers == 2).sum()]})
    return pd.concat([told, whole])


def later_sums(own: pd.DataFrame) -> pd.DataFrame:
    at = [unpacked_steps(x, "<i4") for x in own["at"]]
    flat, edges = np.concatenate(at), np.cumsum([len(x) for x in at])[:-1]
    tables, customers = (np.bincount(flat, np.concatenate([unpacked(x, "<i8") for x in own[k]])).astype(np.int64)[flat] for k in ("tables", "customers"))
    return pd.DataFrame({"part": own["part"], "owner": own["owner"], "at": own["at"], "tables": [packed(x) for x in np.split(tables, edges)], "customers": [packed(x) for x in np.split(customers, edges)]})


class Model:
    """Numbers that all parts share: discounts, strength, sizes of the vocabulary and of the parent."""

    def __init__(self, strength: float, d1: float, d2: float, v: int, t1: float, c1: float, ranges: int, groups: int, seed: int) -> None:
        self.s, self.d1, self.d2, self.v, self.t1, self.c1, self.ranges, self.groups, self.seed = strength, d1, d2, v, t1, c1, ranges, groups, seed

    @property
    def base(self) -> float:
        """The parent's probability of a word that it has no customer of."""
        return (self.s + self.d1 * self.t1) / ((self.s + self.c1) * (self.v + 1))

    def visit(self, number: int, sweeps: int, last: bool, halves: int = 2) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        """A function of a part and of what owners tell it: its rows after some sweeps, which are samples in the last visit."""
        s, d1, d2, v, t1, c1 = self.s, self.d1, self.d2, self.v, self.t1, self.c1

        def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            row = own.iloc[0]
            x, rng = Part(row, self.ranges), np.random.default_rng([self.seed, number, int(row["part"])])
            of_pairs, of_words = Ratios(d2), Ratios(d1)
            moved, told = told[told["owner"] < 0], told[told["owner"] >= 0].sort_values("owner")
            many = np.flatnonzero(x.c > 1)
            t = (x.c > 0).astype(np.int64)
            if len(moved):
                t[many] = unpacked(moved["t"].iloc[0], "<i4")
            tables_, customers_ = (np.concatenate([unpacked(y, "<i8") for y in told[k]]) for k in ("tables", "customers"))
            other_t = tables_[x.of_us] - np.bincount(x.u, t, x.contexts)
            other_c = customers_[x.of_words] - np.bincount(x.w, t, x.words)
            cp = other_c + np.bincount(x.w, t, x.words)
            tp = unpacked(moved["own_t"].iloc[0], "<i4").astype(float) if len(moved) else np.minimum(cp, 1.0)
            before_t, before_p = t.sum(), tp.sum()
            sum_t, sum_tables, mass, sum_t1, sum_c1 = np.zeros(len(t), np.int64), np.zeros(x.contexts, np.int64), np.zeros(x.words), 0.0, 0.0
            for _ in range(sweeps):
                for half in np.array_split(rng.permutation(many), halves) if len(many) else []:
                    half.sort()
                    w, u, c, k = x.w[half], x.u[half], x.c[half], t[half]
                    cp = other_c + np.bincount(x.w, t, x.words)
                    all_c, all_t = c1 + t.sum() - before_t, t1 + tp.sum() - before_p
                    rest = s + d2 * ((other_t + np.bincount(x.u, t, x.contexts))[u] - k)
                    # The parent without the tables of this dish: each that goes may have been alone at its own.
                    left, had = cp[w] - k, tp[w]
                    alone = np.where(had > 1, 1 / (1 + (cp[w] - 1 - d1 * had) * of_words(np.maximum(cp[w], 2).astype(np.int64) - 1, np.clip(had - 1, 1, np.maximum(cp[w] - 1, 1)).astype(np.int64))), 0.0)
                    kept = np.where(left < 1, 0.0, np.clip(had - k * alone, 1, np.maximum(left, 1)))
                    base = (s + d1 * (all_t - had + np.maximum(kept, 1))) / (v + 1)
                    top, bottom = left - d1 * np.maximum(kept, 1) + base, s + all_c - k
                    weight = lambda i, n, rest=rest, top=top, bottom=bottom: (rest[i] + d2 * n) * (top[i] + n) / (bottom[i] + n)
                    t[half] = draw(c, weight, of_pairs, rng)
                cp = other_c + np.bincount(x.w, t, x.words)
                held = np.flatnonzero(cp > 1)
                rest = s + d1 * (t1 + tp.sum() - before_p - tp[held])
                tp = np.minimum(cp, 1.0)
                tp[held] = draw(cp[held].astype(np.int64), lambda i, n, rest=rest: (rest[i] + d1 * n) / (v + 1), of_words, rng)
                if last:
                    all_c, all_t = c1 + t.sum() - before_t, t1 + tp.sum() - before_p
                    sum_t += t
                    sum_tables += np.bincount(x.u, t, x.contexts).astype(np.int64)
                    mass += (np.bincount(x.w, t, x.words) - (d1 * tp if row["part"] % self.groups == 0 else 0)) / (s + all_c)
                    sum_t1, sum_c1 = sum_t1 + tp.sum() / sweeps, sum_c1 + t.sum() / sweeps
            if not last:
                sum_tables, sum_t1, sum_c1 = np.bincount(x.u, t, x.contexts), tp.sum(), t.sum()
            out = [pd.DataFrame({"kind": [MOVED], "part": [row["part"]], "t": [packed(t[many].astype(np.int32))], "own_t": [packed(tp.astype(np.int32))], "t1": [float(sum_t1) if row["part"] % self.groups == 0 else 0.0], "c1": [float(sum_c1)]})]
            sent = pd.DataFrame({"kind": SENT, "part": row["part"], "owner": x.owners, "at": told["at"].to_numpy(), "tables": x.by_owner(None, sum_tables, np.int64)})
            if last:
                sent["mass"] = x.by_owner(mass / sweeps, None, np.float32)
                c = x.c.astype(np.int32)
                answers = [(k, unpacked_steps(a, "<i4")) for k, a in zip(row["chunks"], row["at"])]
                out.append(pd.DataFrame({"kind": TOLD, "part": row["part"], "chunk": [k for k, _ in answers], "c": [packed(c[a]) for _, a in answers], "t": [packed(sum_t[a].astype(np.int32)) for _, a in answers]}))
            else:
                sent["customers"] = x.by_owner(np.bincount(x.w, t, x.words), None, np.int64)
            return pd.concat([*out, sent]).reindex(columns=[c.split()[0] for c in VISITS.split(", ")])

        return run


def discount(once: float, twice: float) -> float:
    """Estimate from numbers seen once and twice."""
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", samples: int = 5, burn: int = 2, inner: int = 3, strength: float = 1.0, part_tokens: int = 3_000_000, part_words: int = 4_000_000, ranges: int | None = None, groups: int | None = None, seed: int = 7, base_only: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    The model learns from rows where `held` is false. Words are runs of other than ASCII white space, in which A-Z count
    as a-z; each text ends with one more token. A null text is an empty one: its end alone. base_score is that of single
    words with one added to each count, score the model's; both are log10 of the text's probability. Without a training
    row all words are unknown. Rows that repeat are learned and scored each for itself; other columns are left out.

    burn visits of inner sweeps come before the last one of `samples` sweeps. ranges and groups: parts by the second and by
    the first word, from part_tokens and part_words unless given. base_only: score is null, and nothing is drawn.
    """
    spark = docs.sparkSession
    table = save(chunks(docs, key, text, F.coalesce(held, F.lit(False))), "chunks")
    size = table.agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).first()
    if not size["chunks"]:
        return spark.createDataFrame([], SCORES)
    found = table.select(F.explode("sample").alias("w")).agg(F.approx_count_distinct("w", 0.02).alias("n")).first()["n"]
    groups = groups or max(1, -(-found * SAMPLED // part_words))
    ranges = ranges or max(8, -(-size["n"] // (part_tokens * groups)))
    parts = min(ranges * groups, 50_000)  # buckets; more parts than that share them

    asked = requests(table, ranges, groups)
    state = save(asked.groupBy("part").applyInPandas(begin, STATE), "parts", "part", parts)
    sums = save(first_messages(state, ranges).groupBy("owner").applyInPandas(first_sums, f"{ANSWERS}, counts binary, n long, v long, once long, twice long"), "sums")
    whole = sums.filter("part < 0")
    words = whole.agg(*[F.sum(c).alias(c) for c in ("n", "v", "once", "twice")]).first()
    pairs = state.agg(*[F.sum(c).alias(c) for c in ("once", "twice", "tables")]).first()
    n_train, v = int(words["n"]), int(words["v"])
    model = Model(strength, discount(words["once"], words["twice"]), discount(pairs["once"], pairs["twice"]), v, v, pairs["tables"], ranges, groups, seed)
    told, visited = sums.filter("part >= 0").select("part", "owner", "at", "tables", "customers"), None
    for number in range(0 if base_only else burn + 1):
        last = number == burn
        if visited is not None:
            moved = visited.filter(f"kind = {MOVED}")
            told = save(visited.filter(f"kind = {SENT}").groupBy("owner").applyInPandas(later_sums, ANSWERS), "sums")
            right = told.unionByName(moved.select("part", F.lit(-1).cast("long").alias("owner"), "t", "own_t"), allowMissingColumns=True)
        else:
            right = told.withColumns({"t": F.lit(None).cast("binary"), "own_t": F.lit(None).cast("binary")})
        before, visited = visited, save(state.drop("once", "twice", "tables", "word_at", *([] if last else ["chunks", "at"])).groupBy("part").cogroup(right.groupBy("part")).applyInPandas(model.visit(number, samples if last else inner, last), VISITS), "visit")
        if before is not None:
            drop(before, told)
        now = visited.filter(f"kind = {MOVED}").agg(F.sum("t1").alias("t1"), F.sum("c1").alias("c1")).first()
        model.t1, model.c1 = now["t1"] or 0.0, now["c1"] or 0.0
    base, d2 = model.base, model.d2

    def answer_words(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({k: [] for k in ("chunk", "part", "n", "mass", "tables")})
        row, counts, sent = own.iloc[0], told[told["counts"].notna()], told[told["counts"].isna()]
        n = unpacked(counts["counts"].iloc[0], "<i8")
        at = [unpacked_steps(x, "<i4") for x in row["word_at"]]
        if base_only:
            return pd.DataFrame({"chunk": row["chunks"], "part": row["part"], "n": [packed(n[x]) for x in at], "mass": None, "tables": None})
        flat = np.concatenate([unpacked_steps(x, "<i4") for x in sent["at"]])
        tables = np.bincount(flat, np.concatenate([unpacked(x, "<i8") for x in sent["tables"]]), len(n)).astype(np.int64)
        mass = np.bincount(flat, np.concatenate([unpacked(x, "<f4") for x in sent["mass"]]), len(n)).astype(np.float32)
        return pd.DataFrame({"chunk": row["chunks"], "part": row["part"], "n": [packed(n[x]) for x in at], "mass": [packed(mass[x]) for x in at], "tables": [packed(tables[x]) for x in at]})

    owners = state.filter(F.col("part") % groups == 0).select("part", "chunks", "word_at")
    counted = whole.select((F.col("owner") * groups).alias("part"), "counts")
    sent = counted if base_only else visited.filter(f"kind = {SENT}").select((F.col("owner") * groups).alias("part"), "at", "tables", "mass").unionByName(counted, allowMissingColumns=True)
    of_words = owners.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(answer_words, "chunk long, part long, n binary, mass binary, tables binary")
    both = of_words.withColumns({"c": F.lit(None).cast("binary"), "t": F.lit(None).cast("binary")}) if base_only else of_words.unionByName(visited.filter(f"kind = {TOLD}").select("chunk", "part", "c", "t"), allowMissingColumns=True)

    def tell(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, answers = own.iloc[0], answers.sort_values("part")
        hashes = unpacked_steps(row["words"], "<u8")
        of_words, of_pairs = answers[answers["n"].notna()], answers[answers["c"].notna()]
        joined = lambda c, k: np.concatenate([unpacked(x, k) for x in of_words[c]])
        n, p = joined("n", "<i8"), None
        if not base_only:
            mass, tables = joined("mass", "<f4"), joined("tables", "<i8")
            w, u, pair, _ = pairs_of(row, len(hashes), np.searchsorted(hashes, END))
            c, t = np.zeros(len(w)), np.zeros(len(w))
            for (_, _, at), x, y in zip(of_parts(hashes, w, u, ranges, groups), of_pairs["c"], of_pairs["t"]):
                c[at], t[at] = unpacked(x, "<i4"), unpacked(y, "<i4")
            p = (c - d2 * t / samples + (strength + d2 * tables[u] / samples) * (mass[w].astype(float) + base)) / (strength + n[u])
        sizes, skips, tokens = unpacked(row["sizes"], "<i8"), unpacked(row["skips"], "|b1"), unpacked(row["tokens"], "<i4")
        begin_ = np.cumsum(sizes) - sizes
        counts = np.ones(len(tokens), np.int64)
        counts[begin_[skips]] = 0
        total = lambda x: np.add.reduceat(x * counts, begin_)
        keys = pd.array(unpacked(row["keys"], "<i8"), "Int64")
        keys[unpacked(row["nulls"], "|b1")] = None
        text = unpacked_steps(row["text"], "<i8")
        return pd.DataFrame({
            "doc_id": keys, "held_out": unpacked(row["held"], "|b1"), "n_tokens": total(np.ones(len(tokens), np.int64)), "n_known": total((n > 0)[tokens].astype(np.int64)), "train_tokens": n_train,
            "base_score": total(np.log10((n + 1) / (n_train + v + 1))[tokens]), "score": None if p is None else total(np.log10(p)[pair]), "text": text, "cut": skips | (tokens[begin_ + sizes - 1] != np.searchsorted(hashes, END)),
        })

    scores = table.drop("n", "sample").groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(tell, f"{SCORES}, text long, cut boolean")
    scores = save(scores, "scores")
    drop(table, state, sums, *([visited] if visited is not None else []))
    pieces = scores.filter("cut").groupBy("doc_id", "held_out", "train_tokens", "text").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    columns = [c.split()[0] for c in SCORES.split(", ")]
    return scores.filter("not cut").select(*columns).unionByName(pieces.select(*columns))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def query(spark: SparkSession, sf_dir: str, base_only: bool = False) -> DataFrame:
    """All documents; those whose remainder by seven is two are not learned from."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_mod("doc_id", 7) == 2, base_only=base_only)
