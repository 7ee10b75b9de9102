"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by a forward algorithm; a text's is the product over its words. Pieces never
cross words, so a word is scored once in a worker and then looked up. A character without a piece costs the same in
every language.

Piece probabilities are fitted by expectation maximisation on a bounded sample: about `sample` labelled documents of
each language, chosen by a hash of the key. Prediction covers every word of every text.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import crc_mod, held, map_rows, save, whole, WordIndex

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"  # the mark of a word's start in the vocabulary
LONGEST, UNKNOWN = 16, math.log(1e-9)
SHORT = 28  # words of so many characters have probabilities that a double can hold
UND = "und"
SHIFT = np.uint64(46)
POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def spread_characters(text: str) -> np.ndarray:
    """A 64-bit number for each character."""
    x = (np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


class Pieces:
    """The vocabulary: ids of pieces, and the log probability of words under rows of piece log probabilities."""

    def __init__(self, path: str = PIECE_MODEL) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {p: i for i in ordinary if len(p := model.id_to_piece(i).lower()) <= LONGEST}
        self.size = model.get_piece_size()
        names = list(self.ids)
        marks, at = spread_characters("".join(names)), 0
        left: dict[int, int] = {}
        for p in names:
            own = marks[at : at + len(p)][::-1]
            left[int((own * POWERS[: len(own)]).sum(dtype=np.uint64))] = self.ids[p]
            at += len(p)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while left:  # what finds its place taken goes to another table
            keys, ids, rest = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32), {}
            for h, i in left.items():
                place = h >> int(SHIFT)
                if keys[place]:
                    rest[h] = i
                else:
                    keys[place], ids[place] = h, i
            self.tables.append((keys, ids))
            left = rest

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by their hashes, -1 for others; each table has one place for each value of a hash's upper bits."""
        out = np.full(hashes.shape, -1, np.int32)
        for keys, ids in self.tables:
            place = (hashes >> SHIFT).astype(np.int64)
            hit = keys[place] == hashes
            out[hit] = ids[place[hit]]
        return out

    def lattices(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of one length together: their places in `words`, and the piece id [word, end, size of piece]; -1: none, -2: unknown character."""
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(k)
        for n, places in by_size.items():
            most = min(n, LONGEST)
            step = max(1, 1_000_000 // (n * most))
            for at in range(0, len(places), step):
                own = places[at : at + step]
                marks = spread_characters("".join(START + words[k] for k in own)).reshape(len(own), n)
                lattice, hashes = np.full((len(own), n, most), -1, np.int32), np.zeros((len(own), n), np.uint64)
                for s in range(1, most + 1):  # hashes of the s characters up to each end
                    hashes[:, s - 1 :] += marks[:, : n - s + 1] * POWERS[s - 1]
                    lattice[:, s - 1 :, s - 1] = self.find(hashes[:, s - 1 :])
                lattice[:, :, 0][lattice[:, :, 0] < 0] = -2
                yield own, lattice

    def forward(self, lattice: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Probability of all beginnings [word, end 0..n, language], summed over segmentations; its logarithm for words over SHORT."""
        many, n, most = lattice.shape
        plain = n <= SHORT
        p = np.exp(logp) if plain else logp
        alpha = np.full((many, n + 1, logp.shape[1]), 0.0 if plain else -np.inf)
        alpha[:, 0] = 1.0 if plain else 0.0
        for e in range(1, n + 1):
            m = min(e, most)
            before, piece = alpha[:, e - m : e][:, ::-1], p[lattice[:, e - 1, :m]]
            alpha[:, e] = np.einsum("wsl,wsl->wl", before, piece) if plain else np.logaddexp.reduce(before + piece, axis=1)
        return alpha

    def score(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language. logp: [piece, language], with rows for unknown (-2) and none (-1) last."""
        out = np.zeros((len(words), logp.shape[1]))
        for own, lattice in self.lattices(words):
            last = self.forward(lattice, logp)[:, -1]
            out[own] = np.log(last) if lattice.shape[1] <= SHORT else last
        return out

    def expected(self, words: list[str], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of weighted words, by forward and backward sums; one language."""
        total = np.zeros(self.size + 2)
        for own, lattice in self.lattices(words):
            many, n, most = lattice.shape
            plain = n <= SHORT
            p = np.exp(logp) if plain else logp
            alpha = self.forward(lattice, logp[:, None])[:, :, 0]
            beta = np.full((many, n + 1), 0.0 if plain else -np.inf)
            beta[:, n] = 1.0 if plain else 0.0
            for b in range(n - 1, -1, -1):
                m = min(n - b, most)
                sizes = np.arange(m)
                after, piece = beta[:, b + 1 : b + 1 + m], p[lattice[:, b + sizes, sizes]]
                beta[:, b] = (after * piece).sum(1) if plain else np.logaddexp.reduce(after + piece, axis=1)
            for s in range(most):
                e = np.arange(s + 1, n + 1)
                ids = lattice[:, e - 1, s]
                own_uses = alpha[:, e - s - 1] * p[ids] * beta[:, e] / alpha[:, -1:] if plain else np.exp(alpha[:, e - s - 1] + p[ids] + beta[:, e] - alpha[:, -1:])
                uses = own_uses * weights[own][:, None]
                total += np.bincount((ids % (self.size + 2)).ravel(), uses.ravel(), self.size + 2)
        return total


def letters(word: str) -> list[str]:
    """Runs of letters of a lower-cased word."""
    if word.isalpha():
        return [word]
    return "".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFC", word)).split()


def pieces(path: str) -> Pieces:
    """This worker's vocabulary."""
    return held(("pieces", path), lambda: Pieces(path))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 800, rounds: int = 3, path: str = PIECE_MODEL) -> DataFrame:
    """Piece log probabilities of each language: lang, piece, logp. Rows with a null text or language are left out.

    One task fits a language, from the words of its sample: `sample` documents or so by a hash of key, text and place, so that
    repeated keys or texts are not all taken.
    """
    own = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id()), F.lit(1 << 30)).alias("h")).filter("lang is not null and text is not null")
    share = own.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    chosen = own.join(F.broadcast(share), "lang").filter(F.col("h") < F.col("share") * (1 << 30)).select("lang", "text")

    def words(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            found: Counter[tuple[str, str]] = Counter()
            for name, t in zip(p["lang"], p["text"]):
                for w, n in Counter(t.decode(errors="replace").lower().split()).items():
                    for x in letters(w):
                        found[name, x] += n
            yield {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    counted = map_rows(chosen, "lang string, word string, n long", words).groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def estimate(own: pd.DataFrame) -> pd.DataFrame:
        voc, weights, known = pieces(path), own["n"].to_numpy(float), own["word"].tolist()
        logp = np.full(voc.size + 2, -np.inf)
        logp[list(voc.ids.values())] = -math.log(len(voc.ids))
        for _ in range(rounds):
            logp[voc.size] = UNKNOWN
            uses = voc.expected(known, weights, logp)[: voc.size]
            uses[list(voc.ids.values())] += 0.05  # no piece is impossible
            with np.errstate(divide="ignore"):
                logp[: voc.size] = np.log(uses / uses.sum())
        at = np.flatnonzero(np.isfinite(logp[: voc.size]))
        return pd.DataFrame({"lang": own["lang"].iloc[0], "piece": at, "logp": logp[at]})

    return counted.groupBy("lang").applyInPandas(estimate, "lang string, piece int, logp double")


def predict(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", keep: int = 400_000, path: str = PIECE_MODEL, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and text_hash for each row of docs, from its text alone.

    score is the probability of the language predicted, all being as likely beforehand; ties go to the first by name. A null
    text, or one without a letter, is `und` with score 0, and so is every text where no language was learned. The
    model is sent to tasks: its size is that of the vocabulary times the number of languages. carry adds the row itself, as one column.
    """
    rows = model.collect()
    langs = sorted({r["lang"] for r in rows})
    voc_size = pieces(path).size
    table = np.full((voc_size + 2, max(1, len(langs))), -np.inf)
    for name in langs:
        own = [(r["piece"], r["logp"]) for r in rows if r["lang"] == name]
        table[[p for p, _ in own], langs.index(name)] = [x for _, x in own]
    table[voc_size] = UNKNOWN
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def rows_of(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        voc, logp = pieces(path), sent.value
        index, scores = WordIndex(keep), np.zeros((0, len(langs) + 1))  # of known words; the last column counts runs of letters
        for p in parts:
            known, cuts, new = index.look_up(pc.utf8_lower(pa.array(p["text"], pa.binary()).fill_null(b"").cast(pa.string())))
            runs = [letters(w) for w in new.to_pylist()]
            flat = list({r for own in runs for r in own})
            at, own_scores = {r: i for i, r in enumerate(flat)}, voc.score(flat, logp)
            fresh = np.zeros((len(runs), len(langs) + 1))
            lone = np.array([i for i, own in enumerate(runs) if len(own) == 1], np.int64)
            fresh[lone, :-1] = own_scores[[at[runs[i][0]] for i in lone.tolist()]][:, : len(langs)]
            fresh[lone, -1] = 1
            for i, own in enumerate(runs):
                if len(own) > 1:
                    fresh[i] = [*own_scores[[at[r] for r in own]].sum(0)[: len(langs)], len(own)]
            scores = fresh if len(new) == len(index.words) else np.concatenate([scores, fresh])
            names, sure = [], []
            for a, b in zip(cuts, cuts[1:]):
                total = scores[known[a:b]].sum(0)
                if not langs or not round(total[-1]):
                    names.append(UND)
                    sure.append(0.0)
                else:
                    best = int(total[:-1].argmax())
                    names.append(langs[best])
                    sure.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            yield {"doc_id": p["doc_id"], "lang_pred": names, "score": sure, "text_hash": p["text_hash"]}

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), *whole(docs, carry))
    return map_rows(own, "doc_id long, lang_pred string, score double, text_hash long", rows_of, batch=1024)


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return crc_mod(key, 5) == 0


def learn(docs: DataFrame, **options) -> DataFrame:
    """fit() on all that is not held out, as a written table."""
    return save(fit(docs.filter(~held_out()), **options), "language-model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
