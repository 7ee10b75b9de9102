"""Token counts of fields or sections by offset-mapped attribution.

Each document is encoded once, as a whole. Every token has a span of characters; spans are joined with those of the
sections, and a token belongs to the section that has the most of its characters, the first of those on a tie. A
token that holds part of a character counts as covering it from the character's first byte on. Tokens and sections
are both in order, so the join is two binary searches a document, in the task that encoded it.

By default a section is a line with its line feed. Other sections are given as an array of (start, end) in
characters, ends excluded: they may leave gaps but not overlap; tokens without a character in any section go to
section -1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import map_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTS = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, text_hash long"
_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str = RANKS) -> tuple:
    """This worker's encoding, and the bytes of each id."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(b) for b in ranks]
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODINGS[path]


def spans(text: bytes, path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of each token of a UTF-8 text."""
    enc, sizes = encoding(path)
    ends = np.cumsum(sizes[np.array(enc.encode_ordinary(text.decode(errors="replace")), np.int64)])
    data = text if text.isascii() else text.decode(errors="replace").encode()
    if data.isascii():
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the character of each byte
    return char[np.concatenate([[0], ends[:-1]]).astype(np.int64)], char[ends - 1] + 1


def lines(text: bytes) -> np.ndarray:
    """Start and end in characters of each line with its line feed; an empty text is one empty line."""
    data = np.frombuffer(text.decode(errors="replace").encode(), np.uint8)
    if not len(data):
        return np.zeros((1, 2), np.int64)
    chars = np.cumsum((data & 0xC0) != 0x80)
    cuts = chars[np.flatnonzero(data == 10)]
    if not len(cuts) or cuts[-1] != chars[-1]:
        cuts = np.append(cuts, chars[-1])
    return np.stack([np.concatenate([[0], cuts[:-1]]), cuts], axis=1).astype(np.int64)


def attribute(first: np.ndarray, last: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether it has characters outside it."""
    if not len(sections) or not len(first):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    start, end = sections[:, 0], sections[:, 1]
    low = np.searchsorted(end, first, "right")  # the first section that ends after the token's start
    high = np.searchsorted(start, last, "left")  # one past the last that starts before its end
    best, most = np.full(len(first), -1), np.zeros(len(first), np.int64)
    for step in range(int((high - low).max(initial=0))):
        live = np.flatnonzero(low + step < high)
        at = low[live] + step
        shared = np.minimum(end[at], last[live]) - np.maximum(start[at], first[live])
        more = shared > most[live]
        best[live[more]], most[live[more]] = at[more], shared[more]
    return best, (best >= 0) & (most < last - first)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None, path: str = RANKS) -> DataFrame:
    """A row for each section of each document, and one for section -1 where some tokens are in none.

    n_tokens: tokens attributed; n_crossing: those of them with characters outside. A null text is an empty one; a null array
    of sections has none; other columns are left out; rows that repeat are counted each for itself.
    """
    own = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")]
    if sections:
        own.append(F.transform(sections, lambda s: F.array(s["start"], s["end"])).cast("array<array<long>>").alias("sections"))

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            docs_of, hashes = [], []
            for i, t in enumerate(p["text"]):
                t = t or b""
                where = np.array(p["sections"][i] or [], np.int64).reshape(-1, 2) if sections else lines(t)
                first, last = spans(t, path) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                at, crossing = attribute(first, last, where)
                n = np.bincount(at + 1, minlength=len(where) + 1)
                across = np.bincount(at[crossing] + 1, minlength=len(where) + 1)
                keep = slice(0 if n[0] else 1, None)
                for column, x in zip(out, (np.arange(-1, len(where)), np.append([-1], where[:, 0]), np.append([-1], where[:, 1]), n, across)):
                    column.append(x[keep])
                many = len(out[0][-1])
                docs_of += [p["doc_id"][i]] * many
                hashes += [p["text_hash"][i]] * many
            columns = [np.concatenate(x) if x else [] for x in out[:5]]
            yield {"doc_id": docs_of, "section": columns[0], "char_start": columns[1], "char_end": columns[2], "n_tokens": columns[3], "n_crossing": columns[4], "text_hash": hashes}

    return map_rows(docs.select(*own), COUNTS, rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
