"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are merged together, as one array of bytes: a doubly linked list holds the parts, and a bucket for each
merge rank holds the places where that merge is possible. Three levels of 64-bit words mark the buckets in use, so
find-first-set gives the lowest rank in three steps. An entry is stale when its place has since been merged into a
neighbour or its pair has grown; it is skipped when it is met. Parts never join across pre-tokens, so lowest rank
and leftmost place first gives each pre-token the same merges as alone, and time stays n log n for one of any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import held, map_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: White space other than ASCII's six characters, in UTF-8, and the zero byte that marks cuts.
ODD = re.compile(rb"[\x00\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search


class RankQueue:
    """Places by merge rank: a bucket for each rank in use, under three levels of 64-bit words."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}  # 64 ranks each
        self.groups: dict[int, int] = {}  # 64 words each
        self.top = 0  # a bit for each group

    def open(self, rank: int, place: int) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = [place]
        word, group = rank >> 6, rank >> 12
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 63)
        self.groups[group] = self.groups.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def first(self) -> int:
        """The lowest rank with a bucket, by finding the first bit set on each level; -1 if there is none."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.words[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Takes an empty bucket away."""
        del self.buckets[rank]
        word, group = rank >> 6, rank >> 12
        self.words[word] ^= 1 << (rank & 63)
        if not self.words[word]:
            self.groups[group] ^= 1 << (word & 63)
            if not self.groups[group]:
                self.top ^= 1 << group


class ByteBPE:
    """Encoder and decoder for one file of ranks; keeps the ids of `keep` pre-tokens and segments or so."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: int = 600_000) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split, self.keep, self.known = regex.compile(pattern).findall, keep, {}
        self.segments, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        data, get, queue = b"".join(tokens), self.ranks.get, RankQueue()
        buckets, n = queue.buckets, len(data)
        # The part at i is data[i:after[i]]; rank[i] is that of its pair with the next part, -1 where they can't be merged.
        after, before, rank, begins = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n, bytearray(n + 1)
        at = 0
        for t in tokens:
            begins[at] = 1
            at += len(t)
        begins[n] = 1
        for i in range(n - 1):
            if not begins[i + 1] and (r := get(data[i : i + 2])) is not None:
                rank[i] = r
                if (own := buckets.get(r)) is None:
                    queue.open(r, i)
                else:
                    own.append(i)  # places come in order, so the list stays a heap
        while (now := queue.first()) >= 0:
            bucket = buckets[now]
            while bucket:
                i = heappop(bucket)
                if rank[i] != now:  # stale
                    continue
                j = after[i]
                end = after[i] = after[j]
                rank[i] = rank[j] = -1
                low = now
                if not begins[end]:
                    before[end] = i
                    if (r := get(data[i : after[end]])) is not None:
                        rank[i] = r
                        low = r if r < low else low
                        if (own := buckets.get(r)) is None:
                            queue.open(r, i)
                        else:
                            heappush(own, i)
                if not begins[i]:
                    left = before[i]
                    if (r := get(data[left:end])) is None:
                        rank[left] = -1
                    else:
                        rank[left] = r
                        low = r if r < low else low
                        if (own := buckets.get(r)) is None:
                            queue.open(r, left)
                        else:
                            heappush(own, left)
                if low < now:  # a lower rank comes first
                    break
            if not bucket:
                queue.close(now)
        out, at, ranks = [], 0, self.ranks
        for t in tokens:
            own, end = [], at + len(t)
            while at < end:
                to = after[at]
                own.append(ranks[data[at:to]])
                at = to
            out.append(own)
        return out

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return np.array([i for own in self.of(self.split(text)) for i in own], "<u4")

    def of(self, tokens: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; those that are pieces as a whole, or were met before, aren't merged again."""
        known, get = self.known, self.ranks.get
        if len(known) > self.keep:
            known.clear()
        new = []
        for t in set(tokens) - known.keys():
            rank = get(t.encode())
            if rank is None:
                new.append(t)
            else:
                known[t] = [rank]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            known.update(zip(part, self.merge([t.encode() for t in part])))
        return list(map(known.__getitem__, tokens))

    def learn(self, segments: pa.Array) -> None:
        """Ids of segments not met before."""
        tokens, many = [], []
        for x in segments.to_pylist():
            own = self.split(x)
            tokens += own
            many.append(len(own))
        ids = self.of(tokens)
        sizes = np.add.reduceat(np.append(np.fromiter(map(len, ids), np.int64, len(ids)), 0), np.cumsum(many) - many) * (np.array(many) > 0)
        self.pool = np.concatenate([self.pool, np.fromiter((i for own in ids for i in own), "<u4")])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each UTF-8 text; a null text is empty.

        A pre-token never goes on from other characters into white space, so a text is cut where white space begins, and each
        distinct segment, white space and what follows it, is split and merged once while it is kept. Texts with white space
        other than ASCII's go as a whole.
        """
        odd = [t is not None and ODD(t) is not None for t in texts]
        array = pa.array([b"" if o else t or b"" for t, o in zip(texts, odd)], pa.binary()).cast(pa.string())
        cut = pc.split_pattern(pc.replace_substring_regex(array, r"([^ \t\n\x0b\x0c\r])([ \t\n\x0b\x0c\r])", "\\1\x00\\2"), "\x00")
        if len(self.segments) > 2 * self.keep:
            self.segments, self.pool, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        coded = cut.values.dictionary_encode()
        places = pc.index_in(coded.dictionary, self.segments)
        if places.null_count:
            new = coded.dictionary.filter(places.is_null())
            self.segments = pa.concat_arrays([self.segments, new])
            self.learn(new)
            places = pc.index_in(coded.dictionary, self.segments)
        at = places.to_numpy()[coded.indices.to_numpy()]
        many = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.pool[np.repeat((np.cumsum(self.sizes) - self.sizes)[at] - ends[:-1], many) + np.arange(ends[-1])]
        cuts = ends[cut.offsets.to_numpy()].tolist()
        return [self.whole(t.decode(errors="replace")) if o else ids[a:b] for t, o, a, b in zip(texts, odd, cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str = RANKS) -> ByteBPE:
    """This worker's codec."""
    return held(("byte_bpe", path), lambda: ByteBPE(path))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) for each row of docs; a null text is empty, other columns are left out."""

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            yield {"doc_id": p["doc_id"], "ids": [x.tobytes() for x in codec(path).encode(p["text"])]}

    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, ids binary", rows)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids; null ids give empty data, an unknown id is an error."""

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            yield {"doc_id": p["doc_id"], "data": [codec(path).decode(x or b"") for x in p["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, data binary", rows)


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Encodes, decodes the ids, and digests both in the task that made them."""

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        bpe = codec(path)
        for p in parts:
            ids = [x.tobytes() for x in bpe.encode(p["text"])]
            yield {"doc_id": p["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, batch=1024)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
