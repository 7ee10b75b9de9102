"""Best-fit packing of token sequences, with lower bounds that certify each partition's bin count.

Documents are cut only where they are longer than a sequence. Pieces are dealt to partitions of bounded size by a
hash; each is packed best-fit decreasing, and dual feasible functions bound its number of bins from below. Where
bins and bound differ, the emptier bins of that partition are opened; a partition without a gap opens its last
bin only. What lies in opened bins is exchanged: dealt to fewer partitions and packed again, round by round, and a
repacking counts only if it takes fewer bins than those it was opened from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import map_rows, save
from sessionlake.llm.word_encoder import WORD_BPE, encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY, vocabulary: str = WORD_BPE) -> DataFrame:
    """A row for each piece of each document's ids with the id `end` last: doc_id, piece, start, length, ids_crc32.

    A null text is an empty one, of the end id alone; null and repeated keys keep a row each; other columns are left out.
    """

    def cut(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        enc, tail = encoder(vocabulary), np.uint32(end)
        for part in parts:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, ids in zip(part["doc_id"], enc.encode(part["text"])):
                ids = np.append(ids, tail)
                for i, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    for k, v in zip(out, (doc, i, a, len(own), zlib.crc32(own.astype("<u4", copy=False)))):
                        out[k].append(v)
            yield out

    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), PIECES, cut, batch=1024)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}  # bins by what they still take
    some, n = 0, 0  # a bit for each key of free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if rest := some >> size:
            room = size + (rest & -rest).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            free.setdefault(left, []).append(b)
            some |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, steps: int = 12) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity, steps)


def bound_of(count: np.ndarray, capacity: int = CAPACITY, steps: int = 12) -> int:
    """Bins that any packing needs of so many pieces of each length, by dual feasible functions: for every threshold e, sizes over capacity - e count as
    whole bins and sizes under e as nothing; what lies between counts as itself, or rounded down to k-ths for each k to `steps`."""
    count = count.astype(np.int64)
    size, best = np.arange(capacity + 1), 0
    e = np.arange(0, capacity // 2 + 1)
    above = count.sum() - np.cumsum(count)  # of sizes over x
    for k in [0, *range(1, steps + 1)]:
        if k:  # the value of a size is m / k, or size / capacity where that is a whole number of k+1-ths
            exact = size * (k + 1) % capacity == 0
            weight, unit = np.where(exact, size * k, size * (k + 1) // capacity * capacity), capacity * k
        else:
            weight, unit = size, capacity
        total = np.concatenate([[0], np.cumsum(count * weight)])
        most = above[capacity - e] * unit + total[capacity - e + 1] - total[e]
        best = max(best, int(-(-most.max() // unit)))
    return best


def _round(number: int, capacity: int, share: float):
    def pack(own: pd.DataFrame) -> pd.DataFrame:
        lengths = own["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        if not number or bins.max() + 1 < own["sequence_id"].nunique():
            own = own.assign(sequence_id=(number << 52) + (int(own["part"].iloc[0]) << 24) + bins, offset=offsets)
        filled = own.groupby("sequence_id")["length"].sum().sort_values()
        loose = filled.index[filled < capacity]
        bound = lower_bound(lengths, capacity)
        gap = len(filled) - bound
        opened = loose[: max(1, gap and 4 * gap, int(share * len(filled)) if gap else 0)]
        return own.assign(opened=own["sequence_id"].isin(opened), part_bins=len(filled), part_bound=bound)

    return pack


def _deal(todo: DataFrame, number: int, parts: int) -> DataFrame:
    """Adds part. After round 0 an opened sequence goes to one partition as a whole, so that its bins can be compared there."""
    return todo.withColumn("part", F.pmod(F.xxhash64("sequence_id" if number else "item", F.lit(number)), F.lit(parts)))


def pack(items: DataFrame, capacity: int = CAPACITY, part_items: int = 8000, rounds: int = 6, share: float = 0.1) -> DataFrame:
    """Adds sequence_id, offset, part_bins and part_bound to the columns of pieces(): where each piece lies, and how many
    sequences the partition that packed it last took, and must take at least by its bound.

    part_items bounds the pieces of one packing task. Rounds of exchange end when one partition held all that was
    opened, when the bound over all pieces is met, or after `rounds`. An empty table gives an empty result; repeated
    rows are packed each for itself; a piece longer than the capacity is an error.
    """
    spark = items.sparkSession
    schema = f"{PIECES}, item long, sequence_id long, offset long, part long, opened boolean, part_bins long, part_bound long"
    todo = save(items.withColumns({"item": F.monotonically_increasing_id(), "sequence_id": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long"), "part_bins": F.lit(0).cast("long"), "part_bound": F.lit(0).cast("long")}), "pieces")
    histogram = todo.groupBy("length").count().collect()  # one row for each length, capacity of them at most
    if histogram and max(r["length"] for r in histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    count = np.zeros(capacity + 1, np.int64)
    count[[r["length"] for r in histogram]] = [r["count"] for r in histogram]
    bound = bound_of(count, capacity)
    done, number, n = None, 0, sum(r["count"] for r in histogram)
    while True:
        parts = max(1, -(-n // part_items))
        dealt = _deal(todo, number, parts)
        packed = save(dealt.groupBy("part").applyInPandas(_round(number, capacity, share), schema), "packed")
        opened = packed.filter("opened")
        now = packed if done is None else done.unionByName(packed)
        bins = now.filter("offset = 0").count()
        n, number = opened.count(), number + 1
        if parts == 1 or number > rounds or not n or bins <= bound:
            return now.select(*[f.split()[0] for f in PIECES.split(", ")], "sequence_id", "offset", "part_bins", "part_bound")
        closed = packed.filter("not opened")
        done = closed if done is None else done.unionByName(closed)
        todo = opened.drop("part", "opened")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and the fewest that any packing could use by the bound over all pieces."""
    rows = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()
    count = np.zeros(capacity + 1, np.int64)
    count[[r["length"] for r in rows]] = [r["n"] for r in rows]
    return sum(r["first"] for r in rows), bound_of(count, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
