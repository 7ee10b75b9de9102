"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Documents are encoded, and what fills whole sequences is cut off their front. The rests are dealt to groups of bounded size
by a hash of their place in the table. Each group is packed by itself: longest first, each into the first bin that still takes it,
which a tournament tree over what the bins still take finds in as many steps as the tree is high. No group waits for another.

Padding is what a sequence lacks, unless its length is a power of two, and documents may be cut. So a group keeps its fullest
bins, as many as its tokens fill, and takes the others apart: what lay in them fills the gaps of the bins kept, and the last
tokens become sequences whose lengths are powers of two. Then no sequence has padding, and few documents but those of loose bins are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.byte_encoder import BYTE_BPE, RANKS, encoder
from sessionlake.llm.common import map_rows

CAPACITY = 2048
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each into the first bin that takes it.

    tree[1] is the root, leaves are what each bin still takes, and a node is the larger of its two children.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def filled(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, from, to, bin, offset) of each piece: items packed first-fit decreasing, then the loose bins taken apart.

    Bins are full, but for the last ones, whose lengths are powers of two.
    """
    bins, offsets = first_fit_decreasing(lengths, capacity)
    load = np.bincount(bins, lengths).astype(np.int64)
    full, rest = divmod(int(lengths.sum()), capacity)
    order = np.argsort(-load, kind="stable")
    kept = np.zeros(len(load), bool)
    kept[order[:full]] = True
    out = [(i, 0, int(lengths[i]), int(bins[i]), int(offsets[i])) for i in np.flatnonzero(kept[bins]).tolist()]
    holes = [(capacity - int(load[b]), b, int(load[b])) for b in order[:full].tolist() if load[b] < capacity]
    holes = sorted(holes, reverse=True) + [(p, len(load) + j, 0) for j, p in enumerate(powers(rest))]
    loose = [i for i in np.argsort(-lengths, kind="stable").tolist() if not kept[bins[i]]]
    at = 0  # of the item that is being laid out
    for room, b, offset in holes:
        while room:
            i = loose[0]
            some = min(room, int(lengths[i]) - at)
            out.append((i, at, at + some, b, offset))
            room, offset, at = room - some, offset + some, at + some
            if at == lengths[i]:
                loose.pop(0)
                at = 0
    return out


def encoded(docs: DataFrame, groups: int, key: str, text: str, end: int, capacity: int, vocabulary: str, ranks: str) -> DataFrame:
    """Whole sequences of documents, without their ids, and rests with them: doc_id, start, length, ids_crc32, doc_tokens, ids, grp."""

    def cut(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        enc, tail = encoder(vocabulary, ranks), np.uint32(end)
        names = ("doc_id", "place", "start", "length", "ids_crc32", "doc_tokens", "ids")
        for part in parts:
            out: dict[str, list] = {n: [] for n in names}
            for doc, place, ids in zip(part["doc_id"], part["place"], enc.encode(part["text"])):
                ids = np.append(ids, tail).astype("<u4", copy=False)
                for a in range(0, len(ids), capacity):
                    own = ids[a : a + capacity]
                    for n, v in zip(names, (doc, place, a, len(own), zlib.crc32(own), len(ids), None if len(own) == capacity else small(own))):
                        out[n].append(v)
            yield out

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col(text).alias("text"))
    rows = map_rows(own, "doc_id long, place long, start long, length long, ids_crc32 long, doc_tokens long, ids binary", cut, batch=4096)
    return rows.withColumn("grp", F.pmod(F.xxhash64("place", "start"), F.lit(groups))).drop("place")


def small(ids: np.ndarray) -> bytes:
    """Ids as bytes, two for each where they are below 65,536; then a byte that says how many."""
    unit = 2 if ids.max(initial=0) < 1 << 16 else 4
    return ids.astype(f"<u{unit}").tobytes() + bytes([unit])


def large(data: bytes) -> np.ndarray:
    """The ids that small() wrote."""
    return np.frombuffer(data[:-1], f"<u{data[-1]}").astype("<u4")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY, group: int = 2000, vocabulary: str = BYTE_BPE, ranks: str = RANKS) -> DataFrame:
    """RESULT: a row for each piece of each document's ids with the id `end` last; start: the document's ids before it; offset: place in its sequence.

    group: about how many documents' rests one task packs. A null text is an empty one, of the end id alone; null and repeated keys keep a row each and
    repeated rows are dealt apart; other columns are left out; an empty table gives no rows. docs is to be read from files: groups go by
    the places of rows in them. ranks: the vocabulary again, in the tiktoken library's form.
    """
    groups = max(1, -(-docs.count() // group))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def lay(own: pa.Table) -> pa.Table:
        base, whole = own["grp"][0].as_py() << 32, own["ids"].is_null()
        done, rest = own.filter(whole), own.filter(pc.invert(whole))
        item, a, b, sequence, offset = np.array(filled(rest["length"].to_numpy(), capacity), np.int64).reshape(-1, 5).T
        pieces = rest.take(pa.array(item))
        crc = pieces["ids_crc32"].to_numpy().copy()
        for i in np.flatnonzero(b - a < pieces["length"].to_numpy()).tolist():
            crc[i] = zlib.crc32(large(pieces["ids"][i].as_py())[a[i] : b[i]])
        first = np.zeros(done.num_rows, np.int64)
        columns = [
            (done["start"], pieces["start"].to_numpy() + a), (done["length"], b - a), (done["ids_crc32"], crc), (done["doc_tokens"], pieces["doc_tokens"]),
            (base + (1 << 31) + np.arange(done.num_rows), base + sequence), (first, offset),
        ]
        keys = pa.concat_tables([done.select(["doc_id"]), pieces.select(["doc_id"])])["doc_id"]
        return pa.table([keys, *[np.concatenate([np.asarray(x), np.asarray(y)]) for x, y in columns]], names=names)

    return encoded(docs, groups, key, text, end, capacity, vocabulary, ranks).groupBy("grp").applyInArrow(lay, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
