"""Length-delimited binary records of token ids, with an offset index beside each shard.

A shard holds records in key order. One record is

    length      8 bytes, little-endian
    checksum    4 bytes, masked CRC-32C of the length
    payload     key (8 bytes, signed), flags (1 byte: 1 key is null, 2 ids take 32 bits, else 16), ids
    checksum    4 bytes, masked CRC-32C of the payload

and the index beside it one entry of 24 bytes a record: key, offset of the record, ids in it. A shard is written
under a new name by each attempt of its task; the manifest names those that count, so a lost executor or a task
that ran twice leaves no wrong data. Shards and index go through pyarrow.fs into the folder given.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import map_rows, save, scratch
from sessionlake.llm.word_encoder import WORD_BPE, encoder

BLOCK = 512
#: Characters of a text by which rows of one key are dealt.
FRONT = 64
HEAD, ENTRY = struct.Struct("<QI"), np.dtype([("key", "<i8"), ("offset", "<i8"), ("n", "<i8")])
MANIFEST = "shard long, file string, records long, tokens long, bytes long"


def _advance(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each byte value at each place of a block, and of each register byte a block later. 0x82F63B78: the reversed Castagnoli polynomial."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0x82F63B78), one >> 1).astype(np.uint32)
    at = np.empty((BLOCK, 256), np.uint32)
    at[-1] = one
    for i in range(BLOCK - 2, -1, -1):
        at[i] = at[i + 1] >> 8 ^ one[at[i + 1] & 255]
    return at.ravel(), np.stack([at[i] for i in range(4)])  # the register's low byte goes in with the first byte of the next block


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def masked_crc32c(messages: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each message of 4 bytes at least, for all of them at once by blocks."""
    if not _TABLES:
        _TABLES.append(_tables())
    at, later = _TABLES[0]
    sizes = np.array([len(m) for m in messages])
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks * BLOCK)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for m, n, e in zip(messages, sizes, ends):  # zeros in front leave the register at zero
        flat[e - n : e] = np.frombuffer(m, np.uint8)
        flat[e - n : e - n + 4] ^= 255
    place = np.arange(BLOCK, dtype=np.intp) << 8
    own = np.concatenate([np.bitwise_xor.reduce(at[part + place], axis=1) for part in np.array_split(flat.reshape(-1, BLOCK), max(1, len(flat) // (BLOCK * 2048)))]) if len(flat) else np.zeros(0, np.uint32)
    crc, first = np.zeros(len(messages), np.uint32), (ends // BLOCK) - blocks
    for i in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > i)
        crc[live] = _advance(later, crc[live]) ^ own[first[live] + i]
    crc = ~crc
    return ((crc >> 15 | crc << 17).astype(np.uint64) + 0xA282EAD8).astype(np.uint32)


def frame(keys: list[int | None], ids: list[np.ndarray]) -> list[bytes]:
    """One record for each key and its ids."""
    payloads = []
    for key, x in zip(keys, ids):
        wide = bool(len(x)) and int(x.max()) > 65535
        payloads.append(struct.pack("<qB", key or 0, (key is None) + 2 * wide) + x.astype("<u4" if wide else "<u2").tobytes())
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return [n + struct.pack("<I", a) + p + struct.pack("<I", b) for n, a, p, b in zip(lengths, masked_crc32c(lengths), payloads, masked_crc32c(payloads))]


def unframe(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """Keys and ids of the records in data. Raises ValueError for a checksum that doesn't match or a record cut short."""
    at, lengths, sums, payloads = 0, [], [], []
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError("a record is cut short")
        n, check = HEAD.unpack_from(data, at)
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or n < 9 or len(data) < at + 16 + n:
            raise ValueError("a record is cut short")
        lengths.append(data[at : at + 8])
        payloads.append(payload)
        sums.append((check, *struct.unpack_from("<I", data, at + 12 + n)))
        at += 16 + n
    if sums and not (np.array(sums, np.uint32).T == np.stack([masked_crc32c(lengths), masked_crc32c(payloads)])).all():
        raise ValueError("a checksum doesn't match")
    return [(None if p[8] & 1 else struct.unpack_from("<q", p)[0], np.frombuffer(p, "<u4" if p[8] & 2 else "<u2", offset=9)) for p in payloads]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", end: int = 2, vocabulary: str = WORD_BPE, shards: int | None = None) -> DataFrame:
    """Encodes each whole text, appends the id `end`, and writes records in ascending key order. Returns the manifest, a row a shard.

    Other columns are left out, whatever their names. A null text is an empty one; a null key comes first; rows with
    the same key are ordered by their text, and rows that repeat are all written. An empty table gives no shard.
    Rows are dealt by ranges of key and the text's first characters, so that rows without a key, or with one that many have, are not one
    shard's (but rows that repeat as a whole are); one shard for each input split unless `shards` says otherwise.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def shard(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        number, enc, tail = TaskContext.get().partitionId(), encoder(vocabulary), np.uint32(end)
        name = f"shard-{number:06d}-{uuid.uuid4().hex[:8]}"
        fs = sink = None
        at, total, index = 0, 0, []
        for part in parts:
            if sink is None:
                fs, folder = _open(out)
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(f"{folder}/{name}.rec")
            ids = [np.append(x, tail) for x in enc.encode(part["text"])]
            records = frame(part["key"], ids)
            entries = np.zeros(len(ids), ENTRY)
            entries["key"], entries["n"] = [k or 0 for k in part["key"]], [len(x) for x in ids]
            sizes = np.array([len(r) for r in records])
            entries["offset"] = at + np.cumsum(sizes) - sizes
            index.append(entries.tobytes())
            at, total = at + int(sizes.sum()), total + int(entries["n"].sum())
            sink.write(b"".join(records))
        if sink is not None:
            sink.close()
            with fs.open_output_stream(f"{folder}/{name}.idx") as f:
                f.write(b"".join(index))
            yield {"shard": [number], "file": [f"{out}/{name}"], "records": [sum(map(len, index)) // ENTRY.itemsize], "tokens": [total], "bytes": [at]}

    n = shards or max(1, rows.rdd.getNumPartitions())
    return save(map_rows(rows.repartitionByRange(n, "key", F.substring("text", 1, FRONT)).sortWithinPartitions("key", "text"), MANIFEST, shard, batch=1024), "manifest")


def read(manifest: DataFrame, batch: int = 4 << 20) -> DataFrame:
    """Every record of the shards in key order: key, start (ids of all records before it), n_tokens, ids_crc32, ids (32-bit, little-endian).

    Checks every checksum, and each record's place and size against the index. Shards before a shard are summed over
    the manifest, which has a row a shard.
    """
    before = manifest.select("shard", "file", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def records(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for part in parts:
            for file, start in zip(part["file"], part["before"]):
                fs, path = _open(file)
                with fs.open_input_file(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with fs.open_input_file(f"{path}.rec") as f:
                    size = f.size()
                    cuts = [0, *np.flatnonzero(np.diff(index["offset"] // batch)) + 1, len(index)]
                    for i, j in zip(cuts, cuts[1:]):
                        a, b = int(index["offset"][i]), int(index["offset"][j]) if j < len(index) else size
                        f.seek(a)
                        found = unframe(f.read(b - a))
                        if [k or 0 for k, _ in found] != index["key"][i:j].tolist() or [len(x) for _, x in found] != index["n"][i:j].tolist():
                            raise ValueError(f"{file}: records and index differ")
                        starts = start + np.cumsum(index["n"][i:j]) - index["n"][i:j]
                        start += int(index["n"][i:j].sum())
                        data = [x.astype("<u4").tobytes() for _, x in found]
                        yield {"key": [k for k, _ in found], "start": starts, "n_tokens": index["n"][i:j], "ids_crc32": [zlib.crc32(x) for x in data], "ids": data}

    return map_rows(before.repartition(max(1, manifest.count())), "key long, start long, n_tokens long, ids_crc32 long, ids binary", records)


def fetch(file: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard by position, in any order: the shuffled read that the index is for."""
    fs, path = _open(file)
    with fs.open_input_file(f"{path}.idx") as f:
        index = np.frombuffer(f.read(), ENTRY)
    with fs.open_input_file(f"{path}.rec") as f:
        size, out = f.size(), []
        for i in positions:
            f.seek(int(index["offset"][i]))
            out += unframe(f.read(int(index["offset"][i + 1] if i + 1 < len(index) else size) - int(index["offset"][i])))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as records and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = read(write(docs, scratch(spark, "records")))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
