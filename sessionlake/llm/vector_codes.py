"""Compression of vectors to codes of their parts, with codebooks fitted by active-entry Lloyd steps.

Vectors are cut into equal parts, and each part position has a codebook. A step assigns every part to the nearest entry of
its codebook, then moves each entry to the mean of its parts. The exact distance to the assigned entry is kept with
the code. In the next step a part whose entry stayed where it was needs to be compared only with the entries
that moved: against the others its stored distance is still the least. Parts whose entry moved are compared with all entries.
Where distances are equal the entry of lower index wins, also against a stored one, so the codes are those of plain Lloyd steps.

Codebooks are small, parts times entries, and go to the tasks with the function; sums and counts are added up in each task
first, then by part and entry. Each state is a written table, and the one before it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sessionlake.llm.common import drop, save
from sessionlake.llm.integer_vectors import VECTORS_SQL, integers, named
from sessionlake.llm.quality import met

TILE = 2048  # rows compared at once


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, as integers."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += np.square(x[:, i, None] - entries[None, :, i])
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest entry, the lowest index of equal ones."""
    far = distances(x, entries)
    code = far.argmin(1)
    return code, far[np.arange(len(x)), code]


def reassigned(x: np.ndarray, code: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes and distances of the parts x at one position, and how many distances were computed; moved: for each entry, whether it did."""
    if not moved.any():
        return code, far, 0
    code, far, again = code.copy(), far.copy(), moved[code]
    code[again], far[again] = nearest(x[again], entries)
    active, still = np.flatnonzero(moved), np.flatnonzero(~again)
    best, d = nearest(x[still], entries[active])
    best = active[best]
    better = (d < far[still]) | (d == far[still]) & (best < code[still])
    code[still[better]], far[still[better]] = best[better], d[better]
    return code, far, int(again.sum()) * len(entries) + len(still) * len(active)


def assigned(state: DataFrame, books: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """state with code and far (a value for each part) for these codebooks; before: those that the codes in state are for."""
    kept = state.select("vec_id", "label", "x")
    kinds = kept.withColumns({"code": F.lit(None).cast("array<int>"), "far": F.lit(None).cast("array<bigint>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                p = whole.slice(at, TILE)
                x = cut(p, "x", books.shape)
                if before is None:
                    found = [nearest(x[:, i], own) for i, own in enumerate(books)]
                else:
                    code, far = (listed(p, c).reshape(len(x), -1) for c in ("code", "far"))
                    found = [reassigned(x[:, i], code[:, i], far[:, i], own, (own != before[i]).any(1))[:2] for i, own in enumerate(books)]
                ends = np.arange(len(x) + 1, dtype=np.int32) * len(books)
                new = [pa.ListArray.from_arrays(ends, np.stack([f[n] for f in found], 1).ravel().astype(kind)) for n, kind in enumerate((np.int32, np.int64))]
                yield pa.RecordBatch.from_arrays([p.column(c) for c in ("vec_id", "label", "x")] + new, names=kinds.names)

    return (kept if before is None else state).mapInArrow(run, kinds)


def listed(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """All values of a column of arrays, one after the other."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def cut(batch: pa.RecordBatch, column: str, shape: tuple[int, ...]) -> np.ndarray:
    """Integer vectors by row, part and place."""
    return listed(batch, column).astype(np.int64).reshape(batch.num_rows, shape[0], shape[2])


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for p in batches:
            x, code = cut(p, "x", books.shape), listed(p, "code").reshape(p.num_rows, parts)
            for i in range(parts):
                n[i] += np.bincount(code[:, i], minlength=entries)
                np.add.at(sums[i], code[:, i], x[:, i])
        at, entry = np.nonzero(n)
        own = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * width, sums[at, entry].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[at, entry]), own], names=["part", "entry", "n", "sums"])

    found = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in totals.collect():  # a row for each entry at most
        out[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """A written table of vec_id, label, x (the integer vector), code and far (entry and squared distance of each part), and the codebooks (parts, entries, width).

    Codebooks start as the parts of the `entries` smallest keys (nulls last; of equal keys the smallest vectors), fewer where there are fewer rows.
    Vectors that integers() leaves out have no row; rows with null or repeated keys and labels keep one each. An empty table gives an empty
    one and codebooks without entries. Most vectors' length must be a multiple of `parts`, else it is a ValueError.
    """
    state = save(integers(vectors, key, vector, label), "vectors")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x", named("label")).limit(entries).collect()
    size = len(first[0]["x"]) if first else 0
    if size % parts:
        raise ValueError(f"vectors of length {size} have no {parts} equal parts")
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    before = None
    for number in range(rounds + 1):
        now = save(assigned(state, books, before), "codes")
        drop(state)
        state = now
        if number < rounds:
            before, books = books, moved_entries(state, books)
    return state, books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors."""
    state, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = state.select("vec_id", code.alias("code"), F.aggregate("far", F.lit(0).cast(LongType()), lambda a, d: a + d).alias("error"), named("label").alias("_label"))
    of_label = save(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "errors")
    return met(coded, of_label, ["_label"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 2) -> str:
    """Plain Lloyd steps; the least of 64 * distance + entry is the nearest entry of lowest index."""
    far = " + ".join(f"(p.{c} - e.{c}) * (p.{c} - e.{c})" for c in "abcd")
    out = [
        f"v AS ({VECTORS_SQL})",
        "p AS (SELECT vec_id, label, g AS part, x[4 * g + 1] AS a, x[4 * g + 2] AS b, x[4 * g + 3] AS c, x[4 * g + 4] AS d FROM v, range(16) t(g))",
        "e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, a, b, c, d FROM p QUALIFY entry < 64)",
    ]
    for i in range(rounds + 1):
        out.append(f"n{i} AS (SELECT vec_id, part, any_value(p.label) AS label, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.c) AS c, any_value(p.d) AS d, min(({far}) * 64 + e.entry) AS best FROM p JOIN e{i} e USING (part) GROUP BY vec_id, part)")
        if i < rounds:
            mean = ", ".join(f"coalesce(floor(m.{c} / m.n)::BIGINT, e.{c}) AS {c}" for c in "abcd")
            out.append(f"m{i} AS (SELECT part, best % 64 AS entry, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM n{i} GROUP BY ALL)")
            out.append(f"e{i + 1} AS (SELECT part, entry, {mean} FROM e{i} e LEFT JOIN m{i} m USING (part, entry))")
    last = rounds
    out.append(f"h AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{last})")
    out.append(f"c AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM n{last} GROUP BY vec_id, label)")
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"


SQL = _sql()
