"""Vectors: cosine similarity, nearest chunks and sessions of a table of queries, and filling in embeddings that lack."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.search import RankParams, top


NEAR = 1e-9  # how far a matrix product may be off


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has length 0, never NaN. One root is taken of both squares, so vectors of small whole numbers that point alike tie; two where that is out of range."""
    squares = dot(a, a) * dot(b, b)
    return F.try_divide(dot(a, b), F.when((squares > 0) & (squares < float("inf")), F.sqrt(squares)).otherwise(norm(a) * norm(b)))


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """dot() of the rows of two matrices: added from left to right, so a pair's value doesn't hang on the rows beside it, as that of a matrix product may."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """cosine() of the rows of two matrices, none of length 0."""
    a, b = summed(x, x), summed(y, y)
    squares = a * b
    return summed(x, y) / np.where((squares > 0) & (squares < np.inf), np.sqrt(squares), np.sqrt(a) * np.sqrt(b))


def similar_chunks(chunks: DataFrame, queries: DataFrame, floor: float, block: int = 8192, query_block: int = 2048, most: int | None = None) -> DataFrame:
    """qid, session_id, chunk_index, sim for chunks whose similarity reaches the floor.

    chunks: session_id, chunk_index, embedding; queries: qid, embedding. Both are dealt to blocks of about `block` and
    `query_block` rows by a hash; each pair of blocks meets in a task of its own as matrix products, so no side is ever whole
    in a task or on the driver. Pairs at the floor or over it get cosine() itself, so equal vectors tie wherever they were dealt to. Null and zero vectors, those with a component that is null or not finite, and those of another length than the
    query's match nothing. With `most`, a meeting of blocks gives no more than each query's `most` best sessions in it, with one chunk each: whatever
    best_chunks() to that limit takes of all pairs is among them, as a session that is among the best of all is among those of the block of its best chunk.
    """
    kinds = dict(chunks.dtypes) | {"qid": dict(queries.dtypes)["qid"]}
    own, asked = (df.filter(F.col("embedding").isNotNull()) for df in (chunks.select("session_id", "chunk_index", "embedding"), queries.select("qid", "embedding")))
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((own, block), (asked, query_block)))
    deal = lambda by, n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")  # of one type with every(): a cogroup deals out keys of two types by two hashes, and blocks wouldn't meet
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumns({"row": deal(["session_id", "chunk_index"], blocks), "column": every(query_blocks)})
    right = asked.withColumns({"column": deal(["qid"], query_blocks), "row": every(blocks)})

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["qid", "session_id", "sim", "chunk_index"], ascending=[True, True, False, True]).drop_duplicates(["qid", "session_id"])
        found = found.sort_values(["qid", "sim", "session_id"], ascending=[True, False, True], na_position="first")
        return found[found.groupby("qid", dropna=False).cumcount() < most]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({k: np.empty(0, object) for k in ("qid", "session_id", "chunk_index", "sim")})]
        of_a, of_b = a["embedding"].map(len), b["embedding"].map(len)
        for width in sorted(set(of_a) & set(of_b)):
            fit, asks = a[of_a == width], b[of_b == width]
            q = np.stack(asks["embedding"]).astype(np.float64)
            size = np.linalg.norm(q, axis=1)
            ids, given, q = asks["qid"].to_numpy()[size > 0], q[size > 0], q[size > 0] / size[size > 0][:, None]
            for at in range(0, len(fit), 512):
                some = fit.iloc[at : at + 512]
                x = np.stack(some["embedding"]).astype(np.float64)
                n = np.linalg.norm(x, axis=1)
                with np.errstate(invalid="ignore"):
                    sim = np.where(n[:, None] > 0, x @ q.T / np.where(n > 0, n, 1)[:, None], -np.inf)
                rows, columns = np.nonzero(sim >= floor - NEAR)
                for start in range(0, len(rows), 65_536):
                    row, column = rows[start : start + 65_536], columns[start : start + 65_536]
                    exact = cosines(x[row], given[column])
                    row, column, exact = row[exact >= floor], column[exact >= floor], exact[exact >= floor]
                    out.append(pd.DataFrame({"qid": ids[column], "session_id": some["session_id"].to_numpy()[row], "chunk_index": some["chunk_index"].to_numpy()[row], "sim": exact}))
                if most is not None and len(out) > 2:
                    out = [out[0], best(pd.concat(out[1:]))]
        found = pd.concat(out[1:]) if len(out) > 1 else out[0]
        return best(found) if most is not None and len(found) else found

    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(meet, f"qid {kinds['qid']}, session_id {kinds['session_id']}, chunk_index {kinds['chunk_index']}, sim double")


def similar_candidates(chunks: DataFrame, queries: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """similar_chunks() for queries that may see some sessions only (qid, session_id): no other similarity is computed."""
    pairs = candidates.select("qid", "session_id").distinct().join(chunks.select("session_id", "chunk_index", F.col("embedding").alias("own")), "session_id").join(queries.select("qid", "embedding"), "qid")
    return pairs.select("qid", "session_id", "chunk_index", cosine(F.col("own"), F.col("embedding")).alias("sim")).filter(F.col("sim") >= floor)


def best_chunks(similar: DataFrame, limit: int | None) -> DataFrame:
    """qid, session_id, chunk_index, score, rank: each session's best chunk (the first on a tie), the best sessions of each query."""
    best = similar.groupBy("qid", "session_id").agg(F.max_by("chunk_index", F.struct("sim", -F.col("chunk_index"))).alias("chunk_index"), F.max("sim").alias("score"))
    return top(best, limit, F.desc("score"), F.asc("session_id"))


def vector_search(chunks: DataFrame, queries: DataFrame, params: RankParams = RankParams(), candidates: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """Best sessions of each query. candidates (qid, session_id) and restricted (qid; None: all queries) as in search.permitted()."""
    floor, most = params.similarity_floor, params.limit * params.over_fetch
    if candidates is None:
        found = similar_chunks(chunks, queries, floor, most=most)
    elif restricted is None:
        found = similar_candidates(chunks, queries, candidates, floor)
    else:
        found = similar_chunks(chunks, queries.join(restricted, "qid", "left_anti"), floor, most=most).unionByName(similar_candidates(chunks, queries.join(restricted, "qid", "left_semi"), candidates, floor))
    return best_chunks(found, most)


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that needs no model: words hashed to signed places, length 1. For tests."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % width] += 1 if h & 1 << 20 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return embed


LETTERS = ["a", "e", "i", "n", "t", " "]


def letter_embedder(texts: list[str]) -> list[list[float]]:
    """Counts of a few letters: an embedder that SQL can repeat. For tests."""
    return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


def batches(sizes: list[int], most: int, count: int) -> Iterator[slice]:
    """Slices of at most `count` items and `most` tokens together; an item over that stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= count):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def backfill(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, tokens: int = 250_000, count: int = 100, cut: int = 24_000) -> DataFrame:
    """chunks with embeddings where they were null; a batch that fails stays null. chunks: session_id, chunk_index, content, embedding, embedding_model."""
    kinds = dict(chunks.dtypes)
    lacking = chunks.filter(F.col("embedding").isNull() & F.col("content").isNotNull())

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, found = [t[:cut] for t in p["content"]], []
            for s in batches([len(t) // 4 for t in texts], tokens, count):
                try:
                    found += embed(texts[s])
                except Exception:  # the user's function, for instance a service that is down
                    found += [None] * len(texts[s])
            yield pd.DataFrame({"session_id": p["session_id"], "chunk_index": p["chunk_index"], "fresh": found})

    fresh = lacking.select("session_id", "chunk_index", "content").mapInPandas(fill, f"session_id {kinds['session_id']}, chunk_index {kinds['chunk_index']}, fresh array<float>")
    joined = chunks.join(fresh, ["session_id", "chunk_index"], "left")
    return joined.withColumns({"embedding_model": F.when(F.col("fresh").isNotNull(), model).otherwise(F.col("embedding_model")), "embedding": F.coalesce("embedding", "fresh")}).select(*chunks.columns)
