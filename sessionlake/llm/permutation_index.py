"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by its nearest pivots in order, and posted in
the inverted files of the first few of them. A query reads the files of its own nearest pivots. In each it ranks what is posted
by the induced footrule distance, the sum over the query's pivots of how far apart both places are, or the length of
the list where the other vector has no place for the pivot, and ranks the best of these again by the true distance.

Vectors are copied once for each posting, queries once for each file they read. A file of many vectors, such as that of a pivot
with many copies near it, is kept in blocks, and its queries come in blocks too, so no task holds a whole file. How much
of the table a query reads follows the data: where vectors lie almost evenly on a sphere, near ones share few of their first
pivots, so a recall of 0.9 takes more than half of the table; where they lie in clusters, far less does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import save


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and embedding (double) of vectors that take part: no null, zero or non-finite ones, and a key."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("embedding")).filter(fine & F.col("vec_id").isNotNull())


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The `prefix` nearest pivots of each row, nearest first."""
    far = np.square(pivots).sum(1) - 2 * x @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def posted(rows: DataFrame, pivots: np.ndarray, prefix: int, files: int) -> DataFrame:
    """A row for each vector and each of its `files` nearest pivots: pivot, vec_id, embedding, and the order of its pivots."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 1024):
                own = p.iloc[at : at + 1024]
                order = nearest_pivots(np.stack(own["embedding"]), pivots, max(prefix, files))
                codes = [x.tobytes() for x in order[:, :prefix].astype("<u2")]
                for i in range(min(files, order.shape[1])):
                    yield pd.DataFrame({"pivot": order[:, i], "vec_id": own["vec_id"], "embedding": own["embedding"], "places": codes})

    return rows.mapInPandas(run, "pivot int, vec_id long, embedding array<double>, places binary")


def ranked(keys: np.ndarray, x: np.ndarray, places: np.ndarray, key: int, q: np.ndarray, order: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the `candidates` best by footrule of one file: keys and distances. The query's own row is left out.

    places: a row for each vector, the place of each pivot in its order, or the length of the order.
    """
    footrule = np.abs(places[:, order] - np.arange(len(order), dtype=np.int16)).sum(1, dtype=np.int32)
    own = keys != key
    if own.sum() > candidates:
        edge = np.partition(footrule[own], candidates - 1)[candidates - 1]
        own &= footrule <= edge  # ties at the edge come along
    best = np.flatnonzero(own)
    far = np.sqrt(np.square(x[best] - q).sum(1))
    first = np.lexsort((keys[best], far))[:k]
    return keys[best][first], far[first]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", pivots: int = 256, prefix: int = 128, files: int = 3, reads: float = 0.3, share: float = 0.4, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest found of each row of queries, by Euclidean distance.

    files: how many inverted files a vector is posted in; reads: the part of all files that a query reads; share: the part of
    a file's block that is ranked again, 2 k rows at least. A query whose files hold fewer than k vectors reads all files. Rows with a key in common count as the query's own; ties go to the
    smaller key. Vectors of another length than most take no part. An empty index or no query gives no rows.
    """
    spark = vectors.sparkSession
    every = usable(vectors, key, vector)
    size = every.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not size:
        return spark.createDataFrame([], RESULT)
    same = F.size("embedding") == size["size"]
    rows = save(every.filter(same), "vectors")
    sample, seen = [], set()
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect():  # copies are one pivot
        if tuple(r["embedding"]) not in seen and len(sample) < pivots:
            seen.add(tuple(r["embedding"]))
            sample.append(r["embedding"])
    chosen = np.array(sample)
    prefix = min(prefix, len(chosen))
    index = save(posted(rows, chosen, prefix, files), "postings")
    asking = save(usable(queries, key, vector).filter(same), "queries")
    first = save(_nearest(index, posted(asking, chosen, prefix, max(1, round(reads * len(chosen)))), chosen, prefix, k, share, block, query_block), "found")
    found = asking.select(F.col("vec_id").alias("query_id")).distinct().join(first.groupBy("query_id").count(), "query_id", "left").fillna(0)
    short = save(found.filter(F.col("count") < F.least(F.lit(k), F.lit(rows.count() - 1))).select(F.col("query_id").alias("vec_id")), "short")
    if not short.limit(1).count():
        return first
    again = _nearest(index, posted(asking.join(short, "vec_id", "left_semi"), chosen, prefix, len(chosen)), chosen, prefix, k, 1.0, block, query_block)
    return first.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(again)


def _nearest(index: DataFrame, asking: DataFrame, chosen: np.ndarray, prefix: int, k: int, share: float, block: int, query_block: int) -> DataFrame:
    """RESULT of posted vectors and posted queries that meet in files."""
    asked = save(asking, "asked")
    # Blocks of each file and of its queries; a row a pivot.
    count = lambda df, size, name: df.groupBy("pivot").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(count(index, block, "blocks").join(count(asked, query_block, "query_blocks"), "pivot"))
    left = index.join(sizes, "pivot").withColumns({"b": F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))})
    right = asked.join(sizes, "pivot").withColumns({"q": F.pmod(F.xxhash64("vec_id"), "query_blocks").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})

    def meet(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(ask):
            keys, x = own["vec_id"].to_numpy(), np.stack(own["embedding"])
            places = np.full((len(own), len(chosen)), prefix, np.int16)
            places[np.arange(len(own))[:, None], np.frombuffer(b"".join(own["places"]), "<u2").reshape(len(own), -1)] = np.arange(prefix)
            most = max(2 * k, math.ceil(share * len(x)))
            for key_, q, order in zip(ask["vec_id"], ask["embedding"], ask["places"]):
                found, far = ranked(keys, x, places, key_, np.asarray(q), np.frombuffer(order, "<u2"), k, most)
                out["query_id"].append(np.full(len(found), key_))
                out["vec_id"].append(found)
                out["score"].append(far)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    by = ["pivot", "b", "q"]
    found = left.select(*by, "vec_id", "embedding", "places").groupBy(*by).cogroup(right.select(*by, "vec_id", "embedding", "places").groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score double"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
