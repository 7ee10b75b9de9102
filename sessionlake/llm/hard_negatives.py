"""Hard negatives by slots: for each anchor and each of its positives, the best rows of other labels in a window of scores.

The windows of an anchor's positives overlap: each reaches from a share of its positive's score up to a larger share.
Their upper limits, in descending order, cut the scores into disjoint slots, and a window is the slots from its own on
down to its lower limit. So the first k of each slot are enough for all windows: those of a window are the first k of
its slots one after the other, and what lies under the lower limit is cut off their end. Suffixes of slots are merged
from the lowest up, each from the one under it.

Anchors meet rows in blocks of bounded size, dealt by a hash of the row and not of its key, label or vector. Each meeting
keeps the first k of each slot of each anchor, as does Spark on each side of the shuffle that merges meetings, so what
leaves a task does not depend on how many rows a window holds. The work is that of all anchors against all rows, twice:
for positives, then for negatives, whose windows need the positives' scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import save
from sessionlake.llm.integer_vectors import VECTORS_SQL, integers

NONE = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b, exact: in floating point where all sums are whole numbers there."""
    most = int(abs(a).max(initial=0)) * int(abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def first_of_rows(scores: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row among those taken; of equal scores the first columns."""
    masked = np.where(taken, scores, NONE)
    if masked.shape[1] > k:
        edge = np.partition(masked, -k, axis=1)[:, -k]
        taken = taken & (scores >= edge[:, None])  # with all ties at the edge
    at, col = np.nonzero(taken)
    order = np.lexsort((col, -scores[at, col], at))
    at, col = at[order], col[order]
    within = np.arange(len(at)) - np.searchsorted(at, at)
    return at[within < k], col[within < k]


def _meet(rows: DataFrame, anchors: DataFrame, block: int, anchor_block: int, find, schema: str) -> DataFrame:
    """find(own, ask) for each block of rows with each block of anchors; both are written tables with a column row."""
    blocks, anchor_blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, block), (anchors, anchor_block)))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"b": part(blocks), "q": every(anchor_blocks)})
    right = anchors.withColumns({"q": part(anchor_blocks), "b": every(blocks)})

    def meet(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})
        return find(own.sort_values(["vec_id", "row"]), ask)

    return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(meet, schema)


def _scores(own: pd.DataFrame, ask: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, whether labels are equal, and whether keys differ, of each anchor with each row."""
    pick = lambda c: (ask[c].to_numpy()[:, None], own[c].to_numpy()[None])
    (a, b), (c, d) = pick("label_id"), pick("vec_id")
    return products(np.stack(ask["x"]), np.stack(own["x"])), a == b, c != d


def _positives(k: int):
    def find(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        scores, same, other = _scores(own, ask)
        at, col = first_of_rows(scores, same & other, k)
        return pd.DataFrame({"anchor": ask["row"].to_numpy()[at], "vec_id": own["vec_id"].to_numpy()[col], "row": own["row"].to_numpy()[col], "score": scores[at, col]})

    return find


def _slots(k: int, most: int):
    def find(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        scores, same, other = _scores(own, ask)
        fits, found = ~same & other, []
        limits = np.full((len(ask), most + 1), NONE)
        for i, own_limits in enumerate(ask["limits"]):
            limits[i, : len(own_limits)] = own_limits
        least = ask["least"].to_numpy()[:, None]
        for slot in range(most):
            upper, lower = limits[:, [slot]], limits[:, [slot + 1]]
            at, col = first_of_rows(scores, fits & (scores <= upper) & (scores > lower) & (scores >= least), k)
            found.append(pd.DataFrame({"anchor": ask["row"].to_numpy()[at], "slot": slot, "vec_id": own["vec_id"].to_numpy()[col], "row": own["row"].to_numpy()[col], "score": scores[at, col]}))
        return pd.concat(found)

    return find


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, asked: Column, k: int = 10, positives: int = 5, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", block: int = 8192, anchor_block: int = 512) -> DataFrame:
    """RESULT: for each anchor and each of its positives the first k rows of other labels whose score, the inner product of
    integer vectors, is at least low and at most high percent of the positive's.

    asked: which rows are anchors, by their vec_id. Positives of an anchor are the first `positives` rows of its label. Higher scores
    come first, then smaller vec_id. Rows with a null key or label take no part, nor do vectors that integers() leaves out; rows with the
    anchor's own key are neither its positives nor its negatives. Repeated rows count each for itself, as anchors too. A positive with a negative
    score has an empty window. No anchor, or no row, gives no rows. block, anchor_block: rows and anchors of a meeting.
    """
    own = vectors.withColumn("_label", label if isinstance(label, Column) else F.col(label))
    found = integers(own, key, vector, "_label").filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = save(found.select("vec_id", F.xxhash64(F.col("label").cast("string")).alias("label_id"), "x", F.monotonically_increasing_id().alias("row")), "vectors")
    anchors = save(rows.filter(asked), "anchors")
    near = _meet(rows, anchors, block, anchor_block, _positives(positives), "anchor long, vec_id long, row long, score long")
    # Percentages of whole numbers from 0 on, without products that are too large.
    share = lambda percent, more: f"(score div 100) * {percent} + ((score % 100) * {percent} + {more}) div 100"
    chosen = _first(near, ["anchor"], positives).filter("score >= 0").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(share(high, 0)).alias("upper"), F.expr(share(low, 99)).alias("lower"))
    chosen = save(chosen.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("upper"))) - 1), "positives")
    limits = chosen.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    asking = save(anchors.join(limits.withColumnRenamed("anchor", "row"), "row"), "asking")
    slots = _meet(rows, asking, block, anchor_block, _slots(k, positives), "anchor long, slot int, vec_id long, row long, score long")
    best = F.struct((-F.col("score")).alias("minus"), "vec_id", "row")
    of_slot = [F.array_sort(F.collect_list(F.when(F.col("slot") == i, best))).alias(f"s{i}") for i in range(positives)]
    merged = _first(slots, ["anchor", "slot"], k).groupBy("anchor").agg(*of_slot)
    for i in range(positives - 2, -1, -1):
        merged = merged.withColumn(f"s{i}", F.slice(F.concat(f"s{i}", f"s{i + 1}"), 1, k))
    window = F.filter(F.col("suffixes")[F.col("slot")], lambda s: -s["minus"] >= F.col("lower"))
    answers = chosen.join(merged.select("anchor", F.array(*[f"s{i}" for i in range(positives)]).alias("suffixes")), "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(window).alias("place", "best"))
    named = answers.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("best.vec_id").alias("negative_id"), "positive_score", (-F.col("best.minus")).alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others; a seventh of the labels are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM ({VECTORS_SQL}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
