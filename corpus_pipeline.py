"""From documents to packed sequences: the stages of a training corpus, each written and read again before the next.

Each stage takes what the one before it kept. The first three keep the columns of documents; a row stays or goes as a
whole. In the first two the decision is made in the pass that reads the row, or goes along with it, so whole texts are not
shuffled; the third shuffles them only if it drops more than it may broadcast. The last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import language_id, order_minhash, packing, quality
from sessionlake.llm.common import save


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Rejects texts without a letter and those whose language is less likely than `least`."""
    found = language_id.predict(docs, language_id.learn(docs), carry=True)
    return found.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= least)).select("carried.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or lies too far from its group."""
    return quality.judge(quality.statistics(docs, carry=True)).filter("kept").select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 2_000_000) -> DataFrame:
    """Keeps one document of each class: the one with the smallest key (null last), then text hash; of repeated rows one.

    What goes is known by key and text hash. Up to `most` of these pairs (16 bytes each) are broadcast to where texts are read; more of them are joined, which shuffles texts.
    """
    pair = [next(n for n in (f"{c}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("_key", "_node")]
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    found = save(order_minhash.near_duplicates(docs).select(key.alias(pair[0]), F.col("node").alias(pair[1]), "comp").groupBy(*pair, "comp").count(), "classes")
    first = found.groupBy("comp").agg(F.min(F.struct(*pair)).alias("m")).select("comp", "m.*")
    gone = save(found.join(first, ["comp", *pair], "left_anti").select(*pair), "gone")
    twice = save(found.filter("count > 1").join(first, ["comp", *pair], "left_semi").select(*pair), "twice")
    small = lambda few: F.broadcast(few) if few.count() <= most else few
    rows = docs.withColumns(dict(zip(pair, (key, F.xxhash64(F.coalesce("text", F.lit(""))))))).join(small(gone), pair, "left_anti")
    if twice.limit(1).count():
        again = small(twice)
        rows = rows.join(again, pair, "left_anti").unionByName(rows.join(again, pair, "left_semi").dropDuplicates(pair))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
