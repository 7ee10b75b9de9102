"""What to index again: a manifest of files against the sessions indexed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, pattern: str, key: str = r"([^/]+)\.[^./]+$", harness: str = "") -> DataFrame:
    """harness, file_path, id, mtime by the file system's listing, as changed() takes them; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "modificationTime")
    return files.groupBy(F.regexp_extract("path", key, 1).alias("id")).agg(F.max("modificationTime").alias("mtime"), F.max("path").alias("file_path")).withColumn("harness", F.lit(harness))


def changed(files: DataFrame, sessions: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """files with reason `new` or `changed`. files: harness, file_path, mtime; sessions: harness, file_path, file_mtime, indexed_at.

    A session without either time counts as not indexed. With a cut-off, files that were never indexed and are older are
    left out, but not where their harness has more files than indexed sessions.
    """
    own = sessions.filter("file_mtime is not null and indexed_at is not null").select("file_path", "indexed_at")
    joined = files.join(own, "file_path", "left")
    reason = F.when(F.col("indexed_at").isNull(), "new").when(F.col("mtime") > F.col("indexed_at"), "changed")
    out = joined.withColumn("reason", reason).filter("reason is not null")
    if cutoff is not None:
        backlog = files.groupBy("harness").agg(F.count("*").alias("files")).join(sessions.groupBy("harness").agg(F.count("*").alias("indexed")), "harness", "left").select("harness", (F.col("files") > F.coalesce("indexed", F.lit(0))).alias("backlog"))
        out = out.join(backlog, "harness").filter((F.col("reason") == "changed") | F.col("backlog") | (F.col("mtime") >= cutoff)).drop("backlog")
    return out.select(*files.columns, "reason")


def newer_than(files: DataFrame, mark: Column) -> tuple[DataFrame, Column]:
    """Files changed after a high-water mark, and the expression of the next mark, which stays where nothing changed."""
    return files.filter(F.col("mtime") > mark), F.coalesce(F.max("mtime"), mark)
