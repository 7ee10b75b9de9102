"""Tables that are kept: upserts, replacement by key, deletion, and versions published by a pointer."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """fresh, and what of target has no key in it."""
    return target.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_by(target: DataFrame, fresh: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """All rows of a touched key go, those of fresh come. Without `touched`, keys of fresh are meant; a key without fresh rows then keeps its own."""
    gone = (fresh if touched is None else touched).select(key).distinct()
    return target.join(gone, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def sync_annotations(target: DataFrame, fresh: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations replaced session by session, and those of unknown sessions, which wait. A missing source is `hook`."""
    named = fresh.withColumn("source", F.coalesce("source", F.lit("hook")))
    known = sessions.select(F.col("id").alias("session_id")).distinct()
    return replace_by(target, named.join(known, "session_id", "left_semi"), "session_id"), named.join(known, "session_id", "left_anti")


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the sessions in gone (id) and all that belongs to them; children lose their parent."""
    ids = gone.select("id").distinct()
    sessions = tables["sessions"].join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("lost"))
    sessions = sessions.join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("lost").isNull(), F.col("parent_id"))).select(*tables["sessions"].columns)
    own = ids.select(F.col("id").alias("session_id"))
    return {"sessions": sessions} | {n: t.join(own, "session_id", "left_anti") for n, t in tables.items() if n != "sessions"}


def import_summaries(sources: DataFrame, sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, summary, content_hash for known sessions without a summary; the source with the smallest priority counts.

    sources: priority, entries (map of session id to summary and content_hash).
    """
    rows = sources.select("priority", F.explode("entries").alias("session_id", "e")).select("priority", "session_id", "e.summary", "e.content_hash")
    rows = rows.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").join(summaries.select("session_id"), "session_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("priority", "summary"))
    return rows.withColumn("k", first).filter("k = 1").drop("k", "priority")


def append_annotation(annotations: DataFrame, session_id: str, kind: str, value: str, source: str = "manual") -> DataFrame:
    row = annotations.sparkSession.range(1).select(F.lit(session_id).cast(dict(annotations.dtypes)["session_id"]).alias("session_id"), F.current_timestamp().cast(dict(annotations.dtypes)["ts"]).alias("ts"), F.lit(kind).alias("type"), F.lit(value).alias("value"), F.lit(source).alias("source"))
    return annotations.unionByName(row)


class Store:
    """Tables as versions in a folder: a write makes a new version, then a row in the table's log points to it.

    A job that dies leaves the version before it in place. Readers take the newest pointer.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        at = f"{self.folder}/{name}/v-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        df.write.partitionBy(*partition_by).parquet(at)
        self.spark.range(1).select(F.lit(at).alias("path"), F.lit(time.time_ns()).alias("at")).write.mode("append").parquet(f"{self.folder}/{name}/log")

    def read(self, name: str) -> DataFrame:
        log = self.spark.read.parquet(f"{self.folder}/{name}/log")
        return self.spark.read.parquet(log.agg(F.max_by("path", "at")).first()[0])

    def has(self, name: str) -> bool:
        """Whether the table was ever written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/log")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """For tables that are only ever added to, such as logs of searches."""
        df.write.mode("append").partitionBy(*partition_by).parquet(f"{self.folder}/{name}/rows")

    def rows(self, name: str) -> DataFrame:
        """What append() has added."""
        return self.spark.read.parquet(f"{self.folder}/{name}/rows")

    def set_meta(self, key: str, value: str) -> None:
        self.append("meta", self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(time.time_ns()).alias("at")))

    def get_meta(self, key: str) -> str | None:
        row = self.spark.read.parquet(f"{self.folder}/meta/rows").filter(F.col("key") == key).agg(F.max_by("value", "at")).first()
        return row[0]
