"""Queries that write the test tables as transcript files to the shared folder, and read these by Spark's own `read.format`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import incremental, kept
from sessionlake.plans import adapters as ad
from sessionlake.plans import indexing as ix
from sessionlake.plans.adapters import scratch, sql
from sessionlake.sources import files
from sessionlake.sources import transcripts as src
from sessionlake.streaming import counters

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def filed(spark: SparkSession, lines: DataFrame, split: str = "65536") -> DataFrame:
    """Lines written as files and read again in small pieces."""
    at = scratch(spark)
    files.write(lines, at)
    return files.lines(files.read(spark, {"logs": at}, split=split))


@query(ix.ROUND_TRIP)
def files_jsonl_a(spark, d):
    found = src.ProjectLines(spark, lines=filed(spark, ix.project_lines(spark, d))).messages()
    return found.select("session_id", "seq", "role", "content", *ad.seconds("ts"))


@query(ix.ROUND_TRIP)
def files_jsonl_b(spark, d):
    found = src.TypedLines(spark, lines=filed(spark, ix.typed_lines(spark, d))).messages()
    return found.select("session_id", "seq", "role", "content", *ad.seconds("ts"))


@query(ix.HEADED)
def files_jsonl_c(spark, d):
    """Lines, and beside each file another with the session's settings."""
    lines, settings = ix.headed_lines(spark, d)
    at, end = scratch(spark), ".settings.json"
    files.write(lines, at)
    files.write(settings.select("folder", F.col("session_id").alias("stem"), F.to_json(F.struct("model")).alias("value")), at, order="value", suffix=end)
    beside = src.settings_files(files.read(spark, {"logs": at}, whole="true", suffix=end))
    found = src.HeadedLines(spark, lines=files.lines(files.read(spark, {"logs": at})), settings=beside).sessions()
    return found.select("id", "message_count", "model", "first_prompt", "title")


@query(ix.TREE)
def files_tree(spark, d):
    """Messages, parts and sessions, a file each, some of which aren't JSON."""
    at, found = scratch(spark), {}
    for kind, rows in ix.tree_of(spark, d).items():
        files.write(rows, f"{at}/{kind}", order="value", suffix=".json")
        found[kind] = files.read(spark, {kind: f"{at}/{kind}"}, whole="true", suffix=".json").select("folder", "stem", "mtime", "value")
    return src.DocumentTree(spark, files=found).messages().select("session_id", "seq", "message_id", "role", "content", *ad.seconds("ts"))


@query(sql("SELECT id::VARCHAR AS id, harness, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'changed' END AS reason FROM s WHERE harness IN ('jsonl-a', 'kv') AND id % 3 < 2"))
def files_manifest(spark, d):
    """What to index again of two harnesses among five: a third was never indexed, a third long ago, a third after it was written. Files aren't opened."""
    at, s = scratch(spark), ad.sessions(spark, d)
    files.write(s.select(F.concat(F.col("harness"), F.lit("-logs")).alias("folder"), F.col("id").cast("string").alias("stem"), F.to_json(F.struct("first_prompt")).alias("value")), at, order="value")
    names = files.read(spark, {h: files.made(f"{at}/{h}-logs") for h in ad.HARNESSES}, names="true")
    own = files.manifest(names.filter(F.col("harness").isin("jsonl-a", "kv") & (F.col("mtime") > F.lit("2024-01-01").cast("timestamp"))))
    indexed = F.when(F.col("id") % 3 == 1, F.lit("2000-01-01")).otherwise(F.lit("2200-01-01")).cast("timestamp")
    known = own.filter("id % 3 > 0").select("harness", "file_path", F.col("mtime").alias("file_mtime"), indexed.alias("indexed_at"))
    return incremental.changed(own, known).select("id", "harness", "reason")


@query(sql("""SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, role, content FROM m
WHERE trim(content) <> '' AND (session_id % 2 = 1 OR session_id % 6 = 0 OR seq < 2)"""))
def files_stream(spark, d):
    """A stream of files into a kept table: even sessions first, each begun only; then a third of these grown, and odd ones new."""
    at, lines = scratch(spark), ix.project_lines(spark, d)
    tables, stem = kept.Tables(spark, f"{at}/tables"), F.col("stem").cast("long")
    sink = counters.session_sink(tables, "messages", "files")
    publish = lambda rows, batch: sink(src.ProjectLines(spark, lines=files.lines(rows)).messages(), batch)
    for some in (lines.filter((stem % 2 == 0) & (F.col("pos.line") < 2)), lines.filter((stem % 2 == 1) | (stem % 6 == 0))):
        files.write(some, files.made(f"{at}/in"))
        counters.replace_sessions(files.stream(spark, {"jsonl-a": f"{at}/in"}, settle="0"), publish, f"{at}/checkpoint").awaitTermination()
    if not tables.state()["tables"]:  # no file at all, no batch
        sink(src.ProjectLines(spark, lines=lines).messages(), 0)
    return tables.read("messages").select("session_id", "seq", "role", "content")
