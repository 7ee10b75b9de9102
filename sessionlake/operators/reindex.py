"""Kept sessions, messages, chunks, annotations and project statistics: built whole, or brought up to date for changed sessions only."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators import chunks as ch
from sessionlake.operators import hierarchy, stats
from sessionlake.operators.kept import Tables, buckets_for, rows_in

PER_BUCKET = 500_000  # messages of a bucket, about
OF_SESSION = ("messages", "chunks", "annotations")


def sessions(kept: Tables) -> DataFrame:
    """Kept sessions with the parents that are there. Stated parents are kept, so one that comes or goes later counts without a change of its children."""
    return hierarchy.with_known_parents(kept.read("sessions"))


def _path() -> F.Column:
    return F.coalesce("project_path", F.lit("unknown")).alias("project_path")


def full(kept: Tables, given: DataFrame, messages: DataFrame, annotations: DataFrame, metadata_only: bool = False, budget: int = 400, per_bucket: int = PER_BUCKET) -> dict[str, int | float]:
    """Builds every table and publishes them together: sessions, messages, chunks, annotations of known sessions, project statistics.

    metadata_only leaves messages and chunks as they are. per_bucket: messages of a bucket, about; the number of buckets follows from the
    data, and stays until the next full build. Returns rows by table, and elapsed seconds.
    """
    began, run = time.time(), kept.run()
    buckets = run.tables["messages"]["buckets"] if metadata_only else buckets_for(messages.count(), per_bucket)
    own = run.whole("sessions", given, "id", buckets)
    parts = {"sessions": own}
    known = annotations.join(run.read("sessions").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    parts["annotations"] = run.whole("annotations", known, "session_id", buckets)
    if not metadata_only:
        parts["messages"] = run.whole("messages", messages, "session_id", buckets)
        parts["chunks"] = run.whole("chunks", ch.all_chunks(run.read("sessions"), run.read("messages"), budget), "session_id", buckets)
    parts["projects"] = run.whole("projects", stats.project_stats(hierarchy.with_known_parents(run.read("sessions"))), "project_path", buckets)
    run.publish()
    return {n: rows_in(kept, p) for n, p in parts.items()} | {"seconds": time.time() - began}


def incremental(kept: Tables, touched: DataFrame, given: DataFrame, messages: DataFrame, annotations: DataFrame, budget: int = 400, most: int = 4) -> dict[str, int | float]:
    """Brings the tables of full() up to date for touched sessions (id), whose rows as they are now are given; those without one are gone.

    Only rows of touched sessions are written, with the statistics of the projects that they are or were in, and of children whose parent came or went; what
    is read whole are the columns of sessions that tell these. Annotations are replaced by session where there are fresh ones. Buckets
    of more than `most` parts are written anew. Everything is published together. Returns rows written by table, how many sessions were touched and how many buckets compacted, and elapsed seconds.
    """
    began, run = time.time(), kept.run()
    buckets = run.tables["sessions"]["buckets"]
    keys = run.keys(touched, "id", buckets)
    ids = run.read_keys(keys, "id")
    own = ids.withColumnRenamed("id", "session_id")
    old = run.read("sessions", keys["buckets"]).join(ids, "id", "left_semi")
    # What is given is asked for once; all else reads what was written of it.
    parts = {"sessions": run.replace("sessions", given.join(ids, "id", "left_semi"), keys), "messages": run.replace("messages", messages.join(own, "session_id", "left_semi"), keys)}
    fresh, fresh_messages = (run.read_part(n, parts[n]) for n in ("sessions", "messages"))
    gone = ids.join(fresh.select("id"), "id", "left_anti")
    parts["chunks"] = run.replace("chunks", ch.all_chunks(fresh, fresh_messages, budget), keys)
    # Annotations: those of sessions that are gone go, and those of sessions with fresh ones.
    named = annotations.withColumn("source", F.coalesce("source", F.lit("hook"))).join(fresh.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    noted = run.keys(named.select(F.col("session_id").alias("id")).unionByName(gone), "id", buckets)
    parts["annotations"] = run.replace("annotations", named, noted)
    # Projects of old and of fresh rows, and of children whose parent came or went.
    moved = gone.unionByName(fresh.select("id").join(old.select("id"), "id", "left_anti")).select(F.col("id").alias("parent_id"))
    before = old.select(_path())
    now = run.read("sessions")
    children = now.select("parent_id", "project_path").join(moved, "parent_id", "left_semi").select(_path())
    paths = run.keys(before.unionByName(fresh.select(_path())).unionByName(children), "project_path", buckets)
    named_paths = run.read_keys(paths, "_path")
    some = now.withColumn("_path", _path()).join(named_paths, "_path", "left_semi").drop("_path")
    known = some.join(now.select(F.col("id").alias("known_id")), F.col("parent_id") == F.col("known_id"), "left")
    linked = known.withColumns({"parent_id": F.col("known_id"), "is_child": F.col("is_child") | F.col("known_id").isNotNull()}).drop("known_id")
    parts["projects"] = run.replace("projects", stats.project_stats(linked), paths)
    compacted = sum(len(run.compact(n, most)) for n in ("sessions", *OF_SESSION, "projects"))
    run.publish()
    return {n: rows_in(kept, p) for n, p in parts.items()} | {"touched": rows_in(kept, keys), "compacted": compacted, "seconds": time.time() - began}
