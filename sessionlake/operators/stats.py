"""Counts and roll-ups of sessions, messages, chunks and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.derive import real_prompt, real_response


def first_by(value: str, order: str, keep: Column) -> Column:
    return F.min_by(F.when(keep, F.col(value)), F.when(keep, F.col(order)))


def last_by(value: str, order: str, keep: Column) -> Column:
    return F.max_by(F.when(keep, F.col(value)), F.when(keep, F.col(order)))


def prompts(messages: DataFrame) -> DataFrame:
    """session_id, first_prompt, last_prompt, last_response, message_count, turn_count, ts_first, ts_last in one aggregate.

    The first real prompt, or else the first; the last real response, or else the last.
    """
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("session_id").agg(
        F.coalesce(first_by("content", "seq", user & real_prompt("content")), first_by("content", "seq", user)).alias("first_prompt"),
        last_by("content", "seq", user).alias("last_prompt"),
        F.coalesce(last_by("content", "seq", answer & real_response("content")), last_by("content", "seq", answer)).alias("last_response"),
        F.count("*").alias("message_count"), F.count_if(user).alias("turn_count"), F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"),
    )


def by_harness(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("harness").agg(F.count("*").alias("sessions"), F.count_if(~F.col("is_child")).alias("parents"), F.count_if("is_child").alias("children"))


def overview(sessions: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sessions, parents, children, messages, chunks, embedded."""
    s = sessions.agg(F.count("*").alias("sessions"), F.count_if(~F.col("is_child")).alias("parents"), F.count_if("is_child").alias("children"))
    return s.join(messages.agg(F.count("*").alias("messages"))).join(chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded")))  # one row each


def project_stats(sessions: DataFrame) -> DataFrame:
    """A row for each project path, null being `unknown`: counts, first and last start, messages, name, harness counts by name."""
    path = F.coalesce("project_path", F.lit("unknown"))
    by = sessions.groupBy(path.alias("project_path"), "harness").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_child")).alias("parents"), F.count_if("is_child").alias("children"), F.min("ts_start").alias("first_ts"),
        F.max("ts_start").alias("last_ts"), F.sum("message_count").alias("messages"), F.min_by("project_name", F.struct("ts_start", "id")).alias("name"), F.min(F.struct("ts_start", "id")).alias("at"),
    )
    return by.groupBy("project_path").agg(
        F.sum("n").alias("sessions"), F.sum("parents").alias("parents"), F.sum("children").alias("children"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("messages").alias("messages"), F.min_by("name", "at").alias("project_name"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("harness", "n")))).alias("harness_counts"),
    )


def top_tags(tags: DataFrame, sessions: DataFrame, most: int = 10) -> DataFrame:
    """project_path, value, n, place: the tags that most sessions of a project have; ties by name. tags: session_id, value."""
    path = sessions.select(F.col("id").alias("session_id"), F.coalesce("project_path", F.lit("unknown")).alias("project_path"))
    counted = tags.select("session_id", "value").distinct().join(path, "session_id").groupBy("project_path", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("project_path").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).filter(F.col("place") <= most)


def coverage(messages: DataFrame) -> DataFrame:
    """session_id, filled, n, trusted: whether more than half of a session's messages have text."""
    own = messages.groupBy("session_id").agg(F.count_if(F.coalesce(F.col("content"), F.lit("")) != "").alias("filled"), F.count("*").alias("n"))
    return own.withColumn("trusted", F.col("filled") > 0.5 * F.col("n"))


def needing_summary(sessions: DataFrame, summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """Parents with a first prompt and some answer but no summary."""
    answered = messages.filter((F.col("role") == "assistant") & (F.coalesce(F.col("content"), F.lit("")) != "")).select(F.col("session_id").alias("id"))
    own = sessions.filter(~F.col("is_child") & (F.coalesce(F.col("first_prompt"), F.lit("")) != ""))
    return own.join(answered, "id", "left_semi").join(summaries.select(F.col("session_id").alias("id")), "id", "left_anti")


def synthetic_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, seq, role, content from the first prompt and last response of sessions without messages."""
    bare = sessions.join(messages.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    row = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    both = F.filter(F.array(row("user", "first_prompt"), row("assistant", "last_response")), lambda x: F.coalesce(x["content"], F.lit("")) != "")
    return bare.select(F.col("id").alias("session_id"), F.posexplode(both).alias("seq", "x")).select("session_id", "seq", "x.*")


def observed(rows: DataFrame, name: str):
    """rows, and an Observation of how many there were, filled when an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows")), seen


def parents_and_children(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sessions.filter(~F.col("is_child")), sessions.filter("is_child")
