"""Structured Streaming: running counts, messages once each, and segments of transcripts that replace sessions batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.functions.derive import real_prompt, real_response
from sessionlake.operators.kept import Tables


def session_counts(messages: DataFrame) -> DataFrame:
    """Running counts of a session: messages, turns, first and last time. Update or complete mode."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def project_counts(events: DataFrame, by: list[str], ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts in windows of event time; what comes later than `late` is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))


def once(messages: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each message_id once within the watermark."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["message_id"])


def first_last(messages: DataFrame) -> DataFrame:
    """Running first real prompt and last real response of each session, by sequence; state is two values a session."""
    ok, good = (F.col("role") == "user") & real_prompt("content"), (F.col("role") == "assistant") & real_response("content")
    return messages.groupBy("session_id").agg(F.min_by(F.when(ok, F.col("content")), F.when(ok, F.col("seq"))).alias("first_prompt"), F.max_by(F.when(good, F.col("content")), F.when(good, F.col("seq"))).alias("last_response"))


def replace_sessions(messages: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hands every micro-batch to publish(rows, batch id), which replaces the sessions in it; a batch may come twice, with the same id."""
    writer = messages.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_sink(tables: Tables, name: str, stream: str, key: str = "session_id", buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """What replace_sessions() calls for a kept table: all rows of a batch's sessions go, the batch's come, exactly once.

    A batch is one run, and the pointer that publishes its rows also notes its number under `stream`, so a batch that comes again after a
    failure changes nothing, whether the failure was before or after the pointer. A session's rows must be in one batch; its first batch
    makes the table, with `buckets`. An empty batch is noted too. Another writer's run in between fails the batch (kept.Conflict), and Spark gives it again.
    """

    def publish(rows: DataFrame, batch: int) -> None:
        run = tables.run()
        done = run.state.setdefault("batches", {})
        if done.get(stream, -1) >= batch:
            return
        if name in run.tables:
            run.replace(name, rows, run.keys(rows, key, run.tables[name]["buckets"]))
        else:
            run.whole(name, rows, key, buckets)
        done[stream] = batch
        run.publish()

    return publish
