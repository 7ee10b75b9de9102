"""Scans of transcripts: lines with context, all occurrences with their places, and a transcript cut to a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import line_col, occurrences


def line_hits(messages: DataFrame, needle: str, around: int = 2, most: int | None = 50) -> DataFrame:
    """session_id, message_id, role, line_num (from 1), match_text, context_before, context_after: at most `most` a session (None: all), in order. An empty needle finds nothing."""
    if not needle:
        messages = messages.filter("false")
    lines = F.split("content", "\n")
    own = messages.filter(F.lower("content").contains(needle.lower())).select("session_id", "message_id", "seq", "role", lines.alias("lines"))
    rows = own.select("*", F.posexplode("lines").alias("i", "match_text")).filter(F.lower("match_text").contains(needle.lower()))
    before = F.slice("lines", F.greatest(F.col("i") - around, F.lit(0)) + 1, F.least(F.col("i"), F.lit(around)))
    out = rows.withColumns({"context_before": before, "context_after": F.slice("lines", F.col("i") + 2, around), "line_num": F.col("i") + 1})
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "message_id", "i"))
    out = out if most is None else out.withColumn("place", place).filter(F.col("place") <= most)
    return out.select("session_id", "message_id", "role", "line_num", "match_text", "context_before", "context_after")


def match_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("session_id").agg(F.count("*").alias("n"))


def find_occurrences(messages: DataFrame, needle: str) -> DataFrame:
    """session_id, message_id, offset, line, column, i (from 1) of n in the session, next_i and previous_i going round."""
    own = messages.filter(F.col("content").isNotNull()).select("session_id", "message_id", "seq", "content", F.explode(occurrences("content", F.lit(needle))).alias("offset"))
    placed = own.withColumn("at", line_col("content", "offset")).drop("content")
    w = Window.partitionBy("session_id")
    out = placed.withColumns({"i": F.row_number().over(w.orderBy("seq", "message_id", "offset")), "n": F.count("*").over(w)})
    return out.select("session_id", "message_id", "offset", "at.line", "at.column", "i", "n", (F.col("i") % F.col("n") + 1).alias("next_i"), (F.pmod(F.col("i") - 2, F.col("n")) + 1).alias("previous_i"))


def budgeted(messages: DataFrame, budget: int = 80_000, least: int = 200) -> DataFrame:
    """session_id, transcript: `[USER]: ...` blocks in order up to the budget of characters; the message that crosses it is cut if more than `least` are left."""
    text = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), F.col("content"))
    own = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce(F.col("content"), F.lit("")) != "")).select("session_id", "seq", text.alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = budget - F.col("before")
    kept = own.withColumn("before", before).filter((left >= F.length("text")) | (left > least))
    cut = F.when(left >= F.length("text"), F.col("text")).otherwise(F.concat(F.substr("text", F.lit(1), left.cast("int")), F.lit("...")))
    return kept.select("session_id", "seq", cut.alias("text")).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("transcript"))
