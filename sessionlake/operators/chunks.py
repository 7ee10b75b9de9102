"""Chunks of sessions for retrieval: a summary, turns packed to a budget, and uses of tools with their surroundings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.derive import RUNNER
from sessionlake.functions.text import preview
from sessionlake.operators.packing import packed

COLUMNS = ["session_id", "chunk_type", "inner", "message_id", "content", "token_count"]


def turn_chunks(messages: DataFrame, budget: int = 400) -> DataFrame:
    """Messages as `[role]: content`, packed in order to the budget of estimated tokens, never cut. Equal sequence numbers are ordered by message_id, then text.

    Sessions may be of any length: packing is by packing.packed(), whose steps are run when this is called.
    """
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]: "), F.coalesce("content", F.lit("")))
    own = messages.select("session_id", "seq", "message_id", line.alias("line")).withColumn("tokens", F.floor(F.length("line") / 4).cast("int"))
    placed = packed(own, budget, ["seq", "message_id", "line"])
    chunks = placed.groupBy("session_id", "inner").agg(F.sort_array(F.collect_list(F.struct("seq", "message_id", "line"))).alias("own"), F.sum("tokens").alias("token_count"))
    return chunks.select("session_id", F.lit("turn").alias("chunk_type"), "inner", F.col("own")[0]["message_id"].alias("message_id"), F.array_join(F.col("own.line"), "\n\n").alias("content"), F.col("token_count").cast("int").alias("token_count"))


def summary_chunks(sessions: DataFrame, messages: DataFrame, runner: str = RUNNER) -> DataFrame:
    """One chunk a session: project, path, title, the first prompt's beginning and the tools used. sessions: id, project_name, project_path, title."""
    user = F.when((F.col("role") == "user") & (F.trim("content") != ""), F.col("content"))
    tools = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(rf"{runner}\s+(\S+)"), 1)
    own = messages.withColumns({"user": user, "tools": tools}).groupBy("session_id").agg(F.min_by("user", F.when(F.col("user").isNotNull(), F.col("seq"))).alias("prompt"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    content = F.concat_ws("\n", F.concat(F.lit("Project: "), F.coalesce("project_name", F.lit(""))), F.concat(F.lit("Path: "), F.coalesce("project_path", F.lit(""))), line("Title: ", F.col("title")), line("First prompt: ", preview("prompt", 200)), line("Tools used: ", F.array_join("tools", ", ")))
    joined = sessions.select(F.col("id").alias("session_id"), "project_name", "project_path", "title").join(own, "session_id", "left")
    return joined.select("session_id", F.lit("summary").alias("chunk_type"), F.lit(0).alias("inner"), F.lit(None).cast(dict(messages.dtypes)["message_id"]).alias("message_id"), content.alias("content"), F.lit(None).cast("int").alias("token_count"))


def tool_chunks(messages: DataFrame, runner: str = RUNNER, around: int = 200) -> DataFrame:
    """One chunk for each use of the runner: tool, command, and the text around it. Only messages that name the runner reach Python."""
    kinds = dict(messages.dtypes)
    pattern = re.compile(runner + r"\s+(\S+)(?:\s+(.+?))?(?:\n|$)", re.MULTILINE)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[tuple] = []
            for s, m, q, text in zip(p["session_id"], p["message_id"], p["seq"], p["content"]):
                for i, hit in enumerate(pattern.finditer(text)):
                    near = text[max(0, hit.start() - around) : hit.end() + around].strip()
                    command = f"Command: {hit[2]}\n" if hit[2] else ""
                    out.append((s, m, q, i, f"Tool: {runner} {hit[1]}\n{command}Context: {near}"))
            yield pd.DataFrame(out, columns=["session_id", "message_id", "seq", "hit", "content"])

    own = messages.filter(F.col("content").contains(runner)).select("session_id", "message_id", "seq", "content")
    found = own.mapInPandas(cut, f"session_id {kinds['session_id']}, message_id {kinds['message_id']}, seq {kinds['seq']}, hit int, content string")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "hit")) - 1
    return found.select("session_id", F.lit("tool_usage").alias("chunk_type"), place.alias("inner"), "message_id", "content", F.lit(None).cast("int").alias("token_count"))


def all_chunks(sessions: DataFrame, messages: DataFrame, budget: int = 400, runner: str = RUNNER) -> DataFrame:
    """Summary, turns and tools with one running chunk_index in each session."""
    both = summary_chunks(sessions, messages, runner).unionByName(turn_chunks(messages, budget)).unionByName(tool_chunks(messages, runner))
    kind = F.array_position(F.array(F.lit("summary"), F.lit("turn"), F.lit("tool_usage")), F.col("chunk_type"))
    return both.withColumn("chunk_index", F.row_number().over(Window.partitionBy("session_id").orderBy(kind, "inner")) - 1).drop("inner")
