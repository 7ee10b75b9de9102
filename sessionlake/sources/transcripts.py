"""Sources of transcripts: three forms of JSON lines, key-value exports, and trees of JSON documents, as sessions and messages.

Each source reads files as text with their names and times, parses lines leniently (bad ones go to rejects), and
returns DataFrames. Lines are ordered by the start of their file block and their place in it. New forms register a class.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.functions import derive as dv

MESSAGE = ["session_id", "seq", "message_id", "role", "content", "ts"]


class TranscriptSource(Protocol):
    """What a source gives: sessions (id, harness, ...) and messages (MESSAGE)."""

    name: str

    def sessions(self) -> DataFrame: ...

    def messages(self) -> DataFrame: ...


_SOURCES: dict[str, type] = {}


def register(kind: type) -> type:
    """Makes a source class known by its name."""
    _SOURCES[kind.name] = kind
    return kind


def source(name: str) -> type:
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def read_lines(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """file_path, stem, folder, mtime, pos, value, v (VARIANT, null for a line that isn't JSON) for each line that isn't blank."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.jsonl").text(pattern)
    path = F.col("_metadata.file_path")
    own = lines.select(
        path.alias("file_path"), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("pos"), "value",
    )
    return own.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that aren't JSON."""
    return lines.filter("v is null").select("file_path", "pos", "value")


def numbered(rows: DataFrame, order: str = "pos") -> DataFrame:
    """MESSAGE from rows with the session's id, role, content, ts and perhaps message_id: numbered from 0 after all filters."""
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1
    own = rows.withColumn("seq", seq)
    given = F.col("message_id") if "message_id" in rows.columns else F.lit(None).cast("string")
    return own.withColumn("message_id", F.coalesce(given, F.concat_ws("_", "session_id", "seq"))).select(*MESSAGE)


def first(value: Column, pos: str = "pos") -> Column:
    """The first value that is neither null nor empty."""
    keep = F.nullif(value, F.lit("")).isNotNull()
    return F.min_by(F.when(keep, value), F.when(keep, F.col(pos)))


def last(value: Column, pos: str = "pos") -> Column:
    keep = F.nullif(value, F.lit("")).isNotNull()
    return F.max_by(F.when(keep, value), F.when(keep, F.col(pos)))


@register
class ProjectLines:
    """`<root>/<project>/<session>.jsonl`: rows of type user or assistant with a message; other types are skipped. The session's id is the file's stem."""

    name = "jsonl-a"

    def __init__(self, spark: SparkSession, root: str | None = None, lines: DataFrame | None = None) -> None:
        self.lines = read_lines(spark, f"{root}/*/*.jsonl") if lines is None else lines

    def events(self) -> DataFrame:
        v = self.lines.filter("v is not null").select(F.col("stem").alias("session_id"), "folder", "file_path", "mtime", "pos", "v")
        role = F.coalesce(get("v", "$.message.role"), get("v", "$.type"))
        own = v.filter(get("v", "$.type").isin("user", "assistant")).withColumns({"role": role, "raw": get("v", "$.message.content", "variant")})
        text = F.when(F.col("role") == "user", dv.flatten_content(F.col("raw"), text_only=True)).otherwise(dv.flatten_content(F.col("raw")))
        own = own.withColumns({"content": text, "ts": F.try_to_timestamp(get("v", "$.timestamp")), "message_id": get("v", "$.uuid"), "cwd": get("v", "$.cwd"), "model": get("v", "$.message.model"), "side": get("v", "$.isSidechain", "boolean")})
        return own.filter((F.coalesce(F.trim("content"), F.lit("")) != "") & ~F.substring("content", 1, 100).contains(dv.REMINDER))

    def messages(self) -> DataFrame:
        return numbered(self.events())

    def sessions(self) -> DataFrame:
        user = F.col("role") == "user"
        own = self.events().groupBy("session_id").agg(
            first(F.when(user, F.col("cwd"))).alias("cwd"), F.first("folder").alias("folder"), F.first("file_path").alias("file_path"), F.max("mtime").alias("file_mtime"), first(F.col("model")).alias("model"),
            F.bool_or(user & F.coalesce("side", F.lit(False))).alias("side"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count("*").alias("message_count"),
            F.coalesce(F.min_by(F.when(user & dv.real_prompt("content"), F.col("content")), F.when(user & dv.real_prompt("content"), F.col("pos"))), first(F.when(user, F.col("content")))).alias("first_prompt"),
        )
        path = dv.project_path("cwd", "folder")
        worker = dv.worker_class("first_prompt", "folder")
        kind = F.when(F.col("side"), "sidechain").otherwise(F.nullif(worker, F.lit("")))
        return own.select(F.col("session_id").alias("id"), F.lit(self.name).alias("harness"), path.alias("project_path"), dv.project_name(path).alias("project_name"), "ts_start", F.coalesce("ts_end", "file_mtime").alias("ts_end"), kind.isNotNull().alias("is_child"), F.lit(None).cast("string").alias("parent_id"), kind.alias("child_type"), "message_count", dv.title(F.lit(None).cast("string"), "first_prompt").alias("title"), "first_prompt", "model", F.array().cast("array<string>").alias("tool_calls"), "file_path", "file_mtime")


@register
class TypedLines:
    """`**/*.jsonl`: rows session_meta, turn_context, event_msg and response_item with a payload. Names of threads may come from an index."""

    name = "jsonl-b"

    def __init__(self, spark: SparkSession, root: str | None = None, titles: str | None = None, lines: DataFrame | None = None) -> None:
        lines = (read_lines(spark, root, recursive=True) if lines is None else lines).filter("v is not null")
        self.spark, self.titles = spark, titles
        self.rows = lines.select("file_path", "stem", "mtime", "pos", get("v", "$.type").alias("type"), get("v", "$.payload", "variant").alias("p"), F.try_to_timestamp(get("v", "$.timestamp")).alias("ts"))

    def heads(self) -> DataFrame:
        """One row a file: the last session_meta whose id is the stem, or else the first; parent, role and nickname with their fallbacks."""
        own = self.rows.withColumn("meta", F.when(F.col("type") == "session_meta", F.to_json("p")))
        is_own = get("p", "$.id") == F.col("stem")
        meta = F.coalesce(F.max_by(F.when(is_own, F.col("meta")), F.when(is_own & F.col("meta").isNotNull(), F.col("pos"))), first(F.col("meta")))
        calls = F.when((F.col("type") == "response_item") & (get("p", "$.type") == "function_call"), get("p", "$.name"))
        heads = own.groupBy("file_path", "stem").agg(meta.alias("meta"), last(F.when(F.col("type") == "turn_context", get("p", "$.model"))).alias("model"), last(F.when(F.col("type") == "turn_context", get("p", "$.cwd"))).alias("turn_cwd"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.max("mtime").alias("file_mtime"), F.array_sort(F.collect_set(calls)).alias("tool_calls"))
        m = F.try_parse_json("meta")
        spawn = "$.source.subagent.thread_spawn"
        parent = F.coalesce(get(m, f"{spawn}.parent_thread_id"), get(m, "$.parent_thread_id"), get(m, "$.forked_from_id"))
        role = F.coalesce(get(m, f"{spawn}.agent_role"), get(m, "$.agent_role"))
        return heads.select("*", F.coalesce(F.nullif(get(m, "$.id"), F.lit("")), "stem").alias("session_id"), parent.alias("parent_id"), role.alias("agent_role"), F.coalesce(get(m, f"{spawn}.agent_nickname"), get(m, "$.agent_nickname")).alias("nickname"), F.coalesce(get(m, "$.cwd"), "turn_cwd").alias("cwd"))

    def texts(self) -> DataFrame:
        """Events, or where a session has none its response items."""
        event = get("p", "$.type")
        one = lambda path: F.nullif(F.trim(get("p", path)), F.lit(""))
        own = self.rows.filter(F.col("type").isin("event_msg", "response_item")).withColumn("kind", event)
        event_role = F.when(event == "user_message", "user").when(event == "agent_message", "assistant")
        events = own.filter("type = 'event_msg'").select("file_path", "pos", "ts", event_role.alias("role"), F.coalesce(*[one(f"$.{k}") for k in ("text", "content", "message", "delta")]).alias("content"), F.lit(True).alias("event"))
        items = get("p", "$.content", "array<variant>")
        wanted = F.when(get("p", "$.role") == "user", "input_text").otherwise("output_text")
        kept = F.filter(F.transform(F.filter(items, lambda x: get(x, "$.type") == wanted), lambda x: F.trim(get(x, "$.text"))), lambda t: F.coalesce(t, F.lit("")) != "")
        answers = own.filter((F.col("type") == "response_item") & (event == "message") & get("p", "$.role").isin("user", "assistant")).select("file_path", "pos", "ts", get("p", "$.role").alias("role"), F.array_join(kept, " ").alias("content"), F.lit(False).alias("event"))
        both = events.unionByName(answers).filter((F.coalesce("content", F.lit("")) != "") & F.col("role").isNotNull())
        return both.withColumn("has", F.max("event").over(Window.partitionBy("file_path"))).filter("event = has").drop("event", "has")

    def messages(self) -> DataFrame:
        return numbered(self.texts().join(self.heads().select("file_path", "session_id"), "file_path"))

    def sessions(self) -> DataFrame:
        user = F.col("role") == "user"
        own = self.texts().groupBy("file_path").agg(F.coalesce(F.min_by(F.when(user & dv.real_prompt("content"), F.col("content")), F.when(user & dv.real_prompt("content"), F.col("pos"))), first(F.when(user, F.col("content")))).alias("first_prompt"), F.count("*").alias("message_count"))
        joined = self.heads().join(own, "file_path", "left").filter("meta is not null or message_count is not null")
        title = F.lit(None).cast("string")
        if self.titles:
            joined = joined.join(thread_titles(self.spark, self.titles).withColumnRenamed("id", "session_id"), "session_id", "left")
            title = F.col("thread_name")
        child = F.col("parent_id").isNotNull()
        return joined.select(F.col("session_id").alias("id"), F.lit(self.name).alias("harness"), F.col("cwd").alias("project_path"), dv.project_name("cwd").alias("project_name"), "ts_start", "ts_end", child.alias("is_child"), "parent_id", F.when(child, F.coalesce("agent_role", F.lit("worker"))).alias("child_type"), F.coalesce("message_count", F.lit(0)).alias("message_count"), dv.title(title, "first_prompt").alias("title"), "first_prompt", "model", "tool_calls", "file_path", "file_mtime")


def thread_titles(spark: SparkSession, path: str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """id, thread_name from an index of JSON lines (or lines as read_lines() gives them): the last that isn't blank."""
    v = (read_lines(spark, path) if lines is None else lines).filter("v is not null").select(get("v", "$.id").alias("id"), F.trim(get("v", "$.thread_name")).alias("thread_name"), "pos")
    return v.filter("id is not null").groupBy("id").agg(last(F.col("thread_name")).alias("thread_name"))


@register
class HeadedLines:
    """`<root>/<project>/<session>.jsonl` of session_start and message rows, with `<session>.settings.json` beside it for the model."""

    name = "jsonl-c"

    def __init__(self, spark: SparkSession, root: str | None = None, lines: DataFrame | None = None, settings: DataFrame | None = None) -> None:
        self.lines = (read_lines(spark, f"{root}/*/*.jsonl") if lines is None else lines).filter("v is not null")
        if settings is not None:
            self.settings = settings
            return
        settings = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.settings.json").text(root, wholetext=True)
        self.settings = settings.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.settings\.json$", 1).alias("session_id"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"), get(F.try_parse_json("value"), "$.model").alias("model"))

    def events(self) -> DataFrame:
        own = self.lines.filter(get("v", "$.type") == "message").select(F.col("stem").alias("session_id"), "folder", "file_path", "mtime", "pos", get("v", "$.message.role").alias("role"), dv.flatten_content(get("v", "$.message.content", "variant"), dots="cut").alias("content"), F.try_to_timestamp(get("v", "$.timestamp")).alias("ts"), get("v", "$.id").alias("message_id"))
        return own.filter(F.col("role").isin("user", "assistant") & (F.coalesce(F.trim("content"), F.lit("")) != "") & ~F.substring("content", 1, 100).contains(dv.REMINDER))

    def messages(self) -> DataFrame:
        return numbered(self.events())

    def sessions(self) -> DataFrame:
        start = self.lines.filter(get("v", "$.type") == "session_start").groupBy(F.col("stem").alias("session_id")).agg(first(F.coalesce(F.nullif(get("v", "$.sessionTitle"), F.lit("")), get("v", "$.title"))).alias("given"), first(get("v", "$.cwd")).alias("cwd"))
        user = F.col("role") == "user"
        own = self.events().groupBy("session_id").agg(F.first("folder").alias("folder"), F.first("file_path").alias("file_path"), F.max("mtime").alias("file_mtime"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count("*").alias("message_count"), F.coalesce(F.min_by(F.when(user & dv.real_prompt("content"), F.col("content")), F.when(user & dv.real_prompt("content"), F.col("pos"))), first(F.when(user, F.col("content")))).alias("first_prompt"))
        joined = own.join(start, "session_id", "left").join(self.settings, ["session_id", "folder"], "left")
        path = dv.project_path("cwd", "folder")
        kind = F.nullif(F.regexp_extract("given", r"(?i)^(?:task|subagent)[:\s]+([\w-]+)", 1), F.lit(""))
        return joined.select(F.col("session_id").alias("id"), F.lit(self.name).alias("harness"), path.alias("project_path"), dv.project_name(path).alias("project_name"), "ts_start", F.coalesce("ts_end", "file_mtime").alias("ts_end"), kind.isNotNull().alias("is_child"), F.lit(None).cast("string").alias("parent_id"), kind.alias("child_type"), "message_count", dv.title("given", "first_prompt").alias("title"), "first_prompt", "model", F.array().cast("array<string>").alias("tool_calls"), "file_path", "file_mtime")


def settings_files(files: DataFrame) -> DataFrame:
    """session_id, folder, model from whole settings files (folder, stem, value); what isn't JSON has no model."""
    return files.select(F.col("stem").alias("session_id"), "folder", get(F.try_parse_json("value"), "$.model").alias("model"))


@F.pandas_udf(StringType())
def rich_text(trees: pd.Series) -> pd.Series:
    """Plain text of trees of nodes: texts depth first, mentions as @name, with spaces between. A helper for one small field, as trees have no bounded depth."""
    import json

    def walk(node: object) -> list[str]:
        if isinstance(node, list):
            return [x for n in node for x in walk(n)]
        if not isinstance(node, dict):
            return []
        kind, out = node.get("type"), []
        if kind == "mention":
            out.append("@" + str(node.get("mentionName") or node.get("name") or node.get("text") or ""))
        elif isinstance(node.get("text"), str):
            out.append(node["text"])
        return out + walk(node.get("children") or node.get("root") or [])

    def text(tree: str | None) -> str | None:
        try:
            return " ".join(x for x in walk(json.loads(tree)) if x.strip()) if tree else None
        except ValueError:
            return tree

    return trees.map(text)


@register
class KeyValues:
    """A table of key and value: `<prefix>:<session>` has the prompt as rich text, `<details>:<session>` the model and last response."""

    name = "kv"

    def __init__(self, table: DataFrame, prefix: str = "composerData", details: str = "sessionDetails") -> None:
        split = table.filter("key is not null").select(F.substring_index("key", ":", 1).alias("prefix"), F.regexp_replace("key", "^[^:]*:", "").alias("id"), F.try_parse_json("value").alias("v"))
        self.prompts = split.filter(F.col("prefix") == prefix).select("id", F.coalesce(get("v", "$.composerData.richText"), get("v", "$.richText")).alias("tree"))
        self.details = split.filter(F.col("prefix") == details).select("id", get("v", "$.model").alias("model"), F.substring(get("v", "$.lastResponse"), 1, 2000).alias("last_response"))

    def sessions(self) -> DataFrame:
        own = self.prompts.withColumn("first_prompt", rich_text("tree")).join(self.details, "id", "left").filter(F.coalesce("first_prompt", F.lit("")) != "")
        path = dv.file_mention_project("tree")
        return own.select("id", F.lit(self.name).alias("harness"), path.alias("project_path"), dv.project_name(path).alias("project_name"), F.lit(False).alias("is_child"), dv.title(F.lit(None).cast("string"), "first_prompt").alias("title"), "first_prompt", "last_response", "model")

    def messages(self) -> DataFrame:
        row = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
        both = F.filter(F.array(row("user", "first_prompt"), row("assistant", "last_response")), lambda x: F.coalesce(x["content"], F.lit("")) != "")
        own = self.sessions().select(F.col("id").alias("session_id"), F.posexplode(both).alias("seq", "x"))
        return own.select("session_id", "seq", F.concat_ws("_", "session_id", "seq").alias("message_id"), "x.role", "x.content", F.lit(None).cast("timestamp").alias("ts"))


@register
class DocumentTree:
    """`message/<session>/<message>.json`, `part/<message>/<part>.json` and `session/**/<session>.json`, or the three kinds of files as read_files() gives them."""

    name = "tree"

    def __init__(self, spark: SparkSession, root: str | None = None, files: dict[str, DataFrame] | None = None) -> None:
        files = files or {kind: read_files(spark, f"{root}/{kind}") for kind in ("message", "part", "session")}
        self.message_files, self.parts, self.meta = (files[kind].withColumn("v", F.try_parse_json("value")).filter("v is not null") for kind in ("message", "part", "session"))

    def messages(self) -> DataFrame:
        text = self.parts.filter(get("v", "$.type") == "text").select(F.col("folder").alias("message_id"), "stem", get("v", "$.text").alias("text")).filter("text is not null")
        joined = text.groupBy("message_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stem", "text"))), lambda x: x["text"]), "\n").alias("content"))
        own = self.message_files.select(F.col("folder").alias("session_id"), F.col("stem").alias("pos"), F.coalesce(get("v", "$.id"), "stem").alias("message_id"), get("v", "$.role").alias("role"), F.timestamp_millis(get("v", "$.time.created", "long")).alias("ts"))
        return numbered(own.join(joined, "message_id", "left").filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != "")))

    def sessions(self) -> DataFrame:
        m = self.message_files
        head = m.groupBy(F.col("folder").alias("id")).agg(last(get("v", "$.modelID"), "stem").alias("model"), first(get("v", "$.path.root"), "stem").alias("root"), first(get("v", "$.path.cwd"), "stem").alias("cwd"), F.timestamp_millis(F.min(get("v", "$.time.created", "long"))).alias("ts_start"), F.timestamp_millis(F.max(F.coalesce(get("v", "$.time.completed", "long"), get("v", "$.time.created", "long")))).alias("ts_end"), F.max("mtime").alias("file_mtime"))
        user = F.col("role") == "user"
        texts = self.messages().groupBy(F.col("session_id").alias("id")).agg(F.coalesce(F.min_by(F.when(user & dv.real_prompt("content"), F.col("content")), F.when(user & dv.real_prompt("content"), F.col("seq"))), F.min_by(F.when(user, F.col("content")), F.when(user, F.col("seq")))).alias("first_prompt"), F.count("*").alias("message_count"))
        meta = self.meta.select(F.col("stem").alias("id"), get("v", "$.parentID").alias("parent_id"), get("v", "$.title").alias("given"), get("v", "$.directory").alias("directory"))
        own = head.join(texts, "id").join(meta, "id", "left")
        path = F.coalesce(F.nullif("directory", F.lit("")), F.nullif("root", F.lit("")), "cwd")
        child = F.col("parent_id").isNotNull()
        return own.select("id", F.lit(self.name).alias("harness"), path.alias("project_path"), dv.project_name(path).alias("project_name"), "ts_start", "ts_end", child.alias("is_child"), "parent_id", F.when(child, dv.child_type("first_prompt")).alias("child_type"), "message_count", F.coalesce(F.nullif("given", F.lit("")), dv.title_of_tree("first_prompt")).alias("title"), "first_prompt", "model", "file_mtime")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """folder, stem, mtime, value of JSON files below a folder, one row each."""
    own = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return own.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("stem"), F.col("_metadata.file_modification_time").alias("mtime"), "value")


def annotation_files(spark: SparkSession, folder: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """session_id (the file's stem), ts, type, value, source from files that are an array or have one as `annotations`; others give nothing."""
    own = (read_files(spark, folder) if files is None else files).select(F.col("stem").alias("session_id"), F.try_parse_json("value").alias("v"))
    items = F.coalesce(get("v", "$", "array<variant>"), get("v", "$.annotations", "array<variant>"))
    rows = own.select("session_id", F.explode(items).alias("x"))
    return rows.select("session_id", F.try_to_timestamp(get("x", "$.ts")).alias("ts"), get("x", "$.type").alias("type"), get("x", "$.value").alias("value"), get("x", "$.source").alias("source"))


def union_sources(sources: list[TranscriptSource], failed: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All sessions and all messages; columns that a source lacks are null.

    With `failed`, a source that can't be read, for instance as its folder is gone, is left out and named there with the
    reason. Bad lines and files within a source never take it down.
    """
    s = m = None
    for x in sources:
        try:
            own = x.sessions(), x.messages()
        except AnalysisException as e:
            if failed is None:
                raise
            failed[x.name] = str(e)
            continue
        s, m = (new if old is None else old.unionByName(new, allowMissingColumns=True) for old, new in zip((s, m), own))
    return s, m


def readable(spark: SparkSession, kinds: dict[str, dict], failed: dict[str, str]) -> list[TranscriptSource]:
    """Sources by name and arguments; those whose folder can't be read are left out and named in `failed`."""
    found = []
    for name, options in kinds.items():
        try:
            found.append(source(name)(spark, **options))
        except AnalysisException as e:
            failed[name] = str(e)
    return found


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc(F.coalesce("ts_end", "ts_start")), "id")
