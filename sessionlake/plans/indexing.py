"""Queries that build and keep tables: sources, stores, incremental and streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators import filters, hierarchy, hybrid, incremental, kept, reindex, search, segments, stats, store, tags, vectors
from sessionlake.operators import chunks as ch
from sessionlake.plans import adapters as ad
from sessionlake.plans.adapters import TOKENS, scratch, sql
from sessionlake.sources import transcripts as src
from sessionlake.streaming import counters

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def lines_of(rows: DataFrame, value: F.Column, folder: F.Column) -> DataFrame:
    """Rows of conversations as lines of a file for each session, with a line that isn't JSON after every tenth."""
    own = rows.select(F.col("conv_id").cast("string").alias("stem"), folder.alias("folder"), F.struct(F.lit(0).alias("block"), F.col("turn").alias("line")).alias("pos"), value.alias("value"))
    broken = own.filter("pos.line % 10 = 0").withColumn("value", F.lit("{broken"))
    both = own.unionByName(broken).withColumns({"file_path": F.concat_ws("/", F.lit("/logs"), "folder", F.concat("stem", F.lit(".jsonl"))), "mtime": F.lit("2024-06-01").cast("timestamp")})
    return both.withColumn("v", F.try_parse_json("value"))


ROUND_TRIP = sql("SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, role, content, ts FROM m WHERE trim(content) <> ''")


def project_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "conversations")
    ts = F.date_format(F.timestamp_seconds(1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    message = F.struct("role", F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("c")))).alias("skip"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    value = F.to_json(F.struct(F.col("role").alias("type"), ts.alias("timestamp"), F.concat(F.lit("/work/proj"), F.col("conv_id") % 7).alias("cwd"), message.alias("message")))
    return lines_of(rows, value, F.lit("-work-x"))


@query(ROUND_TRIP)
def src_jsonl_a(spark, d):
    return src.ProjectLines(spark, lines=project_lines(spark, d)).messages().select("session_id", "seq", "role", "content", *ad.seconds("ts"))


def typed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Odd sessions have events, even ones only response items."""
    rows = ad.table(spark, d, "conversations").filter("role <> 'system'")
    ts = F.date_format(F.timestamp_seconds(1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), F.lit(None).cast("string").alias("role"), F.col("text").alias("message"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"))
    item = F.struct(F.lit("message").alias("type"), "role", F.lit(None).cast("string").alias("message"), F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), "text")).alias("content"))
    odd = F.col("conv_id") % 2 == 1
    value = F.to_json(F.struct(F.when(odd, "event_msg").otherwise("response_item").alias("type"), ts.alias("timestamp"), F.when(odd, event).otherwise(item).alias("payload")))
    return lines_of(rows, value, F.lit("x"))


@query(ROUND_TRIP)
def src_jsonl_b(spark, d):
    return src.TypedLines(spark, lines=typed_lines(spark, d)).messages().select("session_id", "seq", "role", "content", *ad.seconds("ts"))


HEADED = sql("SELECT id::VARCHAR AS id, message_count, 'model' || id % 3 AS model, first_prompt, left(string_split(first_prompt, chr(10))[1], 80) AS title FROM s")


def headed_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines, and the settings beside them."""
    rows = ad.table(spark, d, "conversations")
    value = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    settings = rows.select(F.col("conv_id").cast("string").alias("session_id"), F.lit("p").alias("folder"), F.concat(F.lit("model"), F.col("conv_id") % 3).alias("model")).distinct()
    return lines_of(rows, value, F.lit("p")), settings


@query(HEADED)
def src_jsonl_c(spark, d):
    lines, settings = headed_lines(spark, d)
    return src.HeadedLines(spark, lines=lines, settings=settings).sessions().select("id", "message_count", "model", "first_prompt", "title")


@query(sql("SELECT id::VARCHAR AS id, trim(first_prompt) AS first_prompt, left(last_response, 2000) AS last_response, CASE WHEN last_response IS NOT NULL THEN 'm' END AS model, '/work/p' AS project_path FROM s WHERE trim(first_prompt) <> ''"))
def src_kv(spark, d):
    s = ad.sessions(spark, d).select(F.col("id").cast("string").alias("id"), "first_prompt", "last_response")
    tree = F.to_json(F.struct(F.struct(F.array(F.struct(F.trim("first_prompt").alias("text"), F.lit("/work/p/a.py").alias("fsPath"))).alias("children")).alias("root")))
    prompts = s.select(F.concat(F.lit("composerData:"), "id").alias("key"), F.to_json(F.struct(F.struct(tree.alias("richText")).alias("composerData"))).alias("value"))
    details = s.filter("last_response is not null").select(F.concat(F.lit("sessionDetails:"), "id").alias("key"), F.to_json(F.struct(F.lit("m").alias("model"), F.col("last_response").alias("lastResponse"))).alias("value"))
    other = s.select(F.concat(F.lit("other:"), "id").alias("key"), F.lit("{}").alias("value"))
    return src.KeyValues(prompts.unionByName(details).unionByName(other)).sessions().select("id", "first_prompt", "last_response", "model", "project_path")


def json_files(rows: DataFrame, folder: F.Column, stem: F.Column, value: F.Column) -> DataFrame:
    """Rows as files of a tree, one of ten of which isn't JSON."""
    own = rows.select(folder.cast("string").alias("folder"), stem.cast("string").alias("stem"), F.lit("2024-06-01").cast("timestamp").alias("mtime"), F.to_json(value).alias("value"))
    return own.unionByName(own.filter("xxhash64(folder, stem) % 10 = 0").withColumns({"stem": F.concat("stem", F.lit("x")), "value": F.lit("{broken")}))


def tree_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Conversations as documents: each text in two parts, with a part of another type between them."""
    m = ad.messages(spark, d)
    stem = F.format_string("%09d", "seq")
    message = F.struct(F.col("message_id").alias("id"), "role", F.lit("m1").alias("modelID"), F.struct((F.unix_seconds("ts") * 1000).alias("created")).alias("time"), F.struct(F.concat(F.lit("/work/proj"), F.col("session_id") % 7).alias("root")).alias("path"))
    part = lambda n, kind, text: json_files(m, F.col("message_id"), F.lit(f"p{n}"), F.struct(F.lit(kind).alias("type"), text.alias("text")))
    parts = part(3, "text", F.expr("substring(content, 11)")).unionByName(part(2, "tool", F.lit("no"))).unionByName(part(1, "text", F.substring("content", 1, 10)))
    s = ad.sessions(spark, d)
    meta = json_files(s, F.lit("global"), F.col("id"), F.struct(F.col("parent_id").cast("string").alias("parentID"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("title "), "id")).alias("title")))
    return {"message": json_files(m, F.col("session_id"), stem, message), "part": parts, "session": meta}


TREE = sql("SELECT session_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq, message_id, role, left(content, 10) || chr(10) || substr(content, 11) AS content, ts FROM m")


@query(TREE)
def src_tree_messages(spark, d):
    return src.DocumentTree(spark, files=tree_of(spark, d)).messages().select("session_id", "seq", "message_id", "role", "content", *ad.seconds("ts"))


@query(sql("SELECT id::VARCHAR AS id, 'tree' AS harness, project_path, project_name, parent_id::VARCHAR AS parent_id, is_child, message_count, CASE WHEN id % 2 = 0 THEN 'title ' || id END AS title, 'm1' AS model FROM s"))
def src_tree_sessions(spark, d):
    found = src.DocumentTree(spark, files=tree_of(spark, d)).sessions()
    return found.select("id", "harness", "project_path", "project_name", "parent_id", "is_child", "message_count", F.when(F.col("id").cast("long") % 2 == 0, F.col("title")).alias("title"), "model")


@query(sql("SELECT session_id::VARCHAR AS session_id, ts, type, value, CASE WHEN session_id % 3 = 0 THEN 'hook' END AS source FROM a"))
def src_annotations(spark, d):
    """Files that are arrays, or have one beside the session's id."""
    a = ad.annotations(spark, d)
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "type", "value", F.when(F.col("session_id") % 3 == 0, "hook").alias("source"))
    own = a.groupBy("session_id").agg(F.collect_list(item).alias("annotations"))
    plain = json_files(own.filter("session_id % 2 = 0"), F.lit("f"), F.col("session_id"), F.col("annotations"))
    nested = json_files(own.filter("session_id % 2 = 1"), F.lit("f"), F.col("session_id"), F.struct(F.col("session_id"), F.col("annotations")))
    return src.annotation_files(spark, files=plain.unionByName(nested)).select("session_id", *ad.seconds("ts"), "type", "value", "source")


@query("SELECT (conv_id % 50)::VARCHAR AS id, trim(arg_max(left(text, 30), (conv_id, turn))) AS thread_name FROM conversations WHERE trim(left(text, 30)) <> '' GROUP BY conv_id % 50")
def src_titles(spark, d):
    """An index in which later lines of a session win, but for blank ones."""
    rows = ad.table(spark, d, "conversations")
    line = F.struct((F.col("conv_id") % 50).cast("string").alias("id"), F.concat(F.lit(" "), F.substring("text", 1, 30)).alias("thread_name"))
    lines = rows.select(F.struct("conv_id", "turn").alias("pos"), F.to_json(line).alias("value"))
    blank = rows.select(F.struct((F.col("conv_id") + 1_000_000_000).alias("conv_id"), "turn").alias("pos"), F.to_json(F.struct((F.col("conv_id") % 50).cast("string").alias("id"), F.lit(" ").alias("thread_name"))).alias("value"))
    return src.thread_titles(spark, lines=lines.unionByName(blank).withColumn("v", F.try_parse_json("value")))


@query(sql("SELECT session_id, ts, value, row_number() OVER (PARTITION BY session_id ORDER BY ts, value) AS place FROM a WHERE session_id IN (SELECT id FROM s WHERE harness = 'kv')"))
def annotations_of_sessions(spark, d):
    return tags.annotations_of(ad.annotations(spark, d), ad.sessions(spark, d).filter("harness = 'kv'")).select("session_id", *ad.seconds("ts"), "value", "place")


@query(sql("SELECT message_id, session_id, seq FROM m WHERE session_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def lookup_messages(spark, d):
    """Messages of the sessions that some rows name."""
    keys = ad.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("session_id"))
    return filters.rows_of(ad.messages(spark, d), keys, "session_id", "seq").select("message_id", "session_id", "seq")


@query("SELECT text AS raw, 3 AS result_count FROM benchmark QUALIFY row_number() OVER (ORDER BY item_id DESC) <= 20")
def last_searches(spark, d):
    """A log to which each benchmark text was added as a search, the newest twenty of it."""
    kept = store.Store(spark, scratch(spark))
    log = ad.table(spark, d, "benchmark").select(F.col("text").alias("raw"), F.lit(3).alias("result_count"), F.timestamp_seconds("item_id").alias("at"))
    kept.append("searches", log)
    return hybrid.recent_searches(kept.rows("searches")).select("raw", "result_count")


@query(sql("SELECT session_id, value, ts, 'hook' AS source FROM a WHERE session_id % 2 = 0 UNION ALL SELECT session_id, 'old', 0, 'x' FROM (SELECT DISTINCT session_id FROM a) WHERE session_id % 2 = 1"))
def annotation_sync(spark, d):
    a = ad.annotations(spark, d)
    old = a.select("session_id").distinct().select("session_id", F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("tag").alias("type"), F.lit("old").alias("value"), F.lit("x").alias("source"))
    fresh = a.filter("session_id % 2 = 0").withColumn("source", F.lit(None).cast("string"))
    kept, _ = store.sync_annotations(old, fresh, a.select(F.col("session_id").alias("id")))
    return kept.select("session_id", "value", *ad.seconds("ts"), "source")


@query(sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE harness END AS harness FROM s"))
def upsert_sessions(spark, d):
    s = ad.sessions(spark, d).select("id", "harness")
    return store.upsert(s.filter("id % 5 <> 1 or id % 3 <> 0"), s.filter("id % 3 = 0").withColumn("harness", F.lit("new")), ["id"])


@query(sql("SELECT session_id, seq, CASE WHEN session_id % 2 = 0 THEN 'new' ELSE role END AS role FROM m WHERE session_id % 2 = 1 OR seq < 2"))
def replace_messages(spark, d):
    m = ad.messages(spark, d).select("session_id", "seq", "role")
    return store.replace_by(m, m.filter("session_id % 2 = 0 and seq < 2").withColumn("role", F.lit("new")), "session_id", touched=m.filter("session_id % 2 = 0"))


@query(sql("SELECT 's' AS t, id, CASE WHEN parent_id % 5 = 0 THEN NULL ELSE parent_id END AS parent_id FROM s WHERE id % 5 <> 0 UNION ALL SELECT 'm', session_id, count(*) FROM m WHERE session_id % 5 <> 0 GROUP BY session_id"))
def cascade_delete(spark, d):
    s, m = ad.sessions(spark, d), ad.messages(spark, d)
    left = store.delete_sessions({"sessions": s, "messages": m}, s.filter("id % 5 = 0"))
    return left["sessions"].select(F.lit("s").alias("t"), "id", "parent_id").unionByName(left["messages"].groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("parent_id")).withColumn("t", F.lit("m")))


@query(sql("SELECT id AS session_id, CASE WHEN id % 3 = 0 THEN 'one' ELSE 'two' END || left(md5(first_prompt), 4) AS summary FROM s WHERE first_prompt IS NOT NULL AND id % 4 <> 0"))
def summary_import(spark, d):
    s = ad.sessions(spark, d).filter("first_prompt is not null")
    entry = lambda label: F.struct(F.concat(F.lit(label), F.substring(F.md5("first_prompt"), 1, 4)).alias("summary"), F.lit("h").alias("content_hash"))
    one = s.filter("id % 3 = 0").select(F.lit(1).alias("priority"), F.create_map("id", entry("one")).alias("entries"))
    two = s.select(F.lit(2).alias("priority"), F.create_map("id", entry("two"), F.col("id") + 1_000_000, entry("none")).alias("entries"))
    return store.import_summaries(one.unionByName(two), s, s.filter("id % 4 = 0").select(F.col("id").alias("session_id"))).drop("content_hash")


MANIFEST = """
f AS (SELECT user_id::VARCHAR AS file_path, event_type AS harness, max(epoch(ts)) AS mtime, min(epoch(ts)) AS low, count(*) AS n FROM events GROUP BY user_id, event_type),
k AS (SELECT file_path || harness AS file_path, harness, mtime, low + (mtime - low) * (n % 3) / 2.0 AS indexed_at FROM f WHERE n % 5 <> 0)
"""


def manifest_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each user's events of a type as a file; sessions for those whose number isn't a multiple of five."""
    e = ad.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    own = e.groupBy(F.concat(F.col("user_id").cast("string"), "event_type").alias("file_path"), F.col("event_type").alias("harness")).agg(F.max("t").alias("mtime"), F.min("t").alias("low"), F.count("*").alias("n"))
    known = own.filter("n % 5 <> 0").select("file_path", "harness", F.col("mtime").alias("file_mtime"), (F.col("low") + (F.col("mtime") - F.col("low")) * (F.col("n") % 3) / 2.0).alias("indexed_at"))
    return own.select("file_path", "harness", "mtime"), known


@query("WITH " + MANIFEST.strip() + " SELECT f.file_path || f.harness AS file_path, CASE WHEN k.file_path IS NULL THEN 'new' ELSE 'changed' END AS reason FROM f LEFT JOIN k ON k.file_path = f.file_path || f.harness WHERE k.file_path IS NULL OR f.mtime > k.indexed_at")
def incremental_manifest(spark, d):
    return incremental.changed(*manifest_of(spark, d)).select("file_path", "reason")


@query("WITH " + MANIFEST.strip() + """, b AS (SELECT harness, count(*) FILTER (n % 5 <> 0 OR harness < 'd') < count(*) AS backlog FROM f GROUP BY harness), top AS (SELECT max(mtime) AS t FROM f)
SELECT f.file_path || f.harness AS file_path FROM f JOIN b USING (harness), top LEFT JOIN k ON k.file_path = f.file_path || f.harness WHERE (k.file_path IS NULL AND (backlog OR f.mtime >= t - 172800)) OR f.mtime > k.indexed_at""")
def backlog_bypass(spark, d):
    """Harnesses before `d` have as many sessions as files, though some of those aren't of these files."""
    files, known = manifest_of(spark, d)
    other = files.join(known, "file_path", "left_anti").filter("harness < 'd'").select(F.concat(F.lit("other"), "file_path").alias("file_path"), "harness", F.col("mtime").alias("file_mtime"), F.col("mtime").alias("indexed_at"))
    newest = files.agg(F.max("mtime").alias("t")).first()["t"] or 0.0
    return incremental.changed(files, known.unionByName(other), F.lit(newest - 172_800)).select("file_path")


PARTS = """
mp AS (SELECT id, parent_id IN (SELECT id FROM s) AS linked FROM s),
mc AS (SELECT session_id AS id, count(*) AS n_messages, sum(length(content)) AS n_chars FROM m GROUP BY session_id),
ma AS (SELECT session_id AS id, string_agg(value, ',' ORDER BY value) AS tags FROM a WHERE session_id IN (SELECT id FROM s) GROUP BY session_id)
"""
KEPT = """SELECT id, harness, project_name, message_count, turn_count, CASE WHEN linked THEN parent_id END AS parent_id, n_messages, n_chars, tags,
'Project: ' || project_name || chr(10) || 'Path: ' || project_path || coalesce(chr(10) || 'First prompt: ' || CASE WHEN length(u) > 200 THEN left(u, 200) || '...' ELSE u END, '') AS summary,
count(*) OVER (PARTITION BY project_path) AS in_project
FROM s JOIN mp USING (id) LEFT JOIN mc USING (id) LEFT JOIN ma USING (id) LEFT JOIN (SELECT session_id AS id, arg_min(content, seq) FILTER (role = 'user' AND trim(content) <> '') AS u FROM m GROUP BY session_id) USING (id)"""


def kept_rows(tables: kept.Tables) -> DataFrame:
    """A row a session from all tables that a rebuild keeps."""
    m, c, a, p = (tables.read(n) for n in ("messages", "chunks", "annotations", "projects"))
    of_messages = m.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_messages"), F.sum(F.length("content")).alias("n_chars"))
    summary = c.filter("chunk_type = 'summary'").select(F.col("session_id").alias("id"), F.col("content").alias("summary"))
    tags = a.groupBy(F.col("session_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("tags"))
    out = reindex.sessions(tables).join(of_messages, "id", "left").join(summary, "id", "left").join(tags, "id", "left").join(p.select("project_path", F.col("sessions").alias("in_project")), "project_path", "left")
    return out.select("id", "harness", "project_name", "message_count", "turn_count", "parent_id", "n_messages", "n_chars", "tags", "summary", "in_project")


@query(sql(KEPT, PARTS))
def full_reindex(spark, d):
    """All tables built from sessions and messages, published together and read back."""
    tables = kept.Tables(spark, scratch(spark))
    reindex.full(tables, ad.sessions(spark, d), ad.messages(spark, d), ad.annotations(spark, d))
    return kept_rows(tables)


def older(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """An older state of a tenth of the sessions, and which those are: some had fewer messages, some weren't there, others were, tags were others."""
    m, s, a = ad.messages(spark, d), ad.sessions(spark, d), ad.annotations(spark, d)
    tenth = lambda i: F.col(i) % 10 == 3
    fewer = m.filter(~tenth("session_id") | (F.col("session_id") % 30 != 3) & (F.col("seq") < 2))
    extra = m.filter("session_id % 50 = 0").withColumns({"session_id": -F.col("session_id") - 1, "message_id": F.concat(F.lit("x"), "message_id")})
    then = s.filter(~tenth("id") | (F.col("id") % 30 != 3)).withColumn("harness", F.when(tenth("id"), "old").otherwise(F.col("harness")))
    then = then.withColumns({"project_path": F.when(tenth("id"), "/old").otherwise(F.col("project_path")), "message_count": F.when(tenth("id"), 0).otherwise(F.col("message_count"))})
    then = then.unionByName(s.filter("id % 50 = 0").withColumns({"id": -F.col("id") - 1, "is_child": F.lit(False), "parent_id": F.lit(None).cast("long")}))
    tags_then = a.withColumn("value", F.when(tenth("session_id"), "old").otherwise(F.col("value"))).unionByName(a.filter("session_id % 50 = 0").withColumn("session_id", -F.col("session_id") - 1))
    touched = s.filter(tenth("id")).select("id").unionByName(s.filter("id % 50 = 0").select((-F.col("id") - 1).alias("id")))
    return then, fewer.unionByName(extra), tags_then, touched


@query(sql(KEPT, PARTS))
def incremental_reindex(spark, d):
    """Tables built from an older state, then a tenth of the sessions brought up to date; the others' files stay as they are."""
    tables = kept.Tables(spark, scratch(spark))
    m, s, a = ad.messages(spark, d), ad.sessions(spark, d), ad.annotations(spark, d)
    then, messages, tags_then, touched = older(spark, d)
    reindex.full(tables, then, messages, tags_then, per_bucket=2000)
    reindex.incremental(tables, touched, s.filter("id % 10 = 3"), m, a)
    return kept_rows(tables)


@query(sql("SELECT qid, session_id, doc, round(score, 6) AS score, rank FROM kw WHERE rank <= 10", TOKENS))
def index_refresh(spark, d):
    """A kept index in which every third document was another, every fifth was not yet, and some are gone since; searched after three refreshes and a merge."""
    tables = kept.Tables(spark, scratch(spark))
    docs, build = ad.table(spark, d, "documents"), lambda df: search.build_index(df, "doc_id", "source", ["text"])
    third, fifth = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    gone = docs.filter("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    other = F.when(third, F.concat(F.lit("thing ering pour que "), F.reverse("text"))).otherwise(F.col("text"))
    segments.refresh(tables, "docs", build(docs.filter(~fifth).withColumn("text", other).unionByName(gone)), per_bucket=50_000)
    parts = [third & (F.col("doc_id") % 2 == 0), fifth & ~third, third & (F.col("doc_id") % 2 != 0)]
    for i, part in enumerate(parts):
        segments.refresh(tables, "docs", build(docs.filter(part)), gone.select(F.col("doc_id").alias("doc")) if i == 1 else None, fan=3)
    terms = search.terms_of(ad.searches(spark, d))
    hits = search.scored_docs(segments.kept_index(tables, "docs", terms), terms)
    return search.best_of_sessions(hits, 10).select("qid", "session_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT doc_id AS session_id, doc_id % 3 = 0 AS old, CASE WHEN doc_id % 3 = 0 THEN '1' ELSE array_to_string(list_transform({vectors.LETTERS}, lambda c: length(lower(text)) - length(replace(lower(text), c, ''))), ',') END AS vector FROM documents WHERE text IS NOT NULL""")
def embed_backfill(spark, d):
    """Two of three documents lack a vector, which counts of letters stand for."""
    docs = ad.table(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("session_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"), F.when(F.col("doc_id") % 3 == 0, "old").alias("embedding_model"))
    found = vectors.backfill(own.filter("content is not null"), vectors.letter_embedder, "letters", cut=1 << 30)
    return found.select("session_id", (F.col("embedding_model") == "old").alias("old"), F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def streamed(spark: SparkSession, df: DataFrame, of, mode: str) -> DataFrame:
    """What a streaming job makes of a table that it reads in several batches, as its last state."""
    at, name = scratch(spark), f"stream_{uuid.uuid4().hex[:8]}"
    df.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")

    def publish(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out/{batch}")

    job = of(stream).writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")


def latest(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("x")).select(key, "x.*")


@query(sql("SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS turns, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY session_id"))
def stream_sessions(spark, d):
    rows = streamed(spark, ad.messages(spark, d), counters.session_counts, "update")
    return latest(rows, "session_id").select("session_id", "messages", "turns", *ad.seconds("first_ts", "last_ts"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, d):
    e = ad.table(spark, d, "events").select("event_id", "event_type")
    return latest(streamed(spark, e, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")), "update"), "event_type")


@query(sql("SELECT session_id, arg_min(content, seq) FILTER (role = 'user' AND length(trim(content)) >= 20) AS first_prompt, arg_max(content, seq) FILTER (role = 'assistant' AND trim(content) <> '') AS last_response FROM m GROUP BY session_id"))
def stream_first_last(spark, d):
    return latest(streamed(spark, ad.messages(spark, d), counters.first_last, "update"), "session_id")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    """Events of each type by day; nothing comes too late, as files may come in any order."""
    e = ad.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = streamed(spark, e, lambda s: counters.project_counts(s, ["event_type"], late="36500 days"), "update")
    keyed = rows.select(F.struct(F.unix_seconds("window.start").alias("day"), "event_type").alias("key"), "n", "batch")
    return latest(keyed, "key").select("key.day", "key.event_type", "n")


@query(sql("SELECT DISTINCT message_id FROM m"))
def stream_once(spark, d):
    """Messages of which every second comes twice."""
    m = ad.messages(spark, d).select("message_id", "seq", "ts")
    return streamed(spark, m.unionByName(m.filter("seq % 2 = 0")), lambda s: counters.once(s, late="36500 days"), "append").select("message_id")


@query(sql("SELECT session_id, seq, role, length(content) AS n FROM m UNION ALL SELECT -session_id - 1, seq, 'old', 3 FROM m WHERE session_id % 50 = 0"))
def stream_replace(spark, d):
    """A table of an older state whose sessions a stream replaces; each batch is given twice. Sessions that the stream lacks stay."""
    at, m = scratch(spark), ad.messages(spark, d)
    tables = kept.Tables(spark, f"{at}/tables")
    old = m.withColumns({"role": F.lit("old"), "content": F.lit("old")})
    first = tables.run()
    first.whole("messages", old.filter("seq < 2").unionByName(old.filter("session_id % 50 = 0").withColumn("session_id", -F.col("session_id") - 1)), "session_id", 16)
    first.publish()
    m.repartition(4, "session_id").write.parquet(f"{at}/in")
    sink = counters.session_sink(tables, "messages", "transcripts")

    def twice(rows: DataFrame, batch: int) -> None:
        sink(rows, batch)
        sink(rows, batch)

    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    counters.replace_sessions(stream, twice, f"{at}/checkpoint").awaitTermination()
    return tables.read("messages").select("session_id", "seq", "role", F.length("content").alias("n"))


@query(sql("SELECT id, coalesce(np, parent_id) AS parent_id, is_child OR np IS NOT NULL AS is_child, CASE WHEN np IS NOT NULL THEN coalesce(nt, child_type) ELSE child_type END AS child_type FROM c LEFT JOIN l USING (id)", """
c AS (SELECT *, CASE WHEN is_child THEN 'worker' END AS child_type FROM s),
l AS (SELECT id, id - 1 AS np, CASE WHEN id % 4 <> 3 THEN 'task' END AS nt FROM s WHERE id % 6 = 1 AND id % 5 <> 0 AND id - 1 IN (SELECT id FROM s))"""))
def relink_sessions(spark, d):
    """Links of every sixth session, some without a type, some to a parent that isn't there."""
    s = ad.sessions(spark, d)
    parent = F.when(F.col("id") % 5 == 0, -F.col("id") - 1).otherwise(F.col("id") - 1)
    links = s.filter("id % 6 = 1").select("id", parent.alias("new_parent_id"), F.when(F.col("id") % 4 != 3, "task").alias("new_child_type"))
    return hierarchy.relink(s, links).select("id", "parent_id", "is_child", "child_type")


@query(sql("SELECT session_id, type, value, 'hook' AS source FROM a UNION ALL SELECT max(session_id), 'tag', 'kept', 'manual' FROM a HAVING count(*) > 0"))
def annotation_append(spark, d):
    """One more annotation, of the newest session that has any."""
    a = ad.annotations(spark, d)
    newest = a.agg(F.max("session_id")).first()[0]
    return (a if newest is None else store.append_annotation(a, str(newest), "tag", "kept")).select("session_id", "type", "value", "source")


@query("WITH " + MANIFEST.strip() + """, top AS (SELECT max(mtime) AS t FROM f), n AS (SELECT f.file_path || f.harness AS file_path, mtime FROM f, top WHERE mtime > t - 172800)
SELECT file_path, round(mtime, 3) AS mtime FROM n UNION ALL SELECT 'next', round(max(mtime), 3) FROM n""")
def high_water(spark, d):
    """Files changed after a mark two days before the newest, and the next mark."""
    files, _ = manifest_of(spark, d)
    newest = files.agg(F.max("mtime").alias("t")).first()["t"] or 0.0
    fresh, mark = incremental.newer_than(files, F.lit(newest - 172_800))
    both = fresh.select("file_path", "mtime").unionByName(fresh.agg(mark.alias("mtime")).select(F.lit("next").alias("file_path"), "mtime"))
    return both.select("file_path", F.round("mtime", 3).alias("mtime"))
