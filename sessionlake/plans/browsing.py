"""Queries over sessions as they are: derived fields, hierarchy, roll-ups, tags, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlake.functions import derive as dv
from sessionlake.functions.text import clean_snippet, estimate_tokens, preview
from sessionlake.operators import chunks, filters, hierarchy, stats, tags, transcripts
from sessionlake.plans import adapters as ad
from sessionlake.plans.adapters import sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT session_id, first_prompt, last_prompt, last_response, message_count, turn_count, ts_first, ts_last FROM p"))
def session_prompts(spark, d):
    return stats.prompts(ad.messages(spark, d)).select("session_id", "first_prompt", "last_prompt", "last_response", "message_count", "turn_count", *ad.seconds("ts_first", "ts_last"))


@query(sql("""SELECT id, left(string_split(first_prompt, chr(10))[1], 80) AS title, CASE WHEN length(first_prompt) > 200 THEN left(first_prompt, 200) || '...' ELSE first_prompt END AS first_preview,
CASE WHEN length(last_response) > 500 THEN left(last_response, 500) || '...' ELSE last_response END AS last_preview, left(md5(left(coalesce(first_prompt, ''), 500) || '|' || left(coalesce(last_response, ''), 500)), 12) AS content_hash,
CASE WHEN length(first_prompt) > 80 THEN left(replace(first_prompt, chr(10), ' '), 77) || '...' ELSE replace(coalesce(first_prompt, '(no description)'), chr(10), ' ') END AS display, coalesce(ts_end, ts_start) AS ts_eff FROM s"""))
def session_derive(spark, d):
    s = ad.sessions(spark, d)
    return s.select("id", dv.title("title", "first_prompt").alias("title"), preview("first_prompt", 200).alias("first_preview"), preview("last_response", 500).alias("last_preview"), dv.content_hash("first_prompt", "last_response").alias("content_hash"), dv.display(F.lit(None).cast("string"), "first_prompt", "title").alias("display"), *ad.seconds("ts_eff"))


@query(r"""SELECT doc_id, contains(text, '```') OR contains(text, 'def ') OR contains(text, 'function ') AS has_code, length(text) // 4 AS tokens,
array_to_string(list_sort(list_distinct(regexp_extract_all(replace(text, ' the ', ' agent-do  '), 'agent-do\s+([0-9A-Za-z_]+)', 1))), ',') AS tools,
CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 240 THEN rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 237)) || '...' ELSE nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') END AS snippet FROM documents""")
def message_derive(spark, d):
    """Each ` the ` stands for the runner of tools."""
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", dv.has_code("text").alias("has_code"), estimate_tokens("text").alias("tokens"), F.array_join(dv.tool_mentions(F.replace("text", F.lit(" the "), F.lit(" agent-do  "))), ",").alias("tools"), clean_snippet("text").alias("snippet"))


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'system-notification' WHEN 1 THEN 'compaction-context' WHEN 2 THEN 'ci-dispatch' WHEN 3 THEN 'ci-dispatch' WHEN 4 THEN 'subagent-continuation' ELSE '' END AS label,
CASE doc_id % 9 WHEN 0 THEN 'system-notification' WHEN 1 THEN 'compaction-context' WHEN 2 THEN 'ci-dispatch' WHEN 3 THEN 'ci-dispatch' WHEN 4 THEN 'subagent-continuation'
  WHEN 5 THEN 'torus-loop' WHEN 6 THEN 'worker' WHEN 7 THEN 'explore-1' ELSE CASE WHEN doc_id % 2 = 0 THEN 'torusv3-worker-' || doc_id % 5 ELSE '' END END AS worker,
CASE doc_id % 9 WHEN 5 THEN 'prometheus' WHEN 6 THEN 'single-task' ELSE 'worker' END AS child FROM documents""")
def session_classes(spark, d):
    """Classes of prompts that begin as the document's number says and go on with its text."""
    heads = ["  <system-notification> ", "[COMPACTION CONTEXT] ", "GT Prime ", "a Polecat dispatched this ", "Summarize the task tool output above ", "Torus Loop prometheus ", "# Worker Prompt single task only ", 'subagent_type: "explore-1" ', ""]
    docs = ad.table(spark, d, "documents")
    prompt = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 9 + 1).cast("int")), F.col("text"))
    folder = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/x/TorusV3-workers/worker-"), F.col("doc_id") % 5)).otherwise("/x")
    own = docs.select("doc_id", prompt.alias("prompt"), F.when(F.col("doc_id") % 9 == 8, folder).otherwise("/y").alias("folder"))
    return own.select("doc_id", dv.automation_class("prompt").alias("label"), dv.worker_class("prompt", "folder").alias("worker"), dv.child_type("prompt").alias("child"))


@query("SELECT event_id, text_ AS content FROM (SELECT event_id, props, event_type || ' (tool_result: ' || left(props, 50) || '...)' AS text_ FROM events)")
def content_flatten(spark, d):
    """Each event as a content list of a text and a tool result."""
    own = ad.table(spark, d, "events").withColumn("v", F.try_parse_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("content")), F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.col("props").alias("content"))))))
    return own.select("event_id", dv.flatten_content(F.col("v")).alias("content"))


@query(sql("SELECT harness, count(*) AS sessions, count(*) FILTER (NOT is_child) AS parents, count(*) FILTER (is_child) AS children FROM s GROUP BY harness"))
def harness_stats(spark, d):
    return stats.by_harness(ad.sessions(spark, d))


@query(sql("SELECT (SELECT count(*) FROM s) AS sessions, (SELECT count(*) FROM s WHERE NOT is_child) AS parents, (SELECT count(*) FROM s WHERE is_child) AS children, (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0) AS embedded"))
def db_overview(spark, d):
    return stats.overview(ad.sessions(spark, d), ad.messages(spark, d), ad.chunks(spark, d).withColumn("embedding", F.when(F.col("chunk_index") % 3 != 0, F.col("embedding"))))


@query(sql("""SELECT project_path, count(*) AS sessions, count(*) FILTER (NOT is_child) AS parents, count(*) FILTER (is_child) AS children, min(ts_start) AS first_ts, max(ts_start) AS last_ts, sum(message_count)::BIGINT AS messages,
arg_min(project_name, ts_start) AS project_name, (SELECT string_agg(harness || '=' || n, ',' ORDER BY harness) FROM (SELECT harness, count(*) AS n FROM s t WHERE t.project_path = s.project_path GROUP BY harness)) AS harness_counts FROM s GROUP BY project_path"""))
def project_stats(spark, d):
    counts = F.array_join(F.transform(F.map_entries("harness_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return stats.project_stats(ad.sessions(spark, d)).select("project_path", "sessions", "parents", "children", *ad.seconds("first_ts", "last_ts"), "messages", "project_name", counts.alias("harness_counts"))


@query(sql("SELECT project_path, count(*) AS sessions FROM s GROUP BY project_path ORDER BY sessions DESC, project_path LIMIT 20"))
def top_projects(spark, d):
    return stats.project_stats(ad.sessions(spark, d)).select("project_path", "sessions").orderBy(F.desc("sessions"), "project_path").limit(20)


@query(sql("SELECT project_path, value, n, place FROM (SELECT project_path, value, n, row_number() OVER (PARTITION BY project_path ORDER BY n DESC, value) AS place FROM (SELECT project_path, value, count(*) AS n FROM (SELECT DISTINCT session_id, value FROM a) JOIN s ON id = session_id GROUP BY project_path, value)) WHERE place <= 10"))
def project_top_tags(spark, d):
    return stats.top_tags(ad.annotations(spark, d), ad.sessions(spark, d))


@query(sql("SELECT value, count(*) AS n FROM a GROUP BY value"))
def tag_counts(spark, d):
    return tags.tag_counts(ad.annotations(spark, d))


@query(sql("SELECT DISTINCT session_id FROM a WHERE value = 'toxic'"))
def sessions_by_tag(spark, d):
    return tags.sessions_with_tag(ad.annotations(spark, d), "toxic")


@query(sql("SELECT session_id, value, ts FROM a WHERE value ILIKE '%OXI%'"))
def annotation_search(spark, d):
    return tags.annotation_search(ad.annotations(spark, d), "OXI").select("session_id", "value", *ad.seconds("ts"))


WORD = lambda p: rf"(^|[^\p{{L}}\p{{N}}_])(?:{p})($|[^\p{{L}}\p{{N}}_])"


@query(rf"""WITH t AS (SELECT doc_id, source, regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') AS text FROM documents),
x AS (SELECT doc_id, 'the' AS tag, 0 AS r, 1.0 * len(regexp_extract_all(text, '{WORD("the")}')) AS score FROM t UNION ALL SELECT doc_id, 'thing', 1, 2.0 * len(regexp_extract_all(text, '{WORD("thing|rest")}')) FROM t
  UNION ALL SELECT doc_id, 'versions', 2, CASE WHEN regexp_matches(text, '{WORD("version|test|that")}') THEN 1.5 ELSE 0 END FROM t UNION ALL SELECT doc_id, 'project:' || source, 3, 0.5 FROM t)
SELECT doc_id AS session_id, tag, score::DOUBLE AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r, tag) AS place FROM x WHERE score > 0) WHERE place <= 15""")
def session_tags(spark, d):
    """Rules of our own on documents, in which words of technologies are rare."""
    docs = ad.table(spark, d, "documents")
    rules = [(r"\bthe\b", "the", 1.0, "each"), (r"\b(thing|rest)\b", "thing", 2.0, "each"), (r"\b(version|test|that)\b", "versions", 1.5, "once")]
    own = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("project_name"), F.lit("").alias("harness"))
    return tags.session_tags(docs.select(F.col("doc_id").alias("session_id"), "text"), own, rules)


def rule_sql() -> str:
    """Scores of the standard rules on tx (session_id, text): session_id, tag, score, r."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = lambda p: f"len(regexp_extract_all(text, {quoted('(?i)' + p)}))"
    plain, captured = [], []
    for r, (pattern, tag, weight, how) in enumerate(tags.RULES):
        if "{0}" in tag:
            captured.append(f"SELECT session_id, replace({quoted(tag)}, '{{0}}', lower(unnest(regexp_extract_all(text, {quoted('(?i)' + pattern)}, 1)))) AS tag, {weight}::DOUBLE AS score, {r} AS r FROM tx")
        else:
            plain.append(f"{{'tag': {quoted(tag)}, 'score': ({found(pattern)} * {weight})::DOUBLE, 'r': {r}}}" if how == "each" else f"{{'tag': {quoted(tag)}, 'score': (CASE WHEN {found(pattern)} > 0 THEN {weight} ELSE 0 END)::DOUBLE, 'r': {r}}}")
    return "SELECT session_id, x.tag, x.score, x.r FROM (SELECT session_id, unnest([" + ", ".join(plain) + "]) AS x FROM tx) WHERE x.score > 0 UNION ALL " + " UNION ALL ".join(captured)


# Letters outside ASCII stand as underscores, which are parts of words too, as SQL's patterns know words of ASCII alone.
TAGGED = rf"""
tx AS (SELECT id AS session_id, regexp_replace(concat_ws(' ', nullif(first_prompt, ''), nullif(last_prompt, ''), nullif(last_response, ''), body), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g') AS text FROM s LEFT JOIN (SELECT session_id AS id, string_agg(content, ' ' ORDER BY seq) AS body FROM m GROUP BY session_id) USING (id)),
tr AS ({rule_sql()}),
tt AS (SELECT session_id, tag, sum(score) AS score, min(r) AS r FROM tr GROUP BY session_id, tag UNION ALL SELECT id, 'project:' || lower(project_name), 0.5, 1000 FROM s UNION ALL SELECT id, 'harness:' || lower(harness), 0.5, 1001 FROM s)
"""


@query(sql("SELECT session_id, tag, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, r, tag) AS place FROM tt QUALIFY place <= 15", TAGGED))
def session_tags_standard(spark, d):
    """The standard rules on sessions' texts."""
    s = ad.sessions(spark, d)
    return tags.session_tags(tags.session_text(s, ad.messages(spark, d)), s)


@query(sql("SELECT p.id AS parent_id, c.id AS child_id FROM s c JOIN s p ON c.parent_id = p.id AND c.harness = p.harness WHERE c.is_child UNION ALL SELECT -p.id, c.id FROM s c JOIN s p ON c.parent_id = p.id WHERE c.is_child"))
def children_explicit(spark, d):
    s = ad.sessions(spark, d)
    same = s.withColumn("harness", F.lit("x"))
    return hierarchy.explicit_children(s).drop("ts").unionByName(hierarchy.explicit_children(same).select((-F.col("parent_id")).alias("parent_id"), "child_id"))


NEAR = """
ex AS (SELECT p.id AS parent_id, c.id AS child_id FROM s c JOIN s p ON c.parent_id = p.id AND c.harness = p.harness WHERE c.is_child),
ne AS (SELECT p.id AS parent_id, c.id AS child_id FROM s c JOIN s p ON c.harness = p.harness AND c.project_path = p.project_path AND abs(c.ts_eff - p.ts_end) < CASE WHEN c.harness = 'tree' THEN 400 ELSE 200 END * 3600
       WHERE c.is_child AND NOT p.is_child AND p.id NOT IN (SELECT parent_id FROM ex)),
ch AS (SELECT *, 'explicit' AS link FROM ex UNION ALL SELECT *, 'near' FROM ne)
"""


@query(sql("SELECT * FROM ch", NEAR))
def children_heuristic(spark, d):
    return hierarchy.all_children(ad.sessions(spark, d), 200, {"tree": 400}).drop("ts")


@query(sql("SELECT parent_id, count(*) AS n_children FROM ch GROUP BY parent_id", NEAR))
def child_counts(spark, d):
    return hierarchy.child_counts(ad.sessions(spark, d), 200, {"tree": 400})


@query(sql("SELECT parent_id, child_id FROM ch WHERE child_id IN (SELECT id FROM s WHERE length(last_response) > 300)", NEAR))
def matched_children(spark, d):
    s = ad.sessions(spark, d)
    return hierarchy.matched_children(hierarchy.all_children(s, 200, {"tree": 400}), s.filter(F.length("last_response") > 300).select(F.col("id").alias("session_id"))).select("parent_id", "child_id")


@query(sql("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE parent_id END AS parent_id, is_child OR (id % 3 <> 0 AND parent_id IS NOT NULL) AS is_child FROM s"))
def parent_backfill(spark, d):
    s = ad.sessions(spark, d)
    return hierarchy.with_known_parents(s.withColumn("parent_id", F.when(F.col("id") % 3 == 0, F.lit(-5)).otherwise(F.col("parent_id")))).select("id", "parent_id", "is_child")


@query("""SELECT DISTINCT a.event_id AS parent_id, b.event_id AS child_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id
WHERE CASE WHEN a.event_id % 10 = 0 THEN epoch(b.ts) >= epoch(a.ts) - 7200 ELSE abs(epoch(a.ts) - epoch(b.ts)) < 3600 END""")
def task_proximity_join(spark, d):
    """Events as tasks of their user; every tenth has no time of its own."""
    e = ad.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    user = F.col("user_id").cast("string")
    tasks = e.select(F.col("event_id").alias("parent_id"), user.alias("harness"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("invoked"), user.alias("project_path"), F.col("ts").alias("parent_changed"))
    children = e.select(F.col("event_id").alias("id"), user.alias("harness"), F.col("event_type").alias("child_type"), F.col("ts").alias("created"), F.col("ts").alias("changed"), user.alias("project_path"))
    return hierarchy.task_children(tasks, children, 3600)


@query(sql("SELECT session_id, count(*) FILTER (content <> '' AND seq % 3 <> 0) AS filled, count(*) AS n, count(*) FILTER (content <> '' AND seq % 3 <> 0) > 0.5 * count(*) AS trusted FROM m GROUP BY session_id"))
def coverage_ratio(spark, d):
    return stats.coverage(ad.messages(spark, d).withColumn("content", F.when(F.col("seq") % 3 != 0, F.col("content"))))


@query(sql("SELECT id AS session_id, 0 AS seq, 'user' AS role, first_prompt AS content FROM s WHERE id % 2 = 0 AND first_prompt <> '' UNION ALL SELECT id, CASE WHEN coalesce(first_prompt, '') = '' THEN 0 ELSE 1 END, 'assistant', last_response FROM s WHERE id % 2 = 0 AND last_response <> ''"))
def synthetic_messages(spark, d):
    return stats.synthetic_messages(ad.sessions(spark, d), ad.messages(spark, d).filter("session_id % 2 = 1"))


@query(sql("SELECT id FROM s WHERE NOT is_child AND first_prompt <> '' AND id % 6 <> 0 AND id IN (SELECT session_id FROM m WHERE role = 'assistant' AND content <> '')"))
def needing_summary(spark, d):
    s = ad.sessions(spark, d)
    return stats.needing_summary(s, s.filter("id % 6 = 0").select(F.col("id").alias("session_id")), ad.messages(spark, d)).select("id")


@query(sql("SELECT id, CASE WHEN id % 2 = 0 THEN left(md5(first_prompt), 6) END AS summary, ts_start FROM s"))
def session_list_summaries(spark, d):
    s = ad.sessions(spark, d)
    summaries = s.filter("id % 2 = 0").select("id", F.substring(F.md5("first_prompt"), 1, 6).alias("summary"))
    return filters.session_list(s.join(summaries, "id", "left"), None).select("id", "summary", *ad.seconds("ts_start"))


@query(sql("SELECT id, is_child, ts_eff FROM s"))
def session_browse(spark, d):
    s = ad.sessions(spark, d)
    return filters.resort(s.withColumns({"score": F.lit(1.0), "session_id": F.col("id")}), "newest").select("id", "is_child", *ad.seconds("ts_eff"))


@query(sql(r"""SELECT session_id, string_agg(CASE WHEN 3000 - before >= length(t) THEN t ELSE left(t, (3000 - before)::INT) || '...' END, chr(10) || chr(10) ORDER BY seq) AS transcript FROM (
SELECT session_id, seq, t, coalesce(sum(length(t)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT session_id, seq, '[' || upper(role) || ']: ' || content AS t FROM m WHERE content <> ''))
WHERE 3000 - before >= length(t) OR 3000 - before > 200 GROUP BY session_id"""))
def char_budget_transcript(spark, d):
    return transcripts.budgeted(ad.messages(spark, d), 3000)


@query(sql(r"""SELECT session_id, inner_ AS "inner", arg_min(message_id, seq) AS message_id, string_agg(line, chr(10) || chr(10) ORDER BY seq) AS content, sum(t)::INT AS token_count FROM (
SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) - 1 AS inner_ FROM r) GROUP BY session_id, inner_""", r"""
l AS (SELECT session_id, seq, message_id, '[' || role || ']: ' || content AS line, length('[' || role || ']: ' || content) // 4 AS t, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM m),
r0 AS (SELECT 1)""").replace("WITH ", "WITH RECURSIVE ", 1).replace("r0 AS (SELECT 1)", """r AS (SELECT session_id, seq, message_id, line, t, k, t AS total, true AS fresh FROM l WHERE k = 1
  UNION ALL SELECT l.session_id, l.seq, l.message_id, l.line, l.t, l.k, CASE WHEN r.total + l.t > 150 THEN l.t ELSE r.total + l.t END, r.total + l.t > 150 FROM r JOIN l ON l.session_id = r.session_id AND l.k = r.k + 1)"""))
def turn_chunks(spark, d):
    return chunks.turn_chunks(ad.messages(spark, d), 150).drop("chunk_type")


@query(sql(r"""SELECT id AS session_id, 'Project: ' || project_name || chr(10) || 'Path: ' || project_path || coalesce(chr(10) || 'First prompt: ' || CASE WHEN length(u) > 200 THEN left(u, 200) || '...' ELSE u END, '') || coalesce(chr(10) || 'Tools used: ' || nullif(tools, ''), '') AS content
FROM s LEFT JOIN (SELECT session_id, arg_min(content, seq) FILTER (role = 'user' AND trim(content) <> '') AS u, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(content, 'the\s+(\S+)', 1))))), ', ') AS tools FROM m GROUP BY session_id) ON session_id = id"""))
def summary_chunks(spark, d):
    """`the` stands for the runner of tools."""
    return chunks.summary_chunks(ad.sessions(spark, d), ad.messages(spark, d), "the").select("session_id", "content")


@query(sql(r"SELECT session_id, count(*) AS n FROM (SELECT session_id, unnest(regexp_extract_all(content, 'the\s+(\S+)(?:\s+([^\n]+?))?(?:\n|$)')) FROM m) GROUP BY session_id"))
def tool_chunk_counts(spark, d):
    return chunks.tool_chunks(ad.messages(spark, d), "the").groupBy("session_id").agg(F.count("*").alias("n"))


@query(None)
def all_chunks(spark, d):
    return chunks.all_chunks(ad.sessions(spark, d), ad.messages(spark, d), runner="the")
