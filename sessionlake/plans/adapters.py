"""The test tables as messages, sessions, annotations, chunks and queries; the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.text import STEP_2, STEP_3, STEP_4, STOP_WORDS
from sessionlake.operators.packing import scratch
from sessionlake.operators.stats import prompts

HARNESSES = ["jsonl-a", "jsonl-b", "jsonl-c", "kv", "tree"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    ts = F.timestamp_seconds(1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return table(spark, d, "conversations").filter("role in ('user', 'assistant')").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.concat_ws("_", "conv_id", "turn").alias("message_id"), "role", F.col("text").alias("content"), ts.alias("ts"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("session_id")
    start = 1704067200 + i * 3600
    own = prompts(messages(spark, d)).select(
        i.alias("id"), F.element_at(F.array(*map(F.lit, HARNESSES)), (i % 5 + 1).cast("int")).alias("harness"), F.concat(F.lit("proj"), i % 7).alias("project_name"), F.concat(F.lit("/work/proj"), i % 7).alias("project_path"),
        F.timestamp_seconds(start).alias("ts_start"), F.timestamp_seconds(start + F.col("message_count") * 60).alias("ts_end"), (i % 4 == 3).alias("is_child"), F.when(i % 4 == 3, i - 1).alias("parent_id"),
        F.when(i % 4 == 3, "worker").alias("child_type"), F.lit(None).cast("string").alias("title"), "first_prompt", "last_prompt", "last_response", "message_count", "turn_count",
    )
    return own.withColumn("ts_eff", F.coalesce("ts_end", "ts_start"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    tags = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda t: t.isNotNull())
    return table(spark, d, "labels").select(F.col("doc_id").alias("session_id"), F.timestamp_seconds(1704067200 + F.col("doc_id") * 60).alias("ts"), F.lit("tag").alias("type"), F.explode(tags).alias("value"), F.lit("hook").alias("source"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("session_id"), F.col("vec_id").alias("chunk_index"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector asks."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


#: Searches over documents beside the benchmark's texts; one term is a stop word alone, one query has nothing else.
SEARCHES = [(1, "thing ering"), (2, "the tion"), (3, "Pour, que"), (4, "the")]


def searches(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame(SEARCHES, "qid int, text string")
    return own.unionByName(table(spark, d, "benchmark").select((F.col("item_id") + 100).cast("int").alias("qid"), "text"))


VIEWS = """
m AS (SELECT conv_id AS session_id, turn AS seq, conv_id || '_' || turn AS message_id, role, text AS content, 1704067200 + conv_id * 3600 + turn * 60 AS ts
      FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT session_id,
        coalesce(arg_min(content, seq) FILTER (role = 'user' AND length(trim(content)) >= 20), arg_min(content, seq) FILTER (role = 'user')) AS first_prompt,
        arg_max(content, seq) FILTER (role = 'user') AS last_prompt,
        coalesce(arg_max(content, seq) FILTER (role = 'assistant' AND trim(content) <> ''), arg_max(content, seq) FILTER (role = 'assistant')) AS last_response,
        count(*) AS message_count, count(*) FILTER (role = 'user') AS turn_count, min(ts) AS ts_first, max(ts) AS ts_last FROM m GROUP BY session_id),
s AS (SELECT session_id AS id, ['jsonl-a', 'jsonl-b', 'jsonl-c', 'kv', 'tree'][session_id % 5 + 1] AS harness, 'proj' || (session_id % 7) AS project_name, '/work/proj' || (session_id % 7) AS project_path,
        1704067200 + session_id * 3600 AS ts_start, 1704067200 + session_id * 3600 + message_count * 60 AS ts_end, 1704067200 + session_id * 3600 + message_count * 60 AS ts_eff,
        session_id % 4 = 3 AS is_child, CASE WHEN session_id % 4 = 3 THEN session_id - 1 END AS parent_id, first_prompt, last_prompt, last_response, message_count, turn_count FROM p),
a AS (SELECT doc_id AS session_id, 1704067200 + doc_id * 60 AS ts, 'tag' AS type, 'quality' AS value FROM labels WHERE quality = 1
      UNION ALL SELECT doc_id, 1704067200 + doc_id * 60, 'tag', 'toxic' FROM labels WHERE toxic = 1),
qs AS (SELECT * FROM (VALUES (1, 'thing ering'), (2, 'the tion'), (3, 'Pour, que'), (4, 'the')) t(qid, text) UNION ALL SELECT (100 + item_id)::INT, text FROM benchmark),
q AS (SELECT qid, unnest(terms) AS term, len(terms) AS n_terms FROM (SELECT qid, list_distinct(CASE WHEN len(kept) < 2 AND len(words) >= 2 THEN words ELSE kept END) AS terms
      FROM (SELECT qid, words, list_filter(words, lambda w: NOT list_contains(STOP_WORDS, w)) AS kept FROM (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM qs))))
""".replace("STOP_WORDS", str(STOP_WORDS))


TOKENS = r"""
tok AS (SELECT doc_id AS doc, source AS session_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
len AS (SELECT doc, session_id, len(words) AS length FROM tok),
post AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(words) AS term FROM tok) GROUP BY term, doc),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
corpus AS (SELECT count(*) AS n_docs, avg(length) AS avg_len FROM len),
hit AS (SELECT qid, doc, session_id, count(*) AS found, any_value(n_terms) AS n_terms,
          sum(CASE WHEN n_docs - df + 0.5 > df + 0.5 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))) AS score
        FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc), corpus GROUP BY qid, doc, session_id),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, session_id ORDER BY score DESC, doc) AS k FROM hit WHERE found = n_terms),
kw AS (SELECT qid, session_id, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_id) AS rank FROM best WHERE k = 1)
"""


def stem_sql(words: str, out: str) -> str:
    """Common tables that end in `out` (term, stem) for a query of terms: Porter's steps over strings of c and v, for consonants and vowels."""
    cv = lambda w: f"list_reduce(string_split({w}, ''), lambda a, x: a || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN x = 'y' AND right(a, 1) = 'c' THEN 'v' ELSE 'c' END, '')"
    measure = lambda c: f"len(regexp_extract_all({c}, 'v+c'))"
    cut = lambda x, n: f"left({x}, greatest(length({x}) - {n}, 0))"
    double = lambda w, c: f"(length({w}) > 1 AND right({w}, 1) = {w}[-2:-2] AND right({c}, 1) = 'c')"
    cvc = lambda w, c: f"(right({c}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"
    step = lambda name, before, w: f"{out}{name} AS (SELECT term, w, {cv('w')} AS c FROM (SELECT term, {w} AS w FROM {out}{before}))"
    longest = lambda ends: "coalesce(list_filter([" + ", ".join(f"'{e}'" for e in sorted(ends, key=len, reverse=True)) + "], lambda e: ends_with(w, e))[1], '')"
    replaced = lambda table: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
    swap = lambda table: f"CASE WHEN {longest(table)} <> '' AND {measure(f'left(c, length(w) - length({longest(table)}))')} > 0 THEN left(w, length(w) - length({longest(table)})) || {replaced(table)}[{longest(table)}] ELSE w END"
    stem = "CASE WHEN ends_with(w, 'ed') AND contains(" + cut("c", 2) + ", 'v') THEN 2 WHEN ends_with(w, 'ing') AND contains(" + cut("c", 3) + ", 'v') THEN 3 ELSE 0 END"
    x, xc = "left(w, length(w) - k)", "left(c, length(w) - k)"
    four = longest(STEP_4)
    before_four = f"left(w, length(w) - length({four}))"
    return ",\n".join([
        f"{out}0 AS (SELECT DISTINCT term, term AS w FROM ({words}) WHERE regexp_matches(term, '^[a-z]{{3,}}$'))",
        step("1", "0", f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 1)} ELSE w END"),
        f"{out}2a AS (SELECT *, CASE WHEN ends_with(w, 'eed') THEN 0 ELSE {stem} END AS k FROM {out}1)",
        step("2", "2a", f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measure(cut('c', 3))} > 0 THEN {cut('w', 1)} ELSE w END WHEN k = 0 THEN w WHEN right({x}, 2) IN ('at', 'bl', 'iz') THEN {x} || 'e' WHEN {double('(' + x + ')', '(' + xc + ')')} AND right({x}, 1) NOT IN ('l', 's', 'z') THEN left(w, length(w) - k - 1) WHEN {measure(xc)} = 1 AND {cvc(x, xc)} THEN {x} || 'e' ELSE {x} END"),
        step("3", "2", f"CASE WHEN ends_with(w, 'y') AND contains({cut('c', 1)}, 'v') THEN {cut('w', 1)} || 'i' ELSE w END"),
        step("4", "3", swap(STEP_2)),
        step("5", "4", swap(STEP_3)),
        step("6", "5", f"CASE WHEN {four} <> '' AND {measure(f'left(c, length(w) - length({four}))')} > 1 AND ({four} <> 'ion' OR right({before_four}, 1) IN ('s', 't')) THEN {before_four} ELSE w END"),
        step("7", "6", f"CASE WHEN ends_with(w, 'e') AND ({measure(cut('c', 1))} > 1 OR ({measure(cut('c', 1))} = 1 AND NOT {cvc(cut('w', 1), cut('c', 1))})) THEN {cut('w', 1)} ELSE w END"),
        f"{out} AS (SELECT term, CASE WHEN {measure('c')} > 1 AND {double('w', 'c')} AND ends_with(w, 'l') THEN {cut('w', 1)} ELSE w END AS stem FROM {out}7 UNION ALL SELECT DISTINCT term, term FROM ({words}) WHERE NOT regexp_matches(term, '^[a-z]{{3,}}$'))",
    ])


def sql(body: str, *more: str) -> str:
    """A query with VIEWS and more common tables before it."""
    return "WITH " + ",\n".join([VIEWS.strip(), *more]) + "\n" + body


def seconds(*names: str) -> list:
    """Times as whole seconds, which both engines write alike."""
    return [F.unix_seconds(n).alias(n) for n in names]
