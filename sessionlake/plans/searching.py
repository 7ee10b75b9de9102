"""Queries that search: terms and filters of queries, keyword, vector and hybrid ranking, scans."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from sessionlake.functions import queries as fq
from sessionlake.functions.text import STOP_WORDS, query_terms, stems, tokens
from sessionlake.operators import filters, hierarchy, hybrid, needles, search, segments, transcripts, vectors
from sessionlake.operators.kept import Tables
from sessionlake.plans import adapters as ad
from sessionlake.plans.adapters import TOKENS, sql, stem_sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def index_of(spark, d, **options):
    return search.build_index(ad.table(spark, d, "documents"), "doc_id", "source", ["text"], **options)


@query(sql("SELECT qid, session_id, doc, round(score, 6) AS score, rank FROM kw WHERE rank <= 10", TOKENS))
def fts_message_search(spark, d):
    """An index that is kept, then asked."""
    tables, terms = Tables(spark, ad.scratch(spark)), search.terms_of(ad.searches(spark, d))
    segments.refresh(tables, "docs", index_of(spark, d))
    hits = search.scored_docs(segments.kept_index(tables, "docs", terms), terms)
    return search.best_of_sessions(hits, 10).select("qid", "session_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id % 20 = 0),
z AS (SELECT doc_id AS qid, unnest(list_distinct([w[1], w[len(w) // 2 + 1]])) AS term FROM w WHERE w[1] <> ''), zq AS (SELECT qid, term, count(*) OVER (PARTITION BY qid) AS n_terms FROM z),
""" + TOKENS.strip().replace("FROM q JOIN", "FROM zq JOIN") + " SELECT qid, session_id, doc, round(score, 6) AS score, rank FROM kw WHERE rank <= 5")
def fts_top_by_blocks(spark, d):
    """Two words of every twentieth document, whatever they are, asked of a kept index of which only blocks that can hold one of the five best sessions are scored."""
    docs = ad.table(spark, d, "documents")
    tables = Tables(spark, ad.scratch(spark))
    segments.refresh(tables, "docs", search.build_index(docs, "doc_id", "source", ["text"]))
    words = tokens("text")
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), words.alias("w")).filter(F.size("w") > 0)
    two = F.array_distinct(F.array(F.col("w")[0], F.col("w")[F.floor(F.size("w") / 2).cast("int")]))
    terms = asked.select("qid", two.alias("t")).select("qid", F.explode("t").alias("term"), F.size("t").alias("n_terms"))
    found, _ = search.best_by_blocks(segments.kept_index(tables, "docs", terms), terms, 5)
    return found.select("qid", "session_id", "doc", F.round("score", 6).alias("score"), "rank")


@query(sql("SELECT term, doc, tf FROM post", TOKENS))
def index_postings(spark, d):
    return index_of(spark, d).postings.select("term", "doc", "tf")


@query(sql("SELECT term, df FROM df", TOKENS))
def term_counts(spark, d):
    return index_of(spark, d).terms


@query(sql("SELECT n_docs, round(avg_len, 6) AS avg_len FROM corpus", TOKENS))
def corpus_stats(spark, d):
    return index_of(spark, d).corpus.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(sql("SELECT doc, length FROM len", TOKENS))
def document_lengths(spark, d):
    return index_of(spark, d).lengths.select("doc", "length")


FOLDED = r"SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents"


@query(sql("SELECT term, stem FROM st", stem_sql(FOLDED, "st")))
def index_stems(spark, d):
    """Stems of all distinct terms."""
    words = ad.table(spark, d, "documents").select(F.explode(tokens("text", folded=True)).alias("term"))
    return stems(words)


META = r"""
mtok AS (SELECT id AS doc, regexp_extract_all(lower(concat_ws(' ', CASE WHEN length(first_prompt) > 200 THEN left(first_prompt, 200) || '...' ELSE first_prompt END, project_name)), '[\p{L}\p{N}]+') AS words FROM s),
mlen AS (SELECT doc, len(words) AS length FROM mtok),
mpost AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(words) AS term FROM mtok) GROUP BY term, doc),
mdf AS (SELECT term, count(*) AS df FROM mpost GROUP BY term),
mcorpus AS (SELECT count(*) AS n_docs, avg(length) AS avg_len FROM mlen),
mq AS (SELECT * FROM (VALUES (1, 'the', 2), (1, 'proj3', 2), (2, 'proj5', 1)) t(qid, term, n_terms)),
mhit AS (SELECT qid, doc, count(*) AS found, any_value(n_terms) AS n_terms,
          sum(CASE WHEN n_docs - df + 0.5 > df + 0.5 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))) AS score
        FROM mq JOIN mpost USING (term) JOIN mdf USING (term) JOIN mlen USING (doc), mcorpus GROUP BY qid, doc)
"""


def metadata_hits(spark, d):
    from sessionlake.functions.text import preview

    fields = ad.sessions(spark, d).select("id", preview("first_prompt", 200).alias("first_prompt"), "project_name").withColumn("session", F.col("id"))
    index = search.build_index(fields, "id", "session", ["first_prompt", "project_name"])
    asked = spark.createDataFrame([(1, "the proj3"), (2, "proj5")], "qid int, text string")
    return search.scored_docs(index, search.terms_of(asked))


@query(sql("SELECT * FROM (SELECT qid, doc AS session_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM mhit WHERE found = n_terms) WHERE rank <= 20", META))
def fts_metadata_search(spark, d):
    return search.best_of_sessions(metadata_hits(spark, d), 20).select("qid", "session_id", F.round("score", 6).alias("score"), "rank")


@query(sql("SELECT qid, session_id, round(CASE WHEN hi > lo THEN 0.5 + 0.5 * (score - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM kw)", TOKENS))
def score_normalise(spark, d):
    hits = search.scored_docs(index_of(spark, d), search.terms_of(ad.searches(spark, d)))
    return search.normalised(search.best_of_sessions(hits, None)).select("qid", "session_id", F.round("score", 6).alias("score"))


MSG = r"""
xtok AS (SELECT message_id AS doc, session_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS words FROM m),
xlen AS (SELECT doc, session_id, len(words) AS length FROM xtok),
xpost AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(words) AS term FROM xtok) GROUP BY term, doc)
"""


@query(sql("""SELECT qid, session_id, CASE WHEN k IS NULL OR (mm IS NOT NULL AND mm > k) THEN 'metadata' ELSE 'keyword' END AS source, coalesce(greatest(k, mm), k, mm) AS score
FROM (SELECT 1 AS qid, session_id, max(len(list_filter(regexp_extract_all(lower(content), '[a-z]+'), lambda w: w = 'the'))) AS k FROM m GROUP BY session_id)
FULL OUTER JOIN (SELECT 1 AS qid, id AS session_id, len(list_filter(regexp_extract_all(lower(first_prompt), '[a-z]+'), lambda w: w = 'the')) * 2 AS mm FROM s WHERE first_prompt IS NOT NULL) USING (qid, session_id)"""))
def merge_sources(spark, d):
    """Hits counted by one word's uses, those of the first prompt twice."""
    count = lambda c: F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), lambda w: w == "the"))
    own = ad.messages(spark, d).groupBy("session_id").agg(F.max(count("content")).alias("score")).select(F.lit(1).alias("qid"), "session_id", "score", F.lit(0).alias("doc"))
    meta = ad.sessions(spark, d).filter("first_prompt is not null").select(F.lit(1).alias("qid"), F.col("id").alias("session_id"), (count("first_prompt") * 2).alias("score"), F.lit(0).alias("doc"))
    return search.merge_sources(own, meta).select("qid", "session_id", "source", "score")


@query("""SELECT doc_id, array_to_string(CASE WHEN len(terms) < 2 AND len(words) >= 2 THEN words ELSE terms END, ' ') AS terms FROM (
SELECT doc_id, words, list_filter(words, lambda w: NOT list_contains(['a','an','and','are','as','at','be','by','for','from','has','have','he','i','in','is','it','its','me','my','of','on','or','she','that','the','they','this','to','us','was','we','what','which','who','will','with','you','do','does','did','find','how','can','use'], w)) AS terms
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents))""")
def text_terms(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.array_join(query_terms("text"), " ").alias("terms"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_extract(trim(regexp_replace('please find me the sessions about ' || text, '\s+', ' ', 'g')), '(?i)about (.+)$', 1), '^[ "'']+|[ "'']+$', '', 'g')) AS text,
'kv' AS harness, 'my proj' AS project, 'a,b' AS tags, 1705276800 AS after_ts, 1717113600 - 7 * 86400 AS before_ts FROM benchmark""")
def query_parse(spark, d):
    """Inline filters around each benchmark text; now is 2024-05-31."""
    raw = F.concat(F.lit("#tag:a please find me the sessions about "), F.col("text"), F.lit(' harness:tree HARNESS:kv project:"my proj" after:2024-01-15 before:7d #tag:b'))
    found = fq.parse_hybrid(ad.table(spark, d, "benchmark").withColumn("raw", raw), F.timestamp_seconds(F.lit(1717113600)))
    return found.select("item_id", "text", "harness", "project", F.array_join("tags", ",").alias("tags"), *ad.seconds("after_ts", "before_ts"))


@query(r"""SELECT item_id, trim(regexp_replace('harness:KV ' || text || ' after:1w project:x', '(\w+):(\S+)', '', 'g')) AS text, 'kv' AS harness, 'x' AS project, 1717113600 - 7 * 86400 AS after_ts FROM benchmark""")
def query_parse_plain(spark, d):
    raw = F.concat(F.lit("harness:KV "), F.col("text"), F.lit(" after:1w project:x"))
    found = fq.parse_plain(ad.table(spark, d, "benchmark").withColumn("raw", raw), F.timestamp_seconds(F.lit(1717113600)))
    return found.select("item_id", "text", "harness", "project", *ad.seconds("after_ts"))


@query(r"""SELECT item_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[ "'']+|[ "'']+$', '', 'g') AS topic FROM benchmark""")
def nl_topic(spark, d):
    return ad.table(spark, d, "benchmark").select("item_id", fq.topic(F.concat(F.lit("What  sessions did we work on "), F.col("text"), F.lit(" please?"))).alias("topic"))


@query(sql("SELECT id, harness, project_name FROM s WHERE harness = 'kv' AND project_name LIKE '%j3%' AND ts_eff > 1704067200 + 50000 AND ts_eff < 1704067200 + 90000000"))
def session_filter_combined(spark, d):
    at = lambda s: datetime.fromtimestamp(1704067200 + s, UTC)
    return ad.sessions(spark, d).filter(filters.session_filter("KV", "J3", at(50_000), at(90_000_000))).select("id", "harness", "project_name")


@query(sql("SELECT id FROM s WHERE id IN (SELECT session_id FROM a WHERE value = 'quality') AND id IN (SELECT session_id FROM a WHERE value = 'toxic') UNION ALL SELECT -id FROM s WHERE id IN (SELECT session_id FROM a WHERE value = 'quality')"))
def session_filter_tags(spark, d):
    s, a = ad.sessions(spark, d), ad.annotations(spark, d)
    return filters.with_all_tags(s, a, ["quality", "toxic"]).select("id").unionByName(filters.with_all_tags(s, a, ["quality"]).select((-F.col("id")).alias("id")))


@query(sql("""SELECT 1 AS qid, id AS session_id FROM s WHERE harness = 'kv' UNION ALL SELECT 2, id FROM s WHERE project_path LIKE '%proj2%' AND id IN (SELECT session_id FROM a WHERE value = 'quality')
UNION ALL SELECT 3, id FROM s WHERE ts_eff > 1704067200 + 100000"""))
def session_candidates(spark, d):
    rows = [(1, "KV", None, None, None, []), (2, None, "proj2", None, None, ["quality"]), (3, None, None, datetime.fromtimestamp(1704167200, UTC), None, None)]
    asked = spark.createDataFrame(rows, "qid int, harness string, project string, after_ts timestamp, before_ts timestamp, tags array<string>")
    return filters.candidates(asked, ad.sessions(spark, d), ad.annotations(spark, d))


@query(sql("SELECT id AS session_id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY ts_eff DESC, id) AS rank FROM s WHERE harness = 'tree' QUALIFY rank <= 30"))
def session_filter_only(spark, d):
    s = ad.sessions(spark, d)
    return filters.filter_only(s.filter("harness = 'tree'").select(F.lit(1).alias("qid"), F.col("id").alias("session_id")), s, 30).drop("qid")


@query(sql("SELECT id FROM s WHERE harness = 'kv' AND project_name LIKE '%proj1%' AND ts_end >= 1704067200 + 3600"))
def session_filter_scan(spark, d):
    return filters.scan_filter(ad.sessions(spark, d), "kv", "Proj1", datetime.fromtimestamp(1704067200 + 3600, UTC)).select("id")


@query(sql("SELECT id, ts_start FROM s WHERE NOT is_child ORDER BY ts_start DESC, id LIMIT 40 OFFSET 5"))
def session_list(spark, d):
    return filters.session_list(ad.sessions(spark, d), 40, 5, is_child=False).select("id", *ad.seconds("ts_start"))


VEC = """
v AS (SELECT x.vec_id AS qid, e.label AS session_id, e.vec_id AS chunk_index, list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) AS sim
      FROM embeddings e, embeddings x WHERE x.vec_id % 20 = 0),
vb AS (SELECT qid, session_id, chunk_index, sim AS score, row_number() OVER (PARTITION BY qid, session_id ORDER BY sim DESC, chunk_index) AS k FROM v WHERE sim >= 0.35),
vs AS (SELECT qid, session_id, chunk_index, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_id) AS rank FROM vb WHERE k = 1)
"""


@query(sql("SELECT qid, session_id, chunk_index, round(score, 6) AS score, rank FROM vs", VEC))
def vector_best_chunk(spark, d):
    return vectors.vector_search(ad.chunks(spark, d), ad.vector_queries(spark, d)).select("qid", "session_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


@query(sql("SELECT qid, chunk_index, round(sim, 6) AS sim FROM v WHERE sim >= 0.35", VEC))
def vector_similar(spark, d):
    return vectors.similar_chunks(ad.chunks(spark, d), ad.vector_queries(spark, d), 0.35).select("qid", "chunk_index", F.round("sim", 6).alias("sim"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) / list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM embeddings")
def vector_cosine(spark, d):
    return ad.table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))


HYBRID = """
vn AS (SELECT qid, 'src' || session_id AS session_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.5 + 0.5 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM vs WHERE rank <= 100 WINDOW w AS (PARTITION BY qid)),
kn AS (SELECT vec_id AS qid, session_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.5 + 0.5 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS f
       FROM kw JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) e ON kw.qid = (e.vec_id // 20) % 4 + 1 WHERE rank <= 100 WINDOW w AS (PARTITION BY vec_id)),
hy AS (SELECT qid, session_id, f, s, CASE WHEN f IS NOT NULL AND s IS NOT NULL THEN 0.3 * f + 0.7 * s ELSE 0.5 * coalesce(f, s) END AS score FROM kn FULL OUTER JOIN vn USING (qid, session_id))
"""


@query(sql("""SELECT qid, session_id, round(score, 6) AS score, round(f, 6) AS fts_score, round(s, 6) AS semantic_score, CASE WHEN f IS NULL OR s >= f THEN 'semantic' ELSE 'keyword' END AS match_source,
row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_id) AS rank FROM hy WHERE score >= 0.2 QUALIFY rank <= 50""", TOKENS, VEC, HYBRID))
def hybrid_search(spark, d):
    """Every twentieth vector, together with one of the four searches, over documents and vectors; a label stands for the source of the same number."""
    asked = ad.vector_queries(spark, d)
    texts = F.array(*[F.lit(t) for _, t in ad.SEARCHES])
    terms = search.terms_of(asked.select("qid", F.element_at(texts, (F.floor(F.col("qid") / 20) % len(ad.SEARCHES) + 1).cast("int")).alias("text")))
    keyword = search.best_of_all(index_of(spark, d), terms, 100)
    near = vectors.vector_search(ad.chunks(spark, d), asked)
    vector = near.select("qid", F.concat(F.lit("src"), F.col("session_id")).alias("session_id"), "score")
    found = search.hybrid(keyword, vector)
    return found.select("qid", "session_id", *[F.round(c, 6).alias(c) for c in ("score", "fts_score", "semantic_score")], "match_source", "rank")


SNIPPETS = r"""
sn AS (SELECT kw.qid, kw.session_id, kw.doc, rank, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS parts, terms
       FROM kw JOIN documents ON doc_id = kw.doc JOIN (SELECT qid, list(DISTINCT term) AS terms FROM q GROUP BY qid) USING (qid) WHERE rank <= 10),
sl AS (SELECT *, list_transform(parts, lambda p: regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g')) AS words FROM sn),
sb AS (SELECT *, list_sort(list_transform(list_filter(range(1, len(parts) + 1), lambda i: list_contains(terms, words[i])), lambda i: {'n': -len(list_intersect(list_distinct(words[i:i + 23]), terms)), 'at': i}))[1].at AS best FROM sl),
sp AS (SELECT *, coalesce(best, 1) AS i FROM sb),
ss AS (SELECT qid, session_id, doc, rank, trim(CASE WHEN i > 1 THEN '...' ELSE '' END || array_to_string(parts[i:i + 23], ' ') || CASE WHEN len(parts) > i + 23 THEN '...' ELSE '' END) AS text FROM sp)
"""


@query(sql("SELECT qid, session_id, doc, rank, nullif(CASE WHEN length(text) > 240 THEN rtrim(left(text, 237)) || '...' ELSE text END, '') AS snippet FROM ss", TOKENS, SNIPPETS))
def search_snippets(spark, d):
    docs, terms = ad.table(spark, d, "documents"), search.terms_of(ad.searches(spark, d))
    hits = search.best_of_sessions(search.scored_docs(index_of(spark, d), terms), 10)
    return search.snippets(hits, docs, terms, "doc_id", "text").select("qid", "session_id", "doc", "rank", "snippet")


@query(sql("""SELECT target AS session_id, max(score) AS score, arg_max(session_id, (score, session_id)) AS matched_session FROM (
SELECT id AS session_id, CASE WHEN is_child THEN coalesce(parent_id, id) ELSE id END AS target, length(last_response) % 13 AS score FROM s WHERE last_response IS NOT NULL)
WHERE target IN (SELECT id FROM s WHERE NOT is_child) GROUP BY target"""))
def parent_propagation(spark, d):
    s = ad.sessions(spark, d)
    hits = s.filter("last_response is not null").select(F.lit(1).alias("qid"), F.col("id").alias("session_id"), (F.length("last_response") % 13).alias("score"))
    return hierarchy.to_parents(hits, s).drop("qid")


@query(sql(r"""SELECT session_id, message_id, role, i AS line_num, lines[i] AS match_text, array_to_string(lines[greatest(i - 2, 1):i - 1], '|') AS before, array_to_string(lines[i + 1:i + 2], '|') AS after
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS lines FROM m)) WHERE contains(lower(lines[i]), 'the ')
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq, message_id, i) <= 50"""))
def line_search(spark, d):
    found = transcripts.line_hits(ad.messages(spark, d), "THE ")
    return found.select("session_id", "message_id", "role", "line_num", "match_text", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(sql("""SELECT session_id, count(*) AS n FROM (SELECT session_id, unnest(string_split(content, chr(10))) AS line FROM m) WHERE contains(lower(line), 'er') GROUP BY session_id"""))
def match_counts(spark, d):
    return transcripts.match_counts(transcripts.line_hits(ad.messages(spark, d), "er", most=None))


@query(sql("""SELECT session_id, message_id, o AS offset, len(left(content, o)) - len(replace(left(content, o), chr(10), '')) AS line, o - coalesce(nullif(o - instr(reverse(left(content, o)), chr(10)) + 1, o + 1), 0) AS column_, i, n, i % n + 1 AS next_i, (i + n - 2) % n + 1 AS previous_i
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, message_id, o) AS i, count(*) OVER (PARTITION BY session_id) AS n
FROM (SELECT *, unnest(list_filter(range(0, length(content)), lambda x: lower(substr(content, x::INT + 1, 3)) = 'ere')) AS o FROM m))"""))
def find_occurrences(spark, d):
    return transcripts.find_occurrences(ad.messages(spark, d), "ERE").withColumnRenamed("column", "column_")


@query(sql("""SELECT session_id, message_id, needle, o AS offset, len(left(content, o)) - len(replace(left(content, o), chr(10), '')) AS line, o - coalesce(nullif(o - instr(reverse(left(content, o)), chr(10)) + 1, o + 1), 0) AS column_,
row_number() OVER (PARTITION BY needle, session_id ORDER BY seq, message_id, o) AS i, count(*) OVER (PARTITION BY needle, session_id) AS n
FROM (SELECT session_id, message_id, seq, content, o, lower(substr(content, o::INT + 1, k)) AS needle FROM (SELECT *, unnest(range(0, length(content))) AS o FROM m), nk) JOIN nd USING (needle)""",
"nd AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS needle FROM benchmark)", "nk AS (SELECT DISTINCT length(needle) AS k FROM nd)"))
def find_all_needles(spark, d):
    """All words of all benchmark texts, wherever they stand in a message."""
    words = ad.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("needle")).withColumn("needle", F.upper("needle"))
    return needles.find_all(ad.messages(spark, d), words).withColumnRenamed("column", "column_")


def index_sql(name: str, docs: str) -> str:
    """Common tables of an index over docs (session_id, place, text), with folding and stems, that end in the best document of each session of each query."""
    return rf"""
{name}d AS ({docs}),
{name}t AS (SELECT session_id, place, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS words FROM {name}d),
{stem_sql(f"SELECT unnest(words) AS term FROM {name}t", name + "s")},
{name}p AS (SELECT stem, session_id, place, count(*) AS tf FROM (SELECT session_id, place, unnest(words) AS term FROM {name}t) JOIN {name}s USING (term) GROUP BY stem, session_id, place),
{name}f AS (SELECT stem, count(*) AS df FROM {name}p GROUP BY stem),
{name}c AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM {name}t),
{name}h AS (SELECT qid, session_id, place, count(*) AS found, any_value(n) AS n,
   sum(CASE WHEN n_docs > 2 * df THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg_len))) AS score
   FROM et JOIN {name}p USING (stem) JOIN {name}f USING (stem) JOIN {name}t USING (session_id, place), {name}c GROUP BY qid, session_id, place),
{name} AS (SELECT * FROM (SELECT qid, session_id, place, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_id) AS rank
   FROM (SELECT *, row_number() OVER (PARTITION BY qid, session_id ORDER BY score DESC, place) AS k FROM {name}h WHERE found = n) JOIN ea USING (qid, session_id) WHERE k = 1) WHERE rank <= 100)"""


#: Raw searches, and what they ask for: text, harness, project, after, before, tag.
RAW = [
    (1, "show me sessions about things tion", "things tion", None, None, None, None, None),
    (2, "the harness:kv", "the", "kv", None, None, None, None),
    (3, "project:proj2 after:2024-01-02", "", None, "proj2", 1704153600, None, None),
    (4, "", "", None, None, None, None, None),
    (5, "#tag:quality", "", None, None, None, None, "quality"),
    (6, "ering tions #tag:quality", "ering tions", None, None, None, None, "quality"),
    (7, "proj3 the project:j3 before:2024-03-01", "proj3 the", None, "j3", None, 1709251200, None),
    (8, "after:2024-01-03 harness:tree", "", "tree", None, 1704240000, None, None),
    (9, "before:2024-01-04", "", None, None, None, 1704326400, None),
]
ASKED = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in (r[0], *r[2:])) + ")" for r in RAW)
VECTOR = lambda text: "[" + ", ".join(f"length(lower({text})) - length(replace(lower({text}), '{c}', ''))" for c in vectors.LETTERS) + "]::DOUBLE[]"
WHOLE = rf"""
eq AS (SELECT *, coalesce(harness, project, tag) IS NOT NULL OR coalesce(after_ts, before_ts) IS NOT NULL AS filtered FROM (VALUES {ASKED}) t(qid, text, harness, project, after_ts, before_ts, tag)),
ea AS (SELECT qid, id AS session_id, ts_eff, filtered, text FROM eq JOIN s ON (eq.harness IS NULL OR s.harness = eq.harness) AND (project IS NULL OR contains(project_name, project) OR contains(project_path, project))
   AND (after_ts IS NULL OR ts_eff > after_ts) AND (before_ts IS NULL OR ts_eff < before_ts) AND (tag IS NULL OR EXISTS (SELECT 1 FROM a WHERE a.session_id = s.id AND a.value = tag))),
ew AS (SELECT qid, unnest(list_distinct(CASE WHEN len(kept) < 2 AND len(words) >= 2 THEN words ELSE kept END)) AS term
   FROM (SELECT qid, words, list_filter(words, lambda w: NOT list_contains({STOP_WORDS}, w)) AS kept FROM (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM eq))),
{stem_sql("SELECT term FROM ew", "es")},
et AS (SELECT qid, stem, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT DISTINCT qid, stem FROM ew JOIN es USING (term)))
"""
SIDES = f"""
ek AS (SELECT qid, session_id, CASE WHEN w1.score IS NULL OR w2.score > w1.score THEN 'metadata' ELSE 'keyword' END AS source, coalesce(greatest(w1.score, w2.score), w1.score, w2.score) AS score,
   CASE WHEN w1.score IS NULL OR w2.score > w1.score THEN NULL ELSE w1.place END AS place FROM w1 FULL OUTER JOIN w2 USING (qid, session_id)),
ev AS (SELECT qid, m.session_id, seq, list_cosine_similarity({VECTOR('content')}, {VECTOR('eq.text')}) AS sim, content FROM eq JOIN ea USING (qid) JOIN m ON m.session_id = ea.session_id WHERE eq.text <> ''),
eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, session_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, session_id ORDER BY sim DESC, seq) AS k FROM ev WHERE sim >= 0.35) WHERE k = 1) WHERE rank <= 100),
kn2 AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.5 + 0.5 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS f FROM ek WINDOW w AS (PARTITION BY qid)),
vn2 AS (SELECT *, CASE WHEN max(sim) OVER w > min(sim) OVER w THEN 0.5 + 0.5 * (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) ELSE 1 END AS g FROM eb WINDOW w AS (PARTITION BY qid)),
eh AS (SELECT qid, session_id, f, g, source, place, content, CASE WHEN f IS NOT NULL AND g IS NOT NULL THEN 0.3 * f + 0.7 * g ELSE 0.5 * coalesce(f, g) END AS score FROM kn2 FULL OUTER JOIN vn2 USING (qid, session_id)),
er AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, session_id) AS rank FROM eh WHERE score >= 0.2) WHERE rank <= 50),
ef AS (SELECT qid, session_id, row_number() OVER (PARTITION BY qid ORDER BY ts_eff DESC, session_id) AS rank FROM ea WHERE filtered AND text = ''),
sg AS (SELECT session_id, string_agg(DISTINCT value, ' ' ORDER BY value) AS tags FROM a GROUP BY session_id)
"""
FIELDS = "SELECT id AS session_id, 0 AS place, concat_ws(' ', CASE WHEN length(first_prompt) > 200 THEN left(first_prompt, 200) || '...' ELSE first_prompt END, project_name, tags, CASE WHEN length(last_response) > 500 THEN left(last_response, 500) || '...' ELSE last_response END) AS text FROM s LEFT JOIN sg ON sg.session_id = id"
SIDES_FIRST, SIDES_LAST = SIDES[SIDES.index("sg AS") :], SIDES[: SIDES.index("sg AS")].rstrip().rstrip(",")


@query(sql("""SELECT qid, session_id, round(score, 6) AS score, round(f, 6) AS fts_score, round(g, 6) AS semantic_score, CASE WHEN f IS NULL OR g >= f THEN 'semantic' ELSE source END AS match_source, rank FROM er
UNION ALL SELECT qid, session_id, 1, NULL, NULL, 'filter', rank FROM ef WHERE rank <= 50""", WHOLE, SIDES_FIRST, index_sql("w1", "SELECT session_id, seq AS place, content AS text FROM m"), index_sql("w2", FIELDS), SIDES_LAST))
def search_end_to_end(spark, d):
    """A batch of raw queries over conversations and kept indexes of them, with counts of letters for vectors."""
    m = ad.messages(spark, d)
    chunks = m.select("session_id", F.col("seq").alias("chunk_index"), "content", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"))
    asked = spark.createDataFrame([r[:2] for r in RAW], "qid int, raw string")
    tables, a = Tables(spark, ad.scratch(spark)), ad.annotations(spark, d)
    segments.refresh(tables, "messages", hybrid.message_index(m))
    segments.refresh(tables, "fields", hybrid.metadata_index(ad.sessions(spark, d), a))
    indexes = tuple((lambda terms, name=n: segments.kept_index(tables, name, terms)) for n in ("messages", "fields"))
    found = hybrid.search_all(asked, ad.sessions(spark, d), m, vectors.backfill(chunks, vectors.letter_embedder, "letters", cut=1 << 30), a, F.lit("2024-05-31").cast("timestamp"), vectors.letter_embedder, indexes=indexes)
    return found.select("qid", "session_id", *[F.round(c, 6).alias(c) for c in ("score", "fts_score", "semantic_score")], "match_source", "rank")
