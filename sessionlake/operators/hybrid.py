"""The whole search for a table of raw queries: parse, candidates, keyword and vector sides, ranking, snippets, log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.queries import parse_hybrid
from sessionlake.functions.text import clean_snippet, preview
from sessionlake.operators import filters, search, vectors
from sessionlake.operators.search import RankParams


def embed_queries(queries: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """qid, embedding of the queries that have text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"qid": p["qid"], "embedding": embed(p["text"].tolist()) if len(p) else []})

    return queries.filter("text <> ''").select("qid", "text").mapInPandas(run, f"qid {dict(queries.dtypes)['qid']}, embedding array<float>")


def metadata_index(sessions: DataFrame, annotations: DataFrame, folded: bool = True, stem: bool = True) -> search.Index:
    """An index of sessions by the beginning of their first prompt, the name of their project, their tags, and the beginning of their last response, where sessions have one."""
    tags = annotations.filter("type = 'tag'").groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("value")), " ").alias("tags"))
    fields = sessions.select(F.col("id").alias("session_id"), F.xxhash64("id").alias("doc"), preview("first_prompt", 200).alias("first_prompt"), "project_name", (preview("last_response", 500) if "last_response" in sessions.columns else F.lit(None).cast("string")).alias("last_response"))
    return search.build_index(fields.join(tags, "session_id", "left"), "doc", "session_id", ["first_prompt", "project_name", "tags", "last_response"], folded, stem)


def numbered_messages(messages: DataFrame) -> DataFrame:
    """session_id, content, doc, by which indexes know a message."""
    return messages.select("session_id", "content", F.xxhash64("session_id", "message_id").alias("doc"))


def message_index(messages: DataFrame, folded: bool = True, stem: bool = True) -> search.Index:
    """An index of messages by their content."""
    return search.build_index(numbered_messages(messages), "doc", "session_id", ["content"], folded, stem)


#: Two functions of terms, as segments.kept_index() is: for messages, and for sessions.
Indexes = tuple[Callable[[DataFrame], search.Index], Callable[[DataFrame], search.Index]]


def search_all(queries: DataFrame, sessions: DataFrame, messages: DataFrame, chunks: DataFrame, annotations: DataFrame, now: Column, embed: Callable | None = None, params: RankParams = RankParams(), folded: bool = True, stem: bool = True, indexes: Indexes | None = None) -> DataFrame:
    """qid, session_id, score, fts_score, semantic_score, match_source, match_snippet, rank for each query (qid, raw).

    Queries with filters see the sessions that pass them only, before any cut; those with filters and no text give the
    newest of these with score 1; those with neither give nothing. Both sides fetch twice the limit, as their
    scores are brought to one scale over what was fetched. messages: session_id, message_id, content; chunks: session_id,
    chunk_index, content, embedding; without `embed` only keywords count. folded and stem: accents and word endings don't
    count, in texts and queries alike; then terms aren't ASCII alone. indexes: kept indexes of messages and of sessions, which are built here otherwise, as functions of the
    terms asked for; theirs is how texts were folded and stemmed.
    """
    asked = parse_hybrid(queries, now)
    filtered = F.coalesce("harness", "project").isNotNull() | F.col("after_ts").isNotNull() | F.col("before_ts").isNotNull() | (F.size("tags") > 0)
    asked = asked.withColumn("filtered", filtered)
    restricted = asked.filter("filtered").select("qid").distinct()
    allowed = filters.candidates(asked.filter("filtered and text <> ''"), sessions, annotations)
    terms = search.terms_of(asked, ascii_terms=not folded, folded=folded)
    most = params.limit * params.over_fetch
    numbered = numbered_messages(messages)
    of_messages, of_fields = (f(terms) for f in indexes) if indexes else (message_index(messages, folded, stem), metadata_index(sessions, annotations, folded, stem))
    by_message, by_field = (search.best_of_sessions(search.scored_docs(i, terms, params), most, allowed, restricted) for i in (of_messages, of_fields))
    keyword = search.merge_sources(by_message.drop("rank"), by_field.drop("rank"))
    asked_texts = asked.filter("text <> ''").select("qid").distinct()
    if embed is None:
        near = keyword.filter("false").select("qid", "session_id", F.lit(0).alias("chunk_index"), "score")
    else:
        near = vectors.vector_search(chunks, embed_queries(asked, embed), params, allowed, restricted).select("qid", "session_id", "chunk_index", "score")
    ranked = search.hybrid(keyword, near, params).join(asked_texts, "qid", "left_semi")
    no_text = filters.filter_only(filters.candidates(asked.filter("filtered and text = ''"), sessions, annotations), sessions, params.limit)
    shortcut = no_text.select("qid", "session_id", "score", F.lit(None).cast("double").alias("fts_score"), F.lit(None).cast("double").alias("semantic_score"), F.lit("filter").alias("match_source"), "rank")
    # Texts are joined to the ranked sessions only.
    shown = ranked.join(keyword.select("qid", "session_id", "doc", F.col("source").alias("field")), ["qid", "session_id"], "left").join(near.select("qid", "session_id", "chunk_index"), ["qid", "session_id"], "left")
    shown = shown.join(numbered.select("doc", F.col("content").alias("message_text")), "doc", "left").join(chunks.select("session_id", "chunk_index", F.col("content").alias("chunk_text")), ["session_id", "chunk_index"], "left")
    snippet = clean_snippet(F.when(F.col("match_source") == "semantic", F.coalesce("chunk_text", "message_text")).otherwise(F.col("message_text")))
    out = shown.select("qid", "session_id", "score", "fts_score", "semantic_score", F.when(F.col("match_source") == "keyword", F.col("field")).otherwise(F.col("match_source")).alias("match_source"), "rank", snippet.alias("match_snippet"))
    return out.unionByName(shortcut.withColumn("match_snippet", F.lit(None).cast("string")))


def present(results: DataFrame, sessions: DataFrame) -> DataFrame:
    """Results with their sessions' fields, in order; sessions that are gone are left out."""
    return results.join(sessions.select(F.col("id").alias("session_id"), "harness", "project_name", "title", "ts_eff"), "session_id").orderBy("qid", "rank")


def log_rows(results: DataFrame, queries: DataFrame, ms: float, most: int = 10) -> DataFrame:
    """A row a query for the search log: raw, result_count, the first sessions, and the time that the batch took."""
    own = results.groupBy("qid").agg(F.count("*").alias("result_count"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "session_id")))), lambda x: x["session_id"]).alias("top_ids"))
    return queries.select("qid", "raw").join(own, "qid", "left").select("raw", F.coalesce("result_count", F.lit(0)).alias("result_count"), F.coalesce("top_ids", F.array().cast(dict(own.dtypes)["top_ids"])).alias("top_ids"), F.lit(ms).alias("ms"), F.current_timestamp().alias("at"))


def recent_searches(log: DataFrame, most: int = 20) -> DataFrame:
    """The last searches of a log, newest first."""
    return log.orderBy(F.desc("at"), "raw").limit(most)
