"""Filters and lists of sessions, for one set of arguments or for a table of queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_filter(harness: str | None = None, project: str | None = None, after: datetime | None = None, before: datetime | None = None) -> Column:
    """Every clause given must hold: the harness without regard to case, the project as a literal part of name or path, and times strictly within."""
    out = F.lit(True)
    if harness:
        out &= F.lower("harness") == harness.lower()
    if project:
        out &= F.lower("project_name").contains(project.lower()) | F.lower("project_path").contains(project.lower())
    if after is not None:
        out &= F.col("ts_eff") > F.lit(after)
    if before is not None:
        out &= F.col("ts_eff") < F.lit(before)
    return out


def with_all_tags(sessions: DataFrame, annotations: DataFrame, tags: list[str], key: str = "id") -> DataFrame:
    """Sessions that have every tag, by one semi-join for each."""
    for tag in tags:
        own = annotations.filter((F.col("type") == "tag") & (F.col("value") == tag)).select(F.col("session_id").alias(key))
        sessions = sessions.join(own, key, "left_semi")
    return sessions


def candidates(queries: DataFrame, sessions: DataFrame, annotations: DataFrame) -> DataFrame:
    """qid, session_id for each query with a filter and the sessions that pass all of its filters. queries: qid, harness, project,
    after_ts, before_ts, tags. A query without any filter is not restricted, and has no rows.

    Each query finds sessions by one of its filters as a key: tags, else the project, else the harness, else days of its
    time range; the others are tested on what that gives. So no query meets sessions that its key leaves out.
    """
    q = queries.select("qid", F.lower("harness").alias("h"), F.lower("project").alias("p"), "after_ts", "before_ts", F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
    s = sessions.select(F.col("id").alias("session_id"), F.lower("harness").alias("own_h"), F.lower("project_name").alias("name"), F.lower("project_path").alias("path"), "ts_eff")
    passes = (
        (F.col("h").isNull() | (F.col("own_h") == F.col("h")))
        & (F.col("p").isNull() | F.coalesce(F.contains("name", "p"), F.lit(False)) | F.coalesce(F.contains("path", "p"), F.lit(False)))
        & (F.col("after_ts").isNull() | (F.col("ts_eff") > F.col("after_ts")))
        & (F.col("before_ts").isNull() | (F.col("ts_eff") < F.col("before_ts")))
    )
    has = annotations.filter("type = 'tag'").select("session_id", F.col("value").alias("tag")).distinct()
    wanted = q.filter(F.size("tags") > 0)
    tagged = wanted.select("qid", F.size("tags").alias("n"), F.explode("tags").alias("tag")).join(has, "tag").groupBy("qid", "session_id").agg(F.count("*").alias("has"), F.first("n").alias("n")).filter("has = n")
    by_tag = tagged.select("qid", "session_id").join(wanted, "qid").join(s, "session_id").filter(passes)
    rest = q.filter(F.size("tags") == 0)
    by_harness = rest.filter("p is null and h is not null").join(s, F.col("h") == F.col("own_h")).filter(passes)
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000)
    span = s.agg(F.min(day("ts_eff")).alias("first"), F.max(day("ts_eff")).alias("last"))
    timed = rest.filter("p is null and h is null and (after_ts is not null or before_ts is not null)").join(F.broadcast(span))  # span is one row
    low, high = F.greatest("first", F.coalesce(day("after_ts"), "first")), F.least("last", F.coalesce(day("before_ts"), "last"))
    by_day = timed.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("day", F.explode(F.sequence("low", "high"))).join(s.withColumn("day", day("ts_eff")), "day").filter(passes)
    found = by_tag.select("qid", "session_id")
    for one in (_by_project(rest.filter("p is not null"), s).filter(passes), by_harness, by_day):
        found = found.unionByName(one.select("qid", "session_id"))
    return found


def _by_project(q: DataFrame, s: DataFrame, size: int = 3) -> DataFrame:
    """Queries joined with the sessions whose name or path has their project as a part: over distinct projects, by the part's first letters."""
    projects = s.select("name", "path").distinct()
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    texts = F.filter(F.array("name", "path"), lambda x: x.isNotNull())
    every = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.flatten(F.array(*[grams(t, n) for n in range(1, size + 1)])))))
    parts = q.select("p").distinct().withColumn("gram", F.substring("p", 1, size))
    hit = F.coalesce(F.contains("name", "p"), F.lit(False)) | F.coalesce(F.contains("path", "p"), F.lit(False))
    found = projects.withColumn("gram", F.explode(every)).join(parts.filter("p <> ''"), "gram").filter(hit).select("p", "name", "path")
    found = found.unionByName(parts.filter("p = ''").select("p").join(projects))  # an empty part is in every project
    pairs = q.join(found.select("p", F.col("name").alias("hit_name"), F.col("path").alias("hit_path")), "p")
    return pairs.join(s, F.col("hit_name").eqNullSafe(F.col("name")) & F.col("hit_path").eqNullSafe(F.col("path")))


def session_list(sessions: DataFrame, limit: int | None = 1000, offset: int = 0, harness: str | None = None, project_path: str | None = None, is_child: bool | None = None) -> DataFrame:
    """Newest first by start; ties by id. A limit of None is none."""
    for name, value in (("harness", harness), ("project_path", project_path), ("is_child", is_child)):
        if value is not None:
            sessions = sessions.filter(F.col(name) == value)
    found = sessions.orderBy(F.desc("ts_start"), "id")
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def filter_only(candidates_: DataFrame, sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Results of queries without text: the newest sessions that pass, each with score 1."""
    from sessionlake.operators.search import top

    own = candidates_.join(sessions.select(F.col("id").alias("session_id"), "ts_eff"), "session_id")
    return top(own, limit, F.desc("ts_eff"), F.asc("session_id")).select("qid", "session_id", F.lit(1.0).alias("score"), "rank")


def rows_of(table: DataFrame, keys: DataFrame, key: str, *order: str) -> DataFrame:
    """Lookup: rows of a table for some keys (key), in order if one is given."""
    found = table.join(keys.select(key).distinct(), key, "left_semi")
    return found.orderBy(key, *order) if order else found


def resort(results: DataFrame, order: str) -> DataFrame:
    """relevance, newest or oldest; sessions without a time count as the oldest."""
    by = {"relevance": F.desc("score"), "newest": F.desc_nulls_last("ts_eff"), "oldest": F.asc_nulls_first("ts_eff")}[order]
    return results.orderBy(by, "session_id")


def scan_filter(sessions: DataFrame, harness: str | None = None, project: str | None = None, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """The older filters: harness as it is, project as part of the name, times of change, of which a session must have one when they are asked for."""
    if harness:
        sessions = sessions.filter(F.col("harness") == harness)
    if project:
        sessions = sessions.filter(F.lower("project_name").contains(project.lower()))
    if after is not None:
        sessions = sessions.filter(F.col("ts_end") >= F.lit(after))
    if before is not None:
        sessions = sessions.filter(F.col("ts_end") <= F.lit(before))
    return sessions
