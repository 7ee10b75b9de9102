"""Parents and children: explicit links, the nearness of times, tasks that were begun, and hits that pass to a parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_known_parents(sessions: DataFrame) -> DataFrame:
    """Parents that aren't there become null; a session with a known parent is a child. One self-join, in any order of arrival."""
    known = sessions.select(F.col("id").alias("known_id")).distinct()
    joined = sessions.join(known, sessions["parent_id"] == known["known_id"], "left")
    return joined.withColumns({"parent_id": F.col("known_id"), "is_child": F.col("is_child") | F.col("known_id").isNotNull()}).select(*sessions.columns)


def relink(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """Sets links (id, new_parent_id, new_child_type) whose parent is there; a type that is null keeps the old one."""
    known = links.join(sessions.select(F.col("id").alias("new_parent_id")), "new_parent_id", "left_semi")
    out = sessions.join(known, "id", "left")
    has = F.col("new_parent_id").isNotNull()
    return out.withColumns({"parent_id": F.coalesce("new_parent_id", "parent_id"), "is_child": F.col("is_child") | has, "child_type": F.when(has, F.coalesce("new_child_type", "child_type")).otherwise(F.col("child_type"))}).select(*sessions.columns)


def explicit_children(sessions: DataFrame) -> DataFrame:
    """parent_id, child_id, ts of children that name a parent of the same harness."""
    p = sessions.select("harness", F.col("id").alias("parent_id"))
    c = sessions.filter("is_child").select("harness", "parent_id", F.col("id").alias("child_id"), F.col("ts_eff").alias("ts"))
    return c.join(p, ["harness", "parent_id"]).select("parent_id", "child_id", "ts")


def near_children(sessions: DataFrame, hours: float = 2, wide: dict[str, float] | None = None) -> DataFrame:
    """parent_id, child_id, ts: children of the same harness and project whose time lies less than `hours` (more for harnesses
    in `wide`) from the parent's last change, for parents without an explicit child."""
    parents = sessions.filter("not is_child and ts_end is not null").select("harness", "project_path", F.col("id").alias("parent_id"), F.col("ts_end").alias("changed"))
    parents = parents.join(explicit_children(sessions).select("parent_id"), "parent_id", "left_anti")
    children = sessions.filter("is_child").select("harness", "project_path", F.col("id").alias("child_id"), F.col("ts_eff").alias("ts"))
    limit = F.lit(hours * 3600.0)
    for name, own in (wide or {}).items():
        limit = F.when(F.col("harness") == name, own * 3600.0).otherwise(limit)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    # Slots of the limit's length: what is nearer than that lies in the same slot or in one beside it.
    children = children.withColumns({"at": seconds("ts"), "slot": F.explode(_slots(seconds("ts") / limit))})
    parents = parents.withColumns({"changed_at": seconds("changed"), "limit": limit, "slot": F.floor(seconds("changed") / limit)})
    return children.join(parents, ["harness", "project_path", "slot"]).filter(F.abs(F.col("at") - F.col("changed_at")) < F.col("limit")).select("parent_id", "child_id", "ts")


def _slots(at: Column) -> Column:
    """The slot of a place and both beside it."""
    return F.sequence(F.floor(at) - 1, F.floor(at) + 1)


def all_children(sessions: DataFrame, hours: float = 2, wide: dict[str, float] | None = None) -> DataFrame:
    """Explicit children, and near ones for parents without any."""
    return explicit_children(sessions).withColumn("link", F.lit("explicit")).unionByName(near_children(sessions, hours, wide).withColumn("link", F.lit("near")))


def child_counts(sessions: DataFrame, hours: float = 2, wide: dict[str, float] | None = None) -> DataFrame:
    return all_children(sessions, hours, wide).groupBy("parent_id").agg(F.count("*").alias("n_children"))


def task_children(tasks: DataFrame, children: DataFrame, seconds: float = 60, project_hours: float = 2) -> DataFrame:
    """parent_id, child_id once each: children of the type invoked, begun within `seconds` of it; where a time lacks, those
    of the same project changed no more than `project_hours` before the parent.

    tasks: parent_id, harness, kind, invoked, project_path, parent_changed; children: id, harness, child_type, created, changed, project_path.
    """
    c = children.select(F.col("id").alias("child_id"), "harness", F.col("child_type").alias("kind"), "created", "changed", F.col("project_path").alias("child_project"))
    seconds_of = lambda name: F.unix_micros(F.col(name).cast("timestamp")) / 1e6
    # Times a slot apart are nearer than `seconds` only if their slots are neighbours.
    timed = c.filter("created is not null").withColumn("slot", F.explode(_slots(seconds_of("created") / seconds)))
    near = tasks.filter("invoked is not null").withColumn("slot", F.floor(seconds_of("invoked") / seconds)).join(timed, ["harness", "kind", "slot"]).filter(F.abs(seconds_of("created") - seconds_of("invoked")) < seconds)
    same = c.withColumn("project_path", F.col("child_project"))
    by_project = lambda t, own: t.join(own, ["harness", "kind", "project_path"]).filter(seconds_of("changed") >= seconds_of("parent_changed") - project_hours * 3600)
    found = [near, by_project(tasks.filter("invoked is null"), same), by_project(tasks.filter("invoked is not null"), same.filter("created is null"))]
    pairs = [x.filter("child_id <> parent_id").select("parent_id", "child_id") for x in found]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def to_parents(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hits (qid, session_id, score, ...) as hits of parents: the best of a parent's own and its explicit children's; on a tie the last by session."""
    own = sessions.select(F.col("id").alias("session_id"), "parent_id", "is_child")
    up = hits.join(own, "session_id").withColumn("target", F.when(F.col("is_child"), F.coalesce("parent_id", "session_id")).otherwise(F.col("session_id")))
    best = up.groupBy("qid", "target").agg(F.max_by(F.struct("session_id", "score"), F.struct("score", "session_id")).alias("m"))
    parents = sessions.filter("not is_child").select(F.col("id").alias("target"))
    return best.join(parents, "target", "left_semi").select("qid", F.col("target").alias("session_id"), F.col("m.score").alias("score"), F.col("m.session_id").alias("matched_session"))


def matched_children(children: DataFrame, hits: DataFrame) -> DataFrame:
    """Children (parent_id, child_id) that a search found too."""
    return children.join(hits.select(F.col("session_id").alias("child_id")).distinct(), "child_id", "left_semi")


def task_invocations(messages: DataFrame, content: str = "content_v") -> DataFrame:
    """session_id, seq, kind, ts, description for items of assistant content (VARIANT) that begin a task of some type; children begin none."""
    items = F.try_variant_get(F.col(content), "$", "array<variant>")
    own = messages.filter((F.col("role") == "assistant") & ~F.coalesce(F.col("is_child"), F.lit(False))).select("session_id", "seq", "ts", F.explode(items).alias("item"))
    get = lambda path: F.try_variant_get("item", path, "string")
    return own.filter((get("$.name") == "Task") & (F.coalesce(get("$.input.subagent_type"), F.lit("")) != "")).select("session_id", "seq", get("$.input.subagent_type").alias("kind"), "ts", F.coalesce(get("$.input.description"), F.lit("")).alias("description"))
