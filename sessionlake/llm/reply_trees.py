"""Reply trees as conversations: paths from root to leaf, ranked by score, each formatted as one text with a loss mask.

Ancestors are found by doubling: a self-join of the links that reach 2^k messages up gives those that reach twice as
far, and a path is put together from the longest links down, so a tree of depth n takes about 2 log2 n joins and
rows in proportion to the length of all paths. Joins are on messages, so one large tree is no hot key.

Template: `### role: text</turn>` and a line feed for each turn. Inside roles and texts a backslash, `#` and `<` are
written as a backslash and b, h or l (and a role's colon as a backslash and c), so neither mark can occur in them.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import save

CLOSE = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(c: Column, role: bool = False) -> Column:
    """Text without marks; unescape() gives it back."""
    for plain, code in (*ESCAPES, *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Each backslash of an escaped text begins a code, so codes can be undone one after the other, that of the backslash last."""
    for plain, code in ((":", "\\c"), *ESCAPES[::-1]):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, up (messages between node and leaf, 0 for the leaf) for each path of each tree.

    messages: tree, node, parent, (tree, node) being unique. A null parent, or one that isn't there, makes a root; messages
    that only lead round in a circle have no root and no leaf that starts at one, and are left out with all below them.
    """
    nodes = messages.select(F.struct("tree").alias("tree"), "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    link = save(nodes.select("tree", "node", F.col("parent").alias("to")).join(known.withColumnRenamed("parent", "to"), ["tree", "to"], "left_semi").select("tree", "node", "to"), "links")
    links, left = [], link.count()
    total = nodes.count()
    while left and 1 << len(links) <= total:  # a chain can't be longer than all messages: what goes on is a circle
        links.append(link)
        further = link.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        link = save(link.join(further, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")), "links")
        left = link.count()
    if left:
        nodes = nodes.join(link.select("tree", "node"), ["tree", "node"], "left_anti")
    leaves = nodes.join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(links) - 1, -1, -1):
        step = found.join(links[k], ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = found.unionByName(step)
        found = save(found, "paths") if k % 3 == 0 else found
    return found.select("tree.tree", "leaf", "node", "up")


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, score, n_turns, formatted, loss (start and end of each assistant text in formatted).

    messages: tree, node, parent, role, text, score; more columns are ignored. A null role or text is empty, a null score 0.
    Paths of a tree are ranked by the mean score of their messages, then length, longest first, then leaf;
    `branches` of them are chosen, None: all. An empty table gives no rows.
    """
    own = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    all_paths = paths(own)
    tree = lambda df: df.withColumn("tree", F.struct("tree"))  # a struct with a null in it is no null, and joins
    on = tree(all_paths).join(tree(own).select("tree", "node", "role", "text", "score"), ["tree", "node"])
    scored = on.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf"))
    chosen = scored.withColumn("rank", place)
    if branches is not None:
        chosen = chosen.filter(F.col("rank") <= branches)
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    turns = on.drop("score").join(chosen, ["tree", "leaf"]).withColumns({"head": head, "body": escape(F.col("text"))})
    turn = F.concat("head", "body", F.lit(CLOSE))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    start = F.coalesce(F.sum(F.length(turn)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    parts = turns.withColumns({"turn": turn, "start": start}).select("tree", "leaf", "rank", "score", "n_turns", F.struct((-F.col("up")).alias("at"), "turn", span.alias("span")).alias("part"))
    whole = parts.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        F.col("tree.tree").alias("tree"), "leaf", "rank", "score", "n_turns",
        F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role, text."""
    pieces = F.split(formatted, CLOSE)
    head = lambda p: F.substring_index(p, ": ", 1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(unescape(F.substr(head(p), F.lit(5))).alias("role"), unescape(F.substr(p, F.length(head(p)) + 3)).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(rows: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches: each row answers the one before it. Rows of the same turn follow by role, then text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    own = rows.select(F.col("conv_id").alias("tree"), place.alias("node"), "role", "text")
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


ODD = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts look like marks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    out = conversations(save(chains(rows.unionByName(odd)), "messages"))
    turns, text = parse(F.col("formatted")), masked(F.col("formatted"), F.col("loss"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
