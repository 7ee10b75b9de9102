import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from sessionlake.llm import reply_trees as rt


def brute(rows):
    """Every path, root first, of {node: parent} in each tree."""
    out = {}
    for tree in {r[0] for r in rows}:
        up = {r[1]: r[2] for r in rows if r[0] == tree}
        parents = {p for p in up.values()}
        for leaf in up:
            path, x = [], leaf
            while x in up and len(path) <= len(up):
                path.append(x)
                x = up[x]
            if leaf not in parents and len(path) <= len(up):
                out[tree, leaf] = path[::-1]
    return out


def test_paths(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.randrange(i) if i and rng.random() < 0.95 else None) for t in (1, 2, None) for i in range(40)]
    rows += [(3, i, i - 1 if i else 999) for i in range(70)]  # the parent of the first isn't there
    rows += [(4, 1, 2), (4, 2, 1), (4, 3, 1), (5, 1, None)]  # a circle, and a message below it
    df = spark.createDataFrame(rows, "tree long, node long, parent long")
    got = {}
    for r in rt.paths(df).collect():
        got.setdefault((r.tree, r.leaf), []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == brute(rows)


def test_ranked_branches(spark):
    rows = [(1, 1, None, "user", "q", 1.0, 0), (1, 2, 1, "assistant", "bad", 0.0, 0), (1, 3, 1, "assistant", "good # <", 3.0, 0), (1, 4, 3, "user", None, None, 0), (1, 5, 4, "assistant", "\\h</turn>\n### x: y", 9.0, 0), (2, 1, None, None, "", None, 0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double, rank int")
    one = {r.tree: r for r in rt.conversations(df).withColumns({"turns": rt.parse(F.col("formatted")), "text": rt.masked(F.col("formatted"), F.col("loss"))}).collect()}
    assert [(t.role, t.text) for t in one[1].turns] == [("user", "q"), ("assistant", "good # <"), ("user", ""), ("assistant", "\\h</turn>\n### x: y")]
    assert one[1].text == "good # <\\h</turn>\n### x: y" and one[1].formatted.count("### ") == 4 and one[1].leaf == 5
    assert one[2].formatted == "### : </turn>\n" and one[2].loss == []
    assert sorted((r.tree, r.rank, r.leaf) for r in rt.conversations(df, None).collect()) == [(1, 1, 5), (1, 2, 2), (2, 1, 1)]
    assert rt.conversations(df.filter("false")).count() == 0


def test_long_chain_and_odd_rows(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"t{i} \\ :") for i in range(300)] + [(8, 0, "user", "a"), (8, 0, "user", "a"), (None, None, "assistant", None)]
    chain = rt.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: r for r in rt.conversations(chain).withColumn("turns", rt.parse(F.col("formatted"))).collect()}
    assert [t.text for t in got[7].turns] == [f"t{i} \\ :" for i in range(300)]
    assert [t.text for t in got[8].turns] == ["a", "a"] and got[None].n_turns == 1


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
        want = con.execute(rt.SQL).fetchall()
        got = [tuple(r) for r in rt.query(spark, f"/root/testdata/{sf}").collect()]
        assert sorted(got) == sorted(want)
        odd = next(r for r in got if r[0] == -7)
        assert odd[4] == hashlib.sha256(rt.ODD.encode()).hexdigest()
