"""Packing in order by doubled pointers, against a plain fold."""

import random

import pytest

from sessionlake.operators import chunks, packing


def fold(sizes, budget):
    out, chunk, total = [], -1, 0
    for n in sizes:
        if chunk < 0 or total + n > budget:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_packed_is_the_fold(spark, block):
    rng = random.Random(5)
    sessions = {s: [rng.choice([1, 2, 7, 30, 99, 100, 101, 100, 950]) for _ in range(n)] for s, n in [(1, 1), (2, 2), (3, 40), (None, 15), (5, 300)]}
    rows = [(s, 2 * i, n, "x") for s, own in sessions.items() for i, n in enumerate(own)]
    rng.shuffle(rows)
    items = spark.createDataFrame(rows, "session_id long, seq long, tokens int, other string")
    got = {}
    for r in sorted(packing.packed(items, 100, ["seq"], block=block).collect(), key=lambda r: r.seq):
        got.setdefault(r.session_id, []).append(r.inner)
    assert got == {s: fold(own, 100) for s, own in sessions.items()}


def test_empty_and_equal_rows(spark):
    schema = "session_id long, seq long, tokens int"
    assert packing.packed(spark.createDataFrame([], schema), 10, ["seq"]).count() == 0
    rows = spark.createDataFrame([(1, 0, 6), (1, 0, 6), (1, None, 3), (1, 1, 4)], schema)
    assert sorted((r.seq if r.seq is not None else -1, r.inner) for r in packing.packed(rows, 10, ["seq"]).collect()) == [(-1, 0), (0, 0), (0, 1), (1, 1)]


def test_a_long_session_in_many_blocks(spark):
    """Twenty thousand messages of one session; a plan without Python, and no window over a whole session's messages."""
    from pyspark.sql import functions as F

    messages = spark.range(20_000).select(F.lit(1).alias("session_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("message_id"), F.lit("user").alias("role"), F.repeat(F.lit("word "), (F.col("id") * 7 % 90).cast("int")).alias("content"))
    sizes = [len("[user]: " + "word " * (i * 7 % 90)) // 4 for i in range(20_000)]
    found = chunks.turn_chunks(messages)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    want = fold(sizes, 400)
    rows = sorted(found.select("inner", "message_id", "token_count").collect())
    assert [r.inner for r in rows] == list(range(want[-1] + 1))
    assert [int(r.message_id) for r in rows] == [want.index(k) for k in range(want[-1] + 1)]
    assert sum(r.token_count for r in rows) == sum(sizes)
