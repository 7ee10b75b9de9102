"""Bounded nearest sessions against all pairs."""

import math

import numpy as np

from sessionlake.operators import vectors


def test_bounded_blocks_give_the_same_best(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(400, 6)), 1)
    points[50:90] = points[7]  # ties, in one session and over several
    chunks = spark.createDataFrame([(i % 23, i, p.tolist()) for i, p in enumerate(points)] + [(1, 900, [1.0, 2.0]), (2, 901, None), (3, 902, [0.0] * 6), (4, 903, [float("nan")] * 6), (5, 904, [])], "session_id long, chunk_index long, embedding array<double>")
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 60, 5)] + [(100, None), (101, [0.0] * 6), (102, [2.0, 4.0])], "qid long, embedding array<double>")
    every = vectors.similar_chunks(chunks, queries, 0.1, block=70, query_block=5)
    few = vectors.similar_chunks(chunks, queries, 0.1, block=70, query_block=5, most=3)
    rows = lambda df: [(r.qid, r["rank"], r.session_id, r.chunk_index, round(r.score, 9)) for r in vectors.best_chunks(df, 3).orderBy("qid", "rank").collect()]
    assert rows(few) == rows(every)
    blocks = -(-404 // 70)
    assert few.groupBy("qid").count().agg({"count": "max"}).first()[0] <= 3 * blocks < every.count() / 12
    assert [(r.session_id, r.chunk_index) for r in few.filter("qid = 102").collect()] == [(1, 900)]
    assert few.filter("qid in (100, 101)").count() == 0 and every.filter("chunk_index > 900").count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "session_id long, chunk_index long, embedding array<double>")
    assert vectors.similar_chunks(none, spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 0.1, most=3).count() == 0


def test_equal_vectors_tie_wherever_they_are_dealt_to(spark):
    rng = np.random.default_rng(11)
    point = rng.normal(size=64).astype(np.float32)
    others = rng.normal(size=(1500, 64)).astype(np.float32)
    rows = [(i, i, (point if i % 3 == 0 else others[i]).tolist()) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "session_id long, chunk_index long, embedding array<float>")
    queries = spark.createDataFrame([(i, (point + others[i] * np.float32(0.3)).tolist()) for i in range(37)], "qid long, embedding array<float>")
    found = vectors.similar_chunks(chunks, queries, 0.5, block=311, query_block=7).filter("chunk_index % 3 = 0").groupBy("qid").count().withColumnRenamed("count", "n")
    assert [r.n for r in found.collect()] == [500] * 37
    distinct = vectors.similar_chunks(chunks, queries, 0.5, block=311, query_block=7).filter("chunk_index % 3 = 0").select("qid", "sim").distinct()
    assert distinct.count() == 37
    few = vectors.similar_chunks(chunks, queries, 0.5, block=311, query_block=7, most=4)
    assert {r.session_id for r in vectors.best_chunks(few, 4).collect()} == {0, 3, 6, 9}


def test_values_are_summed_from_left_to_right(spark):
    points = np.random.default_rng(5).normal(size=(300, 64)).astype(np.float32)
    chunks = spark.createDataFrame([(i, i, p.tolist()) for i, p in enumerate(points)], "session_id long, chunk_index long, embedding array<float>")
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 300, 20)], "qid long, embedding array<float>")

    def plain(a, b):
        out = 0.0
        for x, y in zip(a.tolist(), b.tolist()):
            out += x * y
        return out

    got = {(r.qid, r.chunk_index): r.sim for r in vectors.similar_chunks(chunks, queries, 0.1, block=97, query_block=4).collect()}
    want = {(i, j): plain(points[j], points[i]) / math.sqrt(plain(points[j], points[j]) * plain(points[i], points[i])) for i in range(0, 300, 20) for j in range(300)}
    assert got == {k: v for k, v in want.items() if v >= 0.1}


def test_blocks_meet_whatever_the_number_of_partitions(spark):
    """Where small partitions aren't joined to one: both sides' keys are to be of one type, else they are dealt out by two hashes."""
    points = np.random.default_rng(6).normal(size=(300, 5)).tolist()
    chunks = spark.createDataFrame([(i % 9, i, p) for i, p in enumerate(points)], "session_id long, chunk_index long, embedding array<double>")
    queries = spark.createDataFrame([(i, points[i]) for i in range(0, 300, 10)], "qid long, embedding array<double>")
    rows = lambda: sorted((r.qid, r.chunk_index) for r in vectors.similar_chunks(chunks, queries, 0.3, block=40, query_block=4).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    want = sorted((i, j) for i in range(0, 300, 10) for j in range(300) if np.dot(points[i], points[j]) / np.linalg.norm(points[i]) / np.linalg.norm(points[j]) >= 0.3)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert rows() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
