"""Searches for the k best by blocks: whole results, in groups of any size, and no table of pairs."""

import random

from pyspark.sql import functions as F

from sessionlake.operators import search, segments
from sessionlake.operators.kept import Tables


def test_groups_give_what_a_whole_search_gives(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(12)], [1 / (i + 1) for i in range(12)], k=r.randint(0, 30))) for _ in range(300)]
    docs = spark.createDataFrame([(d, None if d % 50 == 7 else f"s{d % 9}", texts[d % 200]) for d in range(300)], "doc long, session string, text string")
    asked = spark.createDataFrame([(q, f"w{q % 12} w{q % 5} w{q % 7}") for q in range(60)] + [(99, "w1 missing")], "qid int, text string")
    terms, tables = search.terms_of(asked), Tables(spark, str(tmp_path))
    segments.refresh(tables, "x", search.build_index(docs, "doc", "session", ["text"]))
    index = segments.kept_index(tables, "x", terms)
    rows = lambda df: sorted((r.qid, r.rank, r.session_id or "", r.doc, r.score) for r in df.collect())
    for limit in (1, 4):
        want = rows(search.best_of_sessions(search.scored_docs(index, terms), limit))
        assert len(want) > 100 or limit == 1
        for group, probe in ((1 << 20, 2), (40, 1)):
            assert rows(search.best_by_blocks(index, terms, limit, probe=probe, group=group)[0]) == want
    some = spark.createDataFrame([(q, f"s{s}") for q in range(60) for s in (2, 5)], "qid int, session_id string")
    want = rows(search.best_of_sessions(search.scored_docs(index, terms), 2, some))
    assert want and rows(search.best_by_blocks(index, terms, 2, candidates=some)[0]) == want


def test_no_row_for_each_pair_of_query_and_block(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc"), (F.col("id") % 3).cast("string").alias("session"), F.lit("two words").alias("text"))
    terms, tables = search.terms_of(spark.range(200).selectExpr("cast(id as int) as qid", "'two words' as text")), Tables(spark, str(tmp_path))
    segments.refresh(tables, "x", search.build_index(docs, "doc", "session", ["text"]))
    found, _ = search.best_by_blocks(segments.kept_index(tables, "x", terms), terms, 2, group=1000)
    plan = found._jdf.queryExecution()
    assert found.count() == 400
    assert "SortMergeJoin [qid" not in plan.executedPlan().toString() and "FlatMapCoGroupsInArrow" in plan.executedPlan().toString()


def test_a_search_of_a_fresh_index_splits_texts_once(spark):
    docs = spark.range(50).select(F.col("id").alias("doc"), F.lit("s").alias("session"), F.concat(F.lit("word w"), F.col("id")).alias("text"))
    terms = search.terms_of(spark.createDataFrame([(1, "word w7")], "qid int, text string"))
    found = search.scored_docs(search.build_index(docs, "doc", "session", ["text"]), terms)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.qid, r.doc) for r in found.collect()] == [(1, 7)]


def test_rows_that_share_a_number_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "s", "a b a"), (1, "s", "b c"), (2, "s", "c c c"), (3, "s", ""), (4, "s", None)], "doc long, session string, text string")
    found = search.build_index(docs, "doc", "session", ["text"]).postings
    assert sorted((r.term, r.doc, r.tf) for r in found.collect()) == [("a", 1, 2), ("b", 1, 2), ("c", 1, 1), ("c", 2, 3)]


def test_a_meeting_takes_few_bytes_a_posting_and_query():
    """F8: a worker holds a group's postings and all queries, so neither may become many objects or copies."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from sessionlake.operators import blocks

    r, docs, terms, queries = np.random.default_rng(3), 4000, 100, 40_000
    pairs = np.sort(r.choice(docs * terms, 300_000, replace=False))
    tid, doc = pairs // docs * 7, pairs % docs
    weight = r.uniform(size=len(pairs))
    postings = pa.table({"tid": tid, "doc": doc, "block": (doc % 60).astype(np.int32), "weight": weight})
    asked = r.integers(0, terms + 3, (queries, 2)) * 7
    of = lambda n, kind: pa.nulls(n, kind)
    others = pa.table({
        "doc": pa.concat_arrays([pa.array(np.arange(docs)), of(queries, pa.int64())]), "session_id": pa.concat_arrays([pa.array([f"s{d % 9}" for d in range(docs)]), of(queries, pa.string())]),
        "qid": pa.concat_arrays([of(docs, pa.int64()), pa.array(np.arange(queries))]), "parts": pa.concat_arrays([of(docs, pa.list_(pa.int64())), pa.array(asked.tolist(), pa.list_(pa.int64()))]),
    })
    tracemalloc.start()
    group = blocks.Group(postings, others.slice(0, docs))
    lists = group.asked(others.slice(docs)["parts"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(pairs) + 400 * queries, peak
    assert [x is None for x in lists] == (asked >= terms * 7).any(1).tolist()
    schema = pa.schema([("qid", pa.int64()), ("session_id", pa.string()), ("doc", pa.int64()), ("score", pa.float64())])
    found = blocks.meeting(2, 3, False, schema)(postings, others.slice(0, docs + 50)).to_pylist()
    by = {(int(t), int(d)): w for t, d, w in zip(tid, doc, weight)}
    for q in range(50):
        own = {}
        for d in range(docs):
            parts = [by.get((int(t), d)) for t in asked[q]]
            if None not in parts and sum(parts) > own.get(d % 9, (0, 0))[0]:
                own[d % 9] = (sum(parts), d)
        want = sorted(((-round(s, 9), f"s{k}", d) for k, (s, d) in own.items()))[:2]
        assert sorted((-round(f["score"], 9), f["session_id"], f["doc"]) for f in found if f["qid"] == q) == want
