import os

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import kept, reindex, search, segments, store
from sessionlake.plans import adapters as ad
from sessionlake.plans import indexing

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def written(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_replace_touches_its_buckets_only(spark, tmp_path):
    tables = kept.Tables(spark, str(tmp_path))
    run = tables.run()
    run.whole("t", spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("_bucket name")), "id", 8)
    run.publish()
    before, files = tables.files("t"), written(tmp_path)
    run = tables.run()
    fresh = spark.createDataFrame([(3, 1), (3, 2), (200, 5)], "id long, v long")
    keys = run.keys(spark.createDataFrame([(3,), (4,), (200,), (None,)], "id long"), "id", 8)
    run.replace("t", fresh, keys)
    assert rows(tables.read("t").filter("id = 3")) == [(3, 6, "a")]  # not published yet
    run.publish()
    want = sorted([(i, i * 2, "a") for i in range(100) if i not in (3, 4)] + [(3, 1, None), (3, 2, None), (200, 5, None)], key=str)
    assert rows(tables.read("t")) == want
    touched = {r[0] for r in spark.createDataFrame([(3,), (4,), (200,)], "id long").select(kept.bucket_of("id", 8)).collect()}
    after = tables.files("t")
    assert len(touched) < 8 and all(after[b] == before[b] for b in before if b not in touched)
    now = written(tmp_path)
    assert all(now[f] == t for f, t in files.items())  # nothing was written anew
    run = tables.run()
    assert set(run.compact("t", most=2)) <= touched
    run.publish()
    assert rows(tables.read("t")) == want and all(len(f) == 1 for f in tables.files("t").values())
    assert tables.vacuum() > 0 and rows(tables.read("t")) == want
    assert rows(tables.read("t", only=touched)) == rows(tables.read("t").filter(kept.bucket_of("id", 8).isin(list(touched))))


def test_runs_are_published_together_or_not_at_all(spark, tmp_path):
    tables = kept.Tables(spark, str(tmp_path))
    assert not tables.has("a") and tables.state()["run"] == 0
    first, second = tables.run(), tables.run()
    for run in (first, second):
        run.whole("a", spark.range(run is first and 3 or 5), "id", 2)
        run.whole("b", spark.range(4), "id", 2)
    first.publish()
    with pytest.raises(kept.Conflict):
        second.publish()
    dead = tables.run()
    dead.whole("a", spark.range(9), "id", 2)  # dies here
    assert tables.read("a").count() == 3 and tables.read("b").count() == 4
    (tmp_path / "runs" / "000000002").write_text('{"run": 2')  # a pointer that is still being written
    assert tables.state()["run"] == 1


def test_empty_tables_and_no_touched_keys(spark, tmp_path):
    tables = kept.Tables(spark, str(tmp_path))
    run = tables.run()
    run.whole("t", spark.range(0), "id", 4)
    run.publish()
    assert tables.read("t").count() == 0
    run = tables.run()
    run.replace("t", spark.range(2), run.keys(spark.range(0), "id", 4))
    run.compact("t")
    run.publish()
    assert rows(tables.read("t")) == [(0,), (1,)]


def test_incremental_equals_full_and_writes_what_changed(spark, tmp_path):
    m, s, a = ad.messages(spark, D), ad.sessions(spark, D), ad.annotations(spark, D)
    then, messages, tags_then, touched = indexing.older(spark, D)
    part, whole = kept.Tables(spark, str(tmp_path / "part")), kept.Tables(spark, str(tmp_path / "whole"))
    reindex.full(part, then, messages, tags_then, per_bucket=20)
    files = written(tmp_path / "part")
    fresh = s.filter("id % 10 = 3")
    said = reindex.incremental(part, touched, fresh, m, a, most=99)
    reindex.full(whole, s, m, a, per_bucket=20)
    assert rows(indexing.kept_rows(part)) == rows(indexing.kept_rows(whole))
    for name in ("sessions", "messages", "chunks", "projects"):
        assert rows(part.read(name).select(*sorted(part.read(name).columns)).drop("harness_counts")) == rows(whole.read(name).select(*sorted(whole.read(name).columns)).drop("harness_counts")), name
    now = written(tmp_path / "part")
    assert all(now[f] == t for f, t in files.items())
    assert said["sessions"] == fresh.count() and said["messages"] == m.filter("session_id % 10 = 3").count() < m.count() / 2
    again = reindex.incremental(part, touched.filter("false"), fresh, m, a.filter("false"), most=0)
    assert again["sessions"] == 0 and again["compacted"] > 0
    assert rows(indexing.kept_rows(part)) == rows(indexing.kept_rows(whole))


class Reads:
    """A session that counts how often files are listed to be read."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0

    def __getattr__(self, name):
        self.n += name == "read"
        return getattr(self.spark, name)


def test_a_part_is_listed_once(spark, tmp_path):
    """however often it is read."""
    tables = kept.Tables(spark, str(tmp_path))
    run = tables.run()
    part = run.whole("t", spark.range(50), "id", 8)
    run.publish()
    tables.spark = Reads(spark)
    assert [tables.read("t").count(), tables.read("t", [1, 2]).count() < 50, kept.rows_in(tables, part)] == [50, True, 50]
    assert rows(tables.read("t").filter("id < 2")) == [(0,), (1,)]
    assert tables.spark.n == 1


def test_incremental_reads_what_it_is_given_once(spark, tmp_path):
    """fresh messages are asked for once, however many tables come of them."""
    seen = spark.sparkContext.accumulator(0)

    def tell(text):
        seen.add(1)
        return text

    m, s, a = (x(spark, D) for x in (ad.messages, ad.sessions, ad.annotations))
    m, s = m.filter("session_id < 4"), s.filter("id < 4")
    tables = kept.Tables(spark, str(tmp_path))
    reindex.full(tables, s, m, a)
    counted = m.withColumn("content", F.udf(tell, "string").asNondeterministic()("content"))
    said = reindex.incremental(tables, s.select("id"), s, counted, a)
    assert seen.value == said["messages"] == m.count() > 0


def index_of(docs, **more):
    return search.build_index(docs, "doc", "session", ["text"], **more)


def test_segments_equal_a_fresh_index(spark, tmp_path):
    words = ["Ringing", "runs", "café", "tables", "Tabled", "the", "run"]
    text = lambda i, v: " ".join(words[(i * v + j * j) % 7] for j in range(i % 9 + 1))
    current = {i: text(i, 1) for i in range(100)}
    frame = lambda ids: spark.createDataFrame([(i, f"s{i % 11}", current[i]) for i in ids], "doc long, session string, text string")
    tables, options = kept.Tables(spark, str(tmp_path)), {"folded": True, "stem": True}
    segments.refresh(tables, "x", index_of(frame(range(100)), **options), per_bucket=100)
    assert tables.state()["tables"]["x-postings"]["buckets"] > 1
    merged = 0
    for v, ids in ((2, range(10, 30)), (3, range(20, 45)), (4, range(100, 120)), (5, range(0, 60, 3)), (6, range(5))):
        for i in ids:
            current[i] = text(i, v)
        dropped = [i for i in current if i % 17 == v]
        for i in dropped:
            del current[i]
        said = segments.refresh(tables, "x", index_of(frame([i for i in ids if i in current]), **options), spark.createDataFrame([(i,) for i in dropped], "doc long"), fan=3)
        merged += said["merged"]
        assert said["docs"] == len(current)
    assert merged >= 3 and said["segments"] < 5
    asked = spark.createDataFrame([(1, "running tables"), (2, "CAFE"), (3, "ring nothing"), (4, "table")], "qid int, text string")
    terms = search.terms_of(asked, ascii_terms=False, folded=True)
    own, fresh = segments.kept_index(tables, "x", terms), index_of(frame(current), **options)
    assert own.stem and own.folded
    near = lambda df: [(r.qid, r.session_id, r.doc, round(r.score, 9), r.rank) for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank))]
    want = near(search.best_of_sessions(search.scored_docs(fresh, terms), 4))
    assert want and near(search.best_of_sessions(search.scored_docs(own, terms), 4)) == want
    found, read = search.best_by_blocks(own, terms, 4, probe=1)
    assert near(found) == want
    with pytest.raises(ValueError):
        segments.refresh(tables, "x", index_of(frame(current)))


def test_blocks_leave_postings_unread(spark, tmp_path):
    docs = ad.table(spark, "/root/testdata/sf0.01", "documents")
    tables = kept.Tables(spark, str(tmp_path))
    segments.refresh(tables, "d", search.build_index(docs, "doc_id", "source", ["text"]))
    common = [r.term for r in search.build_index(docs, "doc_id", "source", ["text"]).terms.orderBy(F.desc("df"), "term").limit(40).collect()]
    terms = spark.createDataFrame([(i, t, 1) for i, t in enumerate(common)], "qid int, term string, n_terms int")
    index = segments.kept_index(tables, "d", terms)
    found, read = search.best_by_blocks(index, terms, 2, probe=2)
    whole = search.best_of_sessions(search.scored_docs(index, terms), 2)
    assert rows(found.select("qid", "session_id", "doc", "rank")) == rows(whole.select("qid", "session_id", "doc", "rank"))
    n, every = read.agg(F.sum("postings")).first()[0], index.postings.count()
    print("postings read", n, "of", every)
    assert n < 0.9 * every


def test_relink_append_and_marks(spark):
    """Functions of annotations, links and marks by hand."""
    from sessionlake.operators import hierarchy, incremental

    s = spark.createDataFrame([(1, None, False, None), (2, 9, False, "old"), (3, None, False, "x")], "id long, parent_id long, is_child boolean, child_type string")
    links = spark.createDataFrame([(2, 1, None), (3, 77, "y")], "id long, new_parent_id long, new_child_type string")
    assert rows(hierarchy.relink(s, links)) == [(1, None, False, None), (2, 1, True, "old"), (3, None, False, "x")]
    a = spark.createDataFrame([], "session_id string, ts timestamp, type string, value string, source string")
    (r,) = store.append_annotation(a, "s", "note", "v").collect()
    assert (r.session_id, r.type, r.value, r.source) == ("s", "note", "v", "manual") and r.ts is not None
    files = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "id string, mtime double")
    fresh, mark = incremental.newer_than(files, F.lit(2.0))
    assert rows(fresh.select("id")) == [("b",)] and fresh.agg(mark).first()[0] == 5.0
    assert incremental.newer_than(files, F.lit(9.0))[0].agg(incremental.newer_than(files, F.lit(9.0))[1]).first()[0] == 9.0


def test_a_refresh_splits_texts_once_and_makes_few_folders(spark, tmp_path):
    """once for postings, lengths and totals together; and a part is no more folders than can be listed fast, however large the index."""
    seen = spark.sparkContext.accumulator(0)

    def tell(text):
        seen.add(1)
        return text

    given = [(d, f"s{d % 3}", f"all w{d % 150} w{d % 7} w{d % 7}") for d in range(400)] + [(400, "s", ""), (401, None, None)]
    counted = lambda some: spark.createDataFrame(some, "doc long, session string, text string").withColumn("text", F.udf(tell, "string").asNondeterministic()("text"))
    tables = kept.Tables(spark, str(tmp_path))
    assert segments.refresh(tables, "x", index_of(counted(given)), per_bucket=2)["docs"] == len(given) == seen.value
    assert all(len(tables.files(t)) <= 64 for t in ("x-postings", "x-docs"))
    assert segments.refresh(tables, "x", index_of(counted([(7, "s", "all other"), (500, "s", "w3")])), per_bucket=2)["docs"] == len(given) + 1
    assert seen.value == len(given) + 2
    now = [g for g in given if g[0] != 7] + [(7, "s", "all other"), (500, "s", "w3")]
    terms = search.terms_of(spark.createDataFrame([(1, "all w3"), (2, "w3"), (3, "other all")], "qid int, text string"))
    found = lambda index: rows(search.best_of_sessions(search.scored_docs(index, terms), 3))
    assert found(segments.kept_index(tables, "x", terms)) == found(index_of(spark.createDataFrame(now, "doc long, session string, text string")))
    twice = spark.createDataFrame([(7, "s", "all all"), (7, "t", "all w3")], "doc long, session string, text string")  # a number that two rows share
    segments.refresh(tables, "x", index_of(twice))
    assert rows(segments.kept_index(tables, "x", terms).postings.filter("doc = 7").select("term", "tf")) == [("all", 3), ("w3", 1)]
