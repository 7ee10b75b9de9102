import datetime as dt

from pyspark.sql import functions as F

from sessionlake.operators import hybrid, stats, store, vectors

NOW = lambda: F.lit("2024-05-31").cast("timestamp")


def tables(spark):
    at = lambda d: dt.datetime(2024, 5, d)
    s = spark.createDataFrame([("s1", "alpha", "shop", "/w/shop", "fix the login flow", at(1)), ("s2", "beta", "blog", "/w/blog", "write a post", at(20)), ("s3", "alpha", "blog", "/w/blog", "deploy now", at(30))], "id string, harness string, project_name string, project_path string, first_prompt string, ts_eff timestamp").withColumn("title", F.lit(None).cast("string"))
    m = spark.createDataFrame([("s1", "a", "the login page needs a cookie"), ("s1", "b", "done with it"), ("s2", "c", "a cookie recipe"), ("s3", "d", None)], "session_id string, message_id string, content string")
    e = vectors.hashing_embedder()
    rows = [("s1", 0, "login page cookie"), ("s2", 0, "cookie recipe for all"), ("s3", 0, "")]
    c = spark.createDataFrame([(a, b, t, e([t])[0]) for a, b, t in rows], "session_id string, chunk_index int, content string, embedding array<float>")
    a = spark.createDataFrame([("s2", "tag", "food"), ("s3", "tag", "food"), ("s3", "tag", "ops")], "session_id string, type string, value string")
    return s, m, c, a, e


def test_search_all(spark):
    s, m, c, a, e = tables(spark)
    raw = [(1, "find me sessions about login cookie"), (2, "cookie harness:beta"), (3, "project:BLOG"), (4, "#tag:food #tag:ops"), (5, ""), (6, "after:7d"), (7, "cookie harness:gamma"), (8, "zebra"), (9, "deploy")]
    asked = spark.createDataFrame(raw, "qid int, raw string")
    found = hybrid.search_all(asked, s, m, c, a, NOW(), e)
    rows = found.collect()
    ids = lambda q: [r.session_id for r in sorted((r for r in rows if r.qid == q), key=lambda r: r.rank)]
    assert ids(1)[0] == "s1" and ids(2) == ["s2"] and ids(3) == ["s3", "s2"] and ids(4) == ["s3"] and ids(5) == [] and ids(6) == ["s3"] and ids(7) == [] and ids(8) == [] and ids(9) == ["s3"]
    one = next(r for r in rows if r.qid == 1 and r.session_id == "s1")
    assert one.match_source == "semantic" and one.match_snippet == "login page cookie" and one.score == 1.0
    assert next(r for r in rows if r.qid == 9).match_source == "metadata" and next(r for r in rows if r.qid == 3).score == 1.0
    plain = hybrid.search_all(asked.filter("qid = 1"), s, m, c, a, NOW()).collect()
    assert [(r.session_id, r.match_source, r.match_snippet) for r in plain] == [("s1", "keyword", "the login page needs a cookie")]
    assert [r.project_name for r in hybrid.present(found.filter("qid = 3"), s).collect()] == ["blog", "blog"]
    log = {r.raw: (r.result_count, r.top_ids) for r in hybrid.log_rows(found, asked, 5.0).collect()}
    assert log["project:BLOG"] == (2, ["s3", "s2"]) and log[""] == (0, [])


def test_observed_and_deleted(spark):
    s, m, c, a, _ = tables(spark)
    rows, seen = stats.observed(m, "m")
    rows.collect()
    assert seen.get["rows"] == 4
    left = store.delete_sessions({"sessions": s.withColumn("parent_id", F.lit("s1")), "messages": m, "annotations": a}, s.filter("id = 's1'"))
    assert [r.parent_id for r in left["sessions"].collect()] == [None, None] and left["messages"].count() == 2
    fresh = spark.createDataFrame([("s2", "tag", "new", None), ("gone", "tag", "x", "manual")], "session_id string, type string, value string, source string")
    kept, waiting = store.sync_annotations(a.withColumn("source", F.lit("hook")), fresh, s)
    assert sorted((r.session_id, r.value, r.source) for r in kept.collect()) == [("s2", "new", "hook"), ("s3", "food", "hook"), ("s3", "ops", "hook")] and waiting.count() == 1
    assert [r.id for r in stats.parents_and_children(s.withColumn("is_child", F.col("id") == "s2"))[1].collect()] == ["s2"]


def test_scores_do_not_hang_on_the_order_of_terms(spark):
    import random

    from sessionlake.operators import search

    values = [random.Random(3).uniform(0, 40) for _ in range(60)]
    sums = set()
    for seed in range(20):
        random.Random(seed).shuffle(values)
        sums.add(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).agg(search.exact_sum(F.col("x"))).first()[0])
    assert len(sums) == 1 and abs(sums.pop() - sum(values)) < 1e-9
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(d, f"s{d}", " ".join(random.Random(d).sample(words, 30) + [f"w{i}" for i in range(0, 30, 4)])) for d in range(40)] + [(d, "o", f"w{d % 30} w{d * 7 % 30}") for d in range(40, 90)], "doc long, session string, text string")
    asked = search.terms_of(spark.createDataFrame([(1, " ".join(words))], "qid int, text string"))
    found = search.best_of_sessions(search.scored_docs(search.build_index(docs, "doc", "session", ["text"]), asked), None).collect()
    assert len(found) == 40 and len({r.score for r in found}) == 1


def test_a_frequent_word_meets_the_rarest_words_documents_only(spark):
    from sessionlake.operators import search

    docs = spark.createDataFrame([(d, "s", "all words" + (" rare" if d == 5 else "")) for d in range(200)], "doc long, session string, text string")
    asked = search.terms_of(spark.createDataFrame([(q, "all words rare") for q in range(50)] + [(99, "all missing")], "qid int, text string"))
    found = search.scored_docs(search.build_index(docs, "doc", "session", ["text"]), asked)
    assert sorted((r.qid, r.doc) for r in found.collect()) == [(q, 5) for q in range(50)]


def test_a_fresh_index_splits_each_text_once(spark):
    """once for the asked terms' postings and lengths together; documents without an asked term, without a word, or of a number that two have, count too."""
    import math

    import pytest

    from sessionlake.operators import search

    seen = spark.sparkContext.accumulator(0)

    def tell(text):
        seen.add(1)
        return text

    rows = [(1, 10, "red blue red"), (2, 10, "Blue"), (3, 11, "green"), (4, 11, None), (5, 12, "red"), (5, 13, "red blue"), (None, 14, "red")]
    docs = spark.createDataFrame(rows, "doc long, session long, text string")
    read = docs.withColumn("text", F.udf(tell, "string").asNondeterministic()("text"))
    asked = search.terms_of(spark.createDataFrame([(1, "red blue"), (2, "blue"), (3, "pink")], "qid int, text string"))
    found = {(r.qid, r.doc, r.session_id): round(r.score, 9) for r in search.scored_docs(search.build_index(read, "doc", "session", ["text"]), asked).collect()}
    assert seen.value == len(rows)
    assert set(found) == {(1, 1, 10), (1, 5, 12), (1, 5, 13), (2, 1, 10), (2, 2, 10), (2, 5, 12), (2, 5, 13)}
    weight = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (9 / 7)))
    idf = lambda df: max(math.log((7 - df + 0.5) / (df + 0.5)), 0) or 1e-6
    assert found[1, 5, 13] == pytest.approx(idf(3) * weight(2, 2) + idf(3) * weight(1, 2), abs=1e-8)
    assert found[1, 1, 10] == pytest.approx(idf(3) * weight(2, 3) + idf(3) * weight(1, 3), abs=1e-8)


def test_postings_of_a_fresh_index_are_kept_many_documents_a_row(spark, monkeypatch):
    """so that counting and finding the rarest word's documents don't read a row for each word of a document; a cut between documents changes nothing."""
    from collections import Counter

    from sessionlake.operators import search

    texts = [f"Same words, été ñez w{d % 7}" for d in range(300)] + ["", None, " .　", "\x00a\x00b", "a  Á \U0001d7d8b", "ÉTÉ-" * 40]
    docs = spark.createDataFrame([(d, "s", t) for d, t in enumerate(texts)], "doc long, session string, text string").coalesce(1)
    index = search.build_index(docs, "doc", "session", ["text"])
    asked = search.terms_of(spark.createDataFrame([(1, "same words"), (2, "w3 words"), (3, "a b")], "qid int, text string"))
    want = {(r.doc, r.term): r.tf for r in index.postings.collect()}
    lengths = Counter()
    for (doc, _), tf in want.items():
        lengths[doc] += tf
    for most, rows in (8 << 20, 5), (100, None):
        monkeypatch.setattr(search, "TOLD", most)
        own = search.sifted(index, asked)
        assert rows is None or own.lists.count() == rows
        assert {(r.doc, r.term): r.tf for r in own.postings.collect()} == {k: v for k, v in want.items() if k[1] in ("same", "words", "w3", "a", "b")}
        assert {r.doc: r.length for r in own.lengths.collect()} == {d: lengths[d] for d in range(len(texts))}
        assert {r.term: r.df for r in own.terms.collect()} == Counter(t for _, t in want if t in ("same", "words", "w3", "a", "b"))


def test_queries_of_the_same_terms_are_searched_once(spark, monkeypatch):
    """so that pairs of query and document don't grow with the queries that ask the same."""
    from sessionlake.operators import search

    docs = spark.createDataFrame([(d, f"s{d % 7}", f"same words w{d % 5}") for d in range(90)], "doc long, session string, text string")
    texts = ["same words", "words same", "w3", "w3 missing", ""]
    terms = search.terms_of(spark.createDataFrame([(q, texts[q % 5]) for q in range(200)], "qid long, text string"))
    index = search.build_index(docs, "doc", "session", ["text"])
    want = search.best_of_sessions(search.scored_docs(index, terms), 4)
    asked, scored = [], search.scored_docs
    monkeypatch.setattr(search, "scored_docs", lambda index, terms, *more: asked.append(terms.select("qid").distinct().count()) or scored(index, terms, *more))
    rows = lambda df: sorted(map(tuple, df.select("qid", "session_id", "doc", "score", "rank").collect()))
    assert rows(search.best_of_all(index, terms, 4)) == rows(want) and asked == [3]


def test_a_term_adds_what_it_adds_in_sql_to_the_last_bit(spark):
    """factors are multiplied in the SQL's order, so documents tie where its terms do."""
    import random

    from pyspark.sql import functions as F

    from sessionlake.operators import search

    r = random.Random(8)
    rows = [(d, "s", " ".join(["word"] * (d % 9 if d % 3 else 0) + ["x"] * r.randint(1, 400))) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc long, session string, text string")
    asked = search.terms_of(spark.createDataFrame([(1, "word")], "qid int, text string"))
    n = {d: (t.split().count("word"), len(t.split())) for d, _, t in rows}
    df, avg = sum(tf > 0 for tf, _ in n.values()), sum(size for _, size in n.values()) / len(n)
    df_only = [d for d in n if n[d][0]]
    assert df > 150  # so its rarity is the least there is
    few = docs.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc"), F.lit("s").alias("session"), F.lit("y").alias("text")))
    for given, idf, mean in ((docs, 1e-6, avg), (few, spark.range(1).select(F.log(F.lit((700 - df + 0.5) / (df + 0.5)))).first()[0], (avg * 300 + 400) / 700)):
        got = {x.doc: x.score for x in search.scored_docs(search.build_index(given, "doc", "session", ["text"]), asked).collect()}
        want = {d: idf * n[d][0] * 2.2 / (n[d][0] + 1.2 * (0.25 + 0.75 * n[d][1] / mean)) for d in df_only}
        assert {d: s for d, s in got.items() if s != want[d]} == {}
