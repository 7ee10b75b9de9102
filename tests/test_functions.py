import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.functions import derive as dv
from sessionlake.functions import queries as fq
from sessionlake.functions import text as tx
from sessionlake.operators import chunks, search, store, vectors


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("word, stem", [x.split(":") for x in "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper feudalism:feudal hopefulness:hope formality:formal triplicate:triplic goodness:good revival:reviv adjustment:adjust adoption:adopt effective:effect probate:probat rate:rate controlling:control roll:roll".split()])
def test_porter(word, stem):
    assert tx.porter(word) == stem


@pytest.mark.parametrize("text, needle, want", [("aaa", "aa", [0, 1]), ("a.b.A", "a", [0, 4]), ("x\nΣΣΣ y", "σσ", [2, 3]), ("abc", "", []), ("a+b", "+b", [1]), ("line\none", "e\no", [3])])
def test_occurrences(spark, text, needle, want):
    assert value(spark, tx.occurrences(F.lit(text), F.lit(needle))) == want


def test_line_col(spark):
    got = [tuple(value(spark, tx.line_col(F.lit("ab\ncd\n"), F.lit(i)))) for i in range(7)]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize("text, want", [
    ("7d", dt.datetime(2024, 5, 24)), ("24h", dt.datetime(2024, 5, 30)), ("2W", dt.datetime(2024, 5, 17)), ("1m", dt.datetime(2024, 5, 1)), ("2024-01-15", dt.datetime(2024, 1, 15)),
    ("2024/02/03", dt.datetime(2024, 2, 3)), ("03-09", dt.datetime(2024, 3, 9)), ("3/9", dt.datetime(2024, 3, 9)), ("2024-01-15T10:30:00", dt.datetime(2024, 1, 15, 10, 30)), ("not-a-date", None), ("2024-13-45", None), ("", None), (None, None),
])
def test_date_value(spark, text, want):
    assert value(spark, fq.date_value(F.lit(text).cast("string"), F.lit("2024-05-31").cast("timestamp"))) == want


@pytest.mark.parametrize("raw, want", [
    ("find the sessions where we worked on login flows", "login flows"), ("what sessions did we discuss about caching?", "caching?"), ("Which chats built with spark", "spark"),
    ('sessions about "auth"', '"auth'), ("sessions about auth", "auth"), ("worked on parsing please", "parsing"), ("show me retries", "retries"), ("plain words", "plain words"), ("  ", ""),
])
def test_topic(spark, raw, want):
    assert value(spark, fq.topic(F.lit(raw))) == want


def test_parse_hybrid(spark):
    rows = [(1, "fix #tag:a-b harness:x harness:Y project:'a b' after:1d"), (2, "xharness:no before:bad"), (3, None)]
    got = {r.qid: r for r in fq.parse_hybrid(spark.createDataFrame(rows, "qid int, raw string"), F.lit("2024-05-31").cast("timestamp")).collect()}
    assert (got[1].text, got[1].tags, got[1].harness, got[1].project, got[1].after_ts) == ("fix", ["a-b"], "Y", "a b", dt.datetime(2024, 5, 30))
    assert (got[2].text, got[2].harness, got[2].before_ts) == ("xharness:no", None, None) and (got[3].text, got[3].tags) == ("", None or [])


def test_query_terms(spark):
    ask = lambda q: value(spark, tx.query_terms(F.lit(q)))
    assert ask("find the login flow") == ["login", "flow"] and ask("ctrl+A") == ["ctrl", "a"] and ask("the") == [] and ask("how can") == ["how", "can"] and ask("") == []


@pytest.mark.parametrize("prompt, folder, label", [
    ("<command-message>x", "", "command-message"), (" WARMUP ", "", "warmup"), ("autopilot: no questions", "", "autopilot"), ("@spirit.md go", "", "torus-orchestrated"), ("x", "a/merkabah-workers/worker-12", "merkabah-worker-12"),
    ("x", "a/Merkabah-Workers", "merkabah-worker"), ("# Worker prompt one task", "", "torusv3-worker"), ("@vision.md @altar.json", "", "ophanim-worker"), ("call subagent_type now", "", "now"), ("call subagent_type", "", "task-subagent"), ("hello", "", ""), (None, None, ""),
])
def test_worker_class(spark, prompt, folder, label):
    assert value(spark, dv.worker_class(F.lit(prompt).cast("string"), F.lit(folder).cast("string"))) == label


def test_flatten_content(spark):
    items = '[{"type":"text","text":"a"},{"type":"text","text":"<system-reminder>x"},{"type":"tool_result","content":"' + "r" * 60 + '"},"bare",{"type":"image"}]'
    flat = lambda j, **o: value(spark, dv.flatten_content(F.try_parse_json(F.lit(j)), **o))
    assert flat(items) == f"a (tool_result: {'r' * 50}...) bare" and flat(items, text_only=True) == "a bare"
    assert flat('"plain"') == "plain" and flat('"  <system-reminder> x"') == "" and flat("12") == "12" and flat("[]") == ""
    assert flat('[{"type":"tool_result","content":"s"}]', dots="cut") == "(tool_result: s)"


def fold(sizes, budget):
    """Packing as one loop."""
    out, chunk, total = [], -1, 0
    for n in sizes:
        if chunk < 0 or total + n > budget:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out


def test_turns_are_the_fold(spark):
    rng = random.Random(1)
    rows = [(s, i, f"{s}_{i}", "user", "x" * rng.randrange(900)) for s in range(4) for i in range(40)]
    m = spark.createDataFrame(rows, "session_id int, seq int, message_id string, role string, content string")
    want = []
    for s in range(4):
        own = [r for r in rows if r[0] == s]
        sizes = [(len(r[4]) + 8) // 4 for r in own]
        out = fold(sizes, 300)
        for c in range(out[-1] + 1):
            inside = [i for i, k in enumerate(out) if k == c]
            assert sum(sizes[i] for i in inside) <= 300 or len(inside) == 1
            want.append((s, c, own[inside[0]][2], "\n\n".join("[user]: " + own[i][4] for i in inside), sum(sizes[i] for i in inside)))
    assert sorted(tuple(r) for r in chunks.turn_chunks(m, 300).drop("chunk_type").collect()) == want


def test_tool_chunks(spark):
    m = spark.createDataFrame([(1, 0, "a", "user", "run agent-do build all things\nthen agent-do test"), (1, 1, "b", "user", "nothing"), (2, 0, "c", "user", None)], "session_id int, seq int, message_id string, role string, content string")
    got = sorted((r.inner, r.content) for r in chunks.tool_chunks(m).collect())
    assert [c.split("\n")[:2] for _, c in got] == [["Tool: agent-do build", "Command: all things"], ["Tool: agent-do test", "Context: run agent-do build all things"]]


def test_hybrid_scores(spark):
    k = spark.createDataFrame([(1, "a", 4.0), (1, "b", 2.0), (1, "c", 3.0)], "qid int, session_id string, score double")
    v = spark.createDataFrame([(1, "a", 0.9), (1, "d", 0.5)], "qid int, session_id string, score double")
    got = {r.session_id: (round(r.score, 3), r.match_source, r.rank) for r in search.hybrid(k, v).collect()}
    assert got == {"a": (1.0, "semantic", 1), "b": (0.25, "keyword", 3), "c": (0.375, "keyword", 2), "d": (0.25, "semantic", 4)}


def test_vectors_without_length(spark):
    c = spark.createDataFrame([("s", 0, [0.0, 0.0]), ("s", 1, [1.0, 0.0]), ("t", 0, None)], "session_id string, chunk_index int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid int, embedding array<float>")
    assert [(r.qid, r.session_id, r.chunk_index) for r in vectors.vector_search(c, q).collect()] == [(1, "s", 1)]
    assert vectors.vector_search(c, q.filter("false")).count() == 0


def test_backfill_failures_stay_null(spark):
    c = spark.createDataFrame([("s", i, "bad" if i == 3 else f"word{i}", None, None) for i in range(6)] + [("s", 9, None, None, None)], "session_id string, chunk_index int, content string, embedding array<float>, embedding_model string").coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[1.0]] * len(texts)

    got = {r.chunk_index: r.embedding for r in vectors.backfill(c, embed, "m", count=2).collect()}
    assert got == {0: [1.0], 1: [1.0], 2: None, 3: None, 4: [1.0], 5: [1.0], 9: None}


def test_store_keeps_the_last_version(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    for n in (3, 5):
        kept.write("t", spark.range(n))
    kept.set_meta("mark", "1")
    kept.set_meta("mark", "2")
    assert kept.read("t").count() == 5 and kept.get_meta("mark") == "2" and kept.get_meta("none") is None
