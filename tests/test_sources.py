import json

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import hierarchy, incremental
from sessionlake.sources import transcripts as src


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))


def test_project_lines(spark, tmp_path):
    at = "2024-01-0{}T00:00:00Z".format
    long = "please build a small React page for me"
    write(tmp_path / "-home-me" / "s1.jsonl", [
        {"type": "file-history-snapshot", "messageId": "m"},
        {"type": "user", "cwd": "/home/me/app", "timestamp": at(1), "uuid": "u1", "message": {"role": "user", "content": "short"}},
        "{not json", "",
        {"type": "user", "timestamp": at(2), "message": {"role": "user", "content": [{"type": "text", "text": long}, {"type": "tool_result", "content": "zzz"}]}},
        {"type": "assistant", "timestamp": at(3), "message": {"role": "assistant", "model": "model-1", "content": [{"type": "text", "text": "done"}, {"type": "tool_use", "name": "Task", "input": {"subagent_type": "explore", "description": "look"}}]}},
        {"type": "user", "message": {"role": "user", "content": "<system-reminder>x"}},
    ])
    write(tmp_path / "-home-me" / "s2.jsonl", [{"type": "user", "isSidechain": True, "message": {"role": "user", "content": "a worker's prompt that is long enough"}}])
    write(tmp_path / "-home-me" / "s3.jsonl", [{"type": "progress"}])
    source = src.source("jsonl-a")(spark, str(tmp_path))
    s = {r.id: r for r in source.sessions().collect()}
    assert set(s) == {"s1", "s2"}
    assert (s["s1"].first_prompt, s["s1"].model, s["s1"].project_path, s["s1"].project_name, s["s1"].is_child, s["s1"].message_count) == (long, "model-1", "/home/me/app", "app", False, 3)
    assert (s["s2"].is_child, s["s2"].child_type, s["s2"].project_path) == (True, "sidechain", "/home/me")
    assert [(r.seq, r.role, r.content) for r in source.messages().filter("session_id = 's1'").orderBy("seq").collect()] == [(0, "user", "short"), (1, "user", long), (2, "assistant", "done")]
    assert src.rejects(source.lines).count() == 1
    tasks = source.events().withColumns({"is_child": F.lit(False), "seq": F.lit(0)}).withColumn("content_v", F.col("raw"))
    assert [(r.kind, r.description) for r in hierarchy.task_invocations(tasks).collect()] == [("explore", "look")]


def test_typed_lines(spark, tmp_path):
    meta = lambda i, **x: {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": i, "cwd": "/w/p", **x}}
    write(tmp_path / "a" / "parent.jsonl", [meta("other"), meta("parent"), {"type": "turn_context", "payload": {"model": "m1"}}, {"type": "event_msg", "timestamp": "2024-01-01T00:01:00Z", "payload": {"type": "user_message", "text": " ", "message": "do the thing"}}, {"type": "event_msg", "payload": {"type": "agent_message", "text": "ok"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "exec_command"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "not used"}]}}])
    write(tmp_path / "b" / "c" / "child.jsonl", [meta("child", source={"subagent": {"thread_spawn": {"parent_thread_id": "parent", "agent_role": "scout"}}}), {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": " one "}, {"type": "output_text", "text": "no"}]}}])
    write(tmp_path / "x" / "forked.jsonl", [meta("forked", forked_from_id="parent", source="cli")])
    write(tmp_path / "index.idx", [{"id": "child", "thread_name": "first"}, {"id": "child", "thread_name": " named "}, {"id": "child", "thread_name": " "}])
    (tmp_path / "titles").mkdir()
    (tmp_path / "index.idx").rename(tmp_path / "titles" / "index.jsonl")
    titles = str(tmp_path / "titles" / "index.jsonl")
    source = src.TypedLines(spark, str(tmp_path / "[abx]*"), titles)
    s = {r.id: r for r in source.sessions().collect()}
    assert set(s) == {"parent", "child", "forked"}
    assert (s["parent"].parent_id, s["parent"].tool_calls, s["parent"].message_count, s["parent"].model, s["parent"].first_prompt) == (None, ["exec_command"], 2, "m1", "do the thing")
    assert (s["child"].is_child, s["child"].parent_id, s["child"].child_type, s["child"].title, s["child"].first_prompt) == (True, "parent", "scout", "named", "one")
    assert (s["forked"].parent_id, s["forked"].child_type) == ("parent", "worker")
    linked = hierarchy.explicit_children(source.sessions().withColumn("ts_eff", F.col("ts_end")))
    assert sorted((r.parent_id, r.child_id) for r in linked.collect()) == [("parent", "child"), ("parent", "forked")]


def test_headed_lines(spark, tmp_path):
    write(tmp_path / "p" / "d1.jsonl", [{"type": "session_start", "title": "A title", "cwd": "/w/q"}, {"type": "message", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}, {"type": "tool_result", "content": "r"}]}}])
    (tmp_path / "p" / "d1.settings.json").write_text('{"model": "m9"}')
    (r,) = src.HeadedLines(spark, str(tmp_path)).sessions().collect()
    assert (r.id, r.title, r.model, r.first_prompt, r.project_name) == ("d1", "A title", "m9", "hello (tool_result: r)", "q")


def test_document_tree(spark, tmp_path):
    for session, message, role, parts in (("s1", "m1", "user", ["one", "two"]), ("s1", "m2", "assistant", ["three"]), ("s2", "m3", "user", [])):
        write(tmp_path / "message" / session / f"{message}.json", [{"id": message, "role": role, "time": {"created": 1704067200000}, "modelID": "m", "path": {"cwd": "/c"}}])
        for i, text in enumerate(parts):
            write(tmp_path / "part" / message / f"p{i}.json", [{"type": "text", "text": text}])
    write(tmp_path / "part" / "m3" / "p0.json", ["{broken"])
    write(tmp_path / "session" / "x" / "s1.json", [{"parentID": "s0", "directory": "/d/e"}])
    source = src.DocumentTree(spark, str(tmp_path))
    (r,) = source.sessions().collect()
    assert (r.id, r.first_prompt, r.is_child, r.child_type, r.project_name, r.title) == ("s1", "one\ntwo", True, "worker", "e", "one")
    assert [(m.message_id, m.content) for m in source.messages().orderBy("seq").collect()] == [("m1", "one\ntwo"), ("m2", "three")]


def test_annotations_and_manifest(spark, tmp_path):
    write(tmp_path / "a.json", [[{"ts": "2024-01-01T00:00:00Z", "type": "tag", "value": "x"}]])
    write(tmp_path / "b.json", [{"session_id": "b", "annotations": [{"type": "note", "value": "y", "source": "manual"}]}])
    write(tmp_path / "c.json", ["nothing"])
    got = sorted((r.session_id, r.type, r.value, r.source) for r in src.annotation_files(spark, str(tmp_path)).collect())
    assert got == [("a", "tag", "x", None), ("b", "note", "y", "manual")]
    assert sorted(r.id for r in incremental.manifest(spark, str(tmp_path)).collect()) == ["a", "b", "c"]


def test_rich_text_and_registry(spark):
    tree = json.dumps({"root": {"children": [{"type": "text", "text": "see"}, {"type": "mention", "mentionName": "file"}, {"children": [{"text": "now"}]}]}})
    assert spark.createDataFrame([(tree,), (None,), ("plain",)], "t string").select(src.rich_text("t")).toPandas().iloc[:, 0].tolist() == ["see @file now", None, "plain"]
    with pytest.raises(KeyError):
        src.source("none")

    @src.register
    class Own:
        name = "own"

    assert src.source("own") is Own
    kv = src.KeyValues(spark.createDataFrame([("composerData:1", '{"richText":"a prompt"}'), ("sessionDetails:1", '{"model":"m","lastResponse":"r"}'), (None, None), ("composerData:2", "{broken")], "key string, value string"))
    sessions, messages = src.union_sources([kv])
    assert [(r.id, r.first_prompt, r.last_response) for r in src.newest_first(sessions.withColumns({"ts_start": F.lit(None).cast("timestamp"), "ts_end": F.lit(None).cast("timestamp")})).collect()] == [("1", "a prompt", "r")] and messages.count() == 2


def test_unreadable_source_is_left_out(spark, tmp_path):
    folder = tmp_path / "a" / "p"
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text('{"type": "user", "message": {"role": "user", "content": "a first prompt that is long enough"}}\n')
    failed = {}
    found = src.readable(spark, {"jsonl-a": {"root": str(tmp_path / "a")}, "tree": {"root": str(tmp_path / "gone")}}, failed)
    assert list(failed) == ["tree"] and [x.name for x in found] == ["jsonl-a"]
    sessions, messages = src.union_sources(found, failed)
    assert sessions.count() == 1 and messages.count() == 1
