"""Transcript files by Spark's own read.format, readStream and write."""

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from sessionlake.operators import incremental
from sessionlake.sources import files
from sessionlake.sources import transcripts as src
from tests.test_sources import write


def folders(**options):
    return files.Folders({k.replace("root_", "root."): str(v) for k, v in options.items()})


def rows(f):
    reader = files.FileReader(f)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_every_cut_gives_the_same_lines(tmp_path):
    text = "one\r\ntwo\n\n  \nthree äöü 漢字\n" + "x" * 50 + "\nlast without an end"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_bytes(text.encode() + b"\nbad \xff byte")
    (tmp_path / "p" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "p" / ".hidden.jsonl").write_bytes(b"no")
    (tmp_path / "p" / "_tmp.jsonl").write_bytes(b"no")
    (tmp_path / "p" / "other.txt").write_bytes(b"no")
    wanted = ["one", "two", "", "  ", "three äöü 漢字", "x" * 50, "last without an end", "bad � byte"]
    for split in (*range(1, 130), 1 << 20):
        own = rows(folders(path=tmp_path, split=split))
        assert [r["value"] for r in sorted(own, key=lambda r: r["place"])] == wanted, split
    assert {(r["harness"], r["folder"], r["stem"], r["file_path"]) for r in own} == {("", "p", "s", f"{tmp_path}/p/s.jsonl")}
    assert sorted(r["value"][:5] for r in rows(folders(path=tmp_path, whole="true"))) == ["", "one\r\n"]
    assert [(r["stem"], r["value"]) for r in rows(folders(path=tmp_path, names="true"))] == [("empty", None), ("s", None)]


def test_short_files_go_together_and_long_ones_apart(tmp_path):
    for i, n in enumerate((10, 10, 10, 100, 10)):
        write(tmp_path / "p" / f"{i}.jsonl", ["y" * n])
    own = files.FileReader(folders(path=tmp_path, split=30)).partitions()
    assert [[(f["stem"], a, b) for f, a, b in p.pieces] for p in own] == [[("0", 0, 10), ("1", 0, 10), ("2", 0, 10)], [("3", 0, 30)], [("3", 30, 60)], [("3", 60, 90)], [("3", 90, 100), ("4", 0, 10)]]


def test_filters_decide_what_is_read(tmp_path):
    for harness in "ab":
        for i in range(3):
            write(tmp_path / harness / "p" / f"{i}.jsonl", ["{}"])
            os.utime(tmp_path / harness / "p" / f"{i}.jsonl", (1000 + i, 1000 + i))
    reader = files.FileReader(folders(root_a=tmp_path / "a", root_b=tmp_path / "b"))
    other = [StringContains(("value",), "x"), EqualTo(("place",), 0)]
    mine = [EqualTo(("harness",), "a"), GreaterThan(("mtime",), datetime.fromtimestamp(1000, UTC)), In(("stem",), ("0", "2"))]
    assert list(reader.pushFilters([*mine, *other])) == other
    assert [(f["harness"], f["stem"]) for p in reader.partitions() for f, _, _ in p.pieces] == [("a", "2")]
    reader = files.FileReader(folders(root_a=tmp_path / "a"))
    assert not list(reader.pushFilters([EqualTo(("harness",), "c")])) and not reader.partitions()[0].pieces


def test_filters_reach_the_source(spark, tmp_path):
    for harness in "ab":
        write(tmp_path / harness / "p" / f"{harness}.jsonl", ['{"x": 1}', "", '{"x": 2}'])
    own = files.read(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"})
    found = own.filter((F.col("harness") == "b") & (F.col("mtime") > F.lit("2000-01-01").cast("timestamp")))
    assert [r.value for r in found.orderBy("place").collect()] == ['{"x": 1}', "", '{"x": 2}']
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString()  # nothing is left to filter above the scan
    assert own.filter("harness = 'b' and mtime < timestamp'2000-01-01'").count() == 0
    assert [(r.id, r.harness, r.reason) for r in incremental.changed(files.manifest(files.read(spark, {"a": f"{tmp_path}/a"}, names="true")), spark.createDataFrame([], "harness string, file_path string, file_mtime timestamp, indexed_at timestamp")).collect()] == [("a", "a", "new")]


def test_a_source_reads_the_same_by_both_ways(spark, tmp_path):
    at = "2024-01-0{}T00:00:00Z".format
    turn = lambda day, role, text: {"type": role, "cwd": "/home/me/app", "timestamp": at(day), "message": {"role": role, "content": text}}
    write(tmp_path / "-home-me" / "s1.jsonl", [turn(1, "user", "please build a page for me"), "{not json", "", turn(2, "assistant", "done"), turn(3, "user", " ")])
    write(tmp_path / "-home-me" / "s2.jsonl", [{"type": "progress"}, turn(2, "user", "x" * 500), turn(4, "assistant", "y" * 500)])
    plain, own = src.ProjectLines(spark, str(tmp_path)), src.ProjectLines(spark, lines=files.lines(files.read(spark, {"jsonl-a": str(tmp_path)}, split="100")))
    assert sorted(map(tuple, own.messages().collect())) == sorted(map(tuple, plain.messages().collect()))
    gone = ["file_path", "file_mtime"]
    same = lambda s: sorted(map(str, s.sessions().drop(*gone).collect()))
    assert same(own) == same(plain) and src.rejects(own.lines).count() == 1


def test_what_is_written_is_read(spark, tmp_path):
    made = [("p", f"s{i % 7}", i, f"line {i} ä" * (i % 5)) for i in range(100)] + [(None, "s", 0, "no"), ("p", None, 0, "no"), ("p", "s1", 1000, None)]
    df = spark.createDataFrame(made, "folder string, stem string, pos int, value string")
    files.write(df, str(tmp_path / "out"))
    files.write(df, str(tmp_path / "out"))
    own = files.read(spark, {"x": str(tmp_path / "out")}, split="64").orderBy("stem", "place").collect()
    assert [(r.folder, r.stem, r.value) for r in own] == [(f, s, v) for f, s, _, v in sorted((x for x in made if x[0] and x[1] and x[3] is not None), key=lambda x: (x[1], x[2]))]
    assert sorted(os.listdir(tmp_path / "out" / "p")) == [f"s{i}.jsonl" for i in range(7)]
    files.write(df.limit(0), str(tmp_path / "none"))
    assert files.read(spark, {"x": str(tmp_path / "none")}).count() == 0


def test_rows_out_of_order_leave_no_half_file(tmp_path):
    from pyspark.sql import Row

    row = lambda stem, value: Row(folder="p", stem=stem, value=value)
    writer = files.FileWriter(str(tmp_path), ".jsonl")
    with pytest.raises(ValueError, match="order"):
        writer.write(iter([row("b", "1"), row("a", "2"), row("b", "3")]))
    with pytest.raises(AttributeError):
        writer.write(iter([row("c", "1"), row("c", None)]))
    assert sorted(os.listdir(tmp_path / "p")) == ["b.jsonl"]


def test_offsets_of_a_stream(tmp_path):
    at = lambda stem, seconds: (write(tmp_path / "p" / f"{stem}.jsonl", [stem]), os.utime(tmp_path / "p" / f"{stem}.jsonl", (seconds, seconds)))
    stream = files.FileStream(folders(path=tmp_path))
    planned = lambda a, b: [f["stem"] for p in stream.partitions(a, b) for f, _, _ in p.pieces]
    start = stream.initialOffset()
    assert stream.latestOffset() == start
    at("a", 1000), at("b", 2000), at("young", datetime.now(UTC).timestamp() + 100)
    first = stream.latestOffset()
    assert first == {"changed": 2_000_000_000} and planned(start, first) == ["a", "b"]
    assert stream.latestOffset() == first and planned(first, first) == []
    at("a", 3000), at("c", 3000)
    second = stream.latestOffset()
    assert planned(first, second) == ["a", "c"]
    assert planned(start, first) == ["b"]  # run again: `a` comes with the later batch


def test_a_stream_takes_each_file_when_it_has_changed(spark, tmp_path):
    got = []
    run = lambda: files.stream(spark, {"x": str(tmp_path / "in")}, settle="0").writeStream.foreachBatch(lambda rows, _: got.append(sorted((r.stem, r.value) for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    write(tmp_path / "in" / "p" / "a.jsonl", ["1"])
    run()
    write(tmp_path / "in" / "p" / "a.jsonl", ["1", "2"])
    write(tmp_path / "in" / "p" / "b.jsonl", ["3"])
    run()
    run()
    assert [x for x in got if x] == [[("a", "1")], [("a", "1"), ("a", "2"), ("b", "3")]]
