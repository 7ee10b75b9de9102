"""Transcript files as a data source of Spark's own: `spark.read.format("transcripts")`, its stream, and its writer.

A row is a line (or with `whole` a file, or with `names` a file without its text): harness, folder, stem, file_path, mtime,
size, place (the line's first byte) and value. Options:

    path            a folder, below which all files count; its rows have `harness` as it is given, or else an empty one
    root.<harness>  more folders, each with the harness that it is named by
    suffix          what files' names end in (.jsonl); names that begin with a dot or underscore are left out
    whole, names    see above; neither is the default
    split           bytes of a task (128 MB): longer files are cut there, shorter ones read together
    settle          seconds for which a file must have stayed as it is before a stream reads it (2)

Filters on all columns but place and value that compare with constants decide which files are read at all, when the job is
planned. A file that is cut gives each line to the piece in which its first byte lies. Bytes that aren't UTF-8 become
U+FFFD, empty lines and files stay what they are, and `place` orders lines whatever the cuts.

A stream's offset is the time up to which files have been read: a batch holds all files changed after the last one and no
later than its own, whole, so a session that has grown comes again with all its lines and may replace what was there
(`streaming.counters.session_sink`). When a batch is run again after a failure, a file that has changed since comes with
the later batch alone. Clocks of writers may differ by `settle`. Listing is one process's work, as is planning in general.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

NAME = "transcripts"
COLUMNS = "harness string, folder string, stem string, file_path string, mtime timestamp, size long, place long, value string"
ARROW = pa.schema([("harness", pa.string()), ("folder", pa.string()), ("stem", pa.string()), ("file_path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("place", pa.int64()), ("value", pa.string())])
BATCH = 4 << 20  # bytes of lines handed on at once
MOST_FILES = 10_000  # of one task
START = datetime(1970, 1, 1, tzinfo=UTC)
SAME_STORE = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}  # other names of stores that Arrow knows

TESTS = {
    EqualTo: lambda x, f: x == f.value,
    In: lambda x, f: x in f.value,
    GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value,
    LessThanOrEqual: lambda x, f: x <= f.value,
    StringStartsWith: lambda x, f: x.startswith(f.value),
    IsNotNull: lambda x, f: True,
}


def open_uri(uri: str) -> tuple[FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it. Credentials come from the environment of drivers and workers."""
    scheme, colon, rest = uri.partition(":")
    return FileSystem.from_uri(SAME_STORE.get(scheme, scheme) + colon + rest)


class File(dict):
    """harness, folder, stem, file_path, mtime, size as columns have them; and where it is: root and path."""

    def passes(self, filters: list[Filter]) -> bool:
        return all(TESTS[type(f)](self[f.attribute[0]], f) for f in filters)


class Pieces(InputPartition):
    """What one task reads: files, each from a byte to another."""

    def __init__(self, pieces: list[tuple[File, int, int]]) -> None:
        super().__init__(len(pieces))
        self.pieces = pieces


class Folders:
    """The folders that options name, and how their files are shared among tasks and read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [(k[5:], v) for k, v in options.items() if k.startswith("root.")]
        if options.get("path"):
            self.roots.append((options.get("harness", ""), options["path"]))
        if not self.roots:
            raise ValueError("transcripts: no folder given")
        self.suffix, self.split, self.settle = options.get("suffix", ".jsonl"), int(options.get("split", 128 << 20)), float(options.get("settle", 2))
        self.names, self.whole = (options.get(k, "false").lower() == "true" for k in ("names", "whole"))

    def files(self, filters: list[Filter]) -> list[File]:
        found = []
        named = [f for f in filters if f.attribute == ("harness",)]
        for harness, root in self.roots:
            if not all(TESTS[type(f)](harness, f) for f in named):
                continue
            fs, base = open_uri(root)
            for info in fs.get_file_info(FileSelector(base, recursive=True)):
                if not info.is_file or not info.base_name.endswith(self.suffix) or info.base_name[0] in "._":
                    continue
                below = info.path[len(base) :].lstrip("/")
                folder = info.path.rsplit("/", 2)[-2]
                file = File(harness=harness, folder=folder, stem=info.base_name[: len(info.base_name) - len(self.suffix)], file_path=f"{root.rstrip('/')}/{below}", mtime=START + timedelta(microseconds=info.mtime_ns // 1000), size=info.size, root=root, path=info.path)
                if file.passes(filters):
                    found.append(file)
        return sorted(found, key=lambda f: (f["harness"], f["path"]))

    def shares(self, files: list[File]) -> list[Pieces]:
        cut = [(f, a, min(a + self.split, f["size"])) for f in files for a in range(0, max(1, f["size"]), self.split)] if not (self.whole or self.names) else [(f, 0, f["size"]) for f in files]
        out, held = [[]], 0
        for f, a, b in cut:
            if out[-1] and (len(out[-1]) >= MOST_FILES or held + b - a > self.split and not self.names):
                out.append([])
                held = 0
            out[-1].append((f, a, b))
            held += b - a
        return [Pieces(x) for x in out if x]

    def read(self, share: Pieces) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        stores = {root: open_uri(root)[0] for root in {file["root"] for file, _, _ in share.pieces}}
        for file, a, b in share.pieces:
            for place, value in self.values(stores[file["root"]], file, a, b):
                rows.append({**file, "place": place, "value": value})
                held += len(value or "") + 200
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def values(self, fs: FileSystem, file: File, a: int, b: int) -> Iterator[tuple[int, str | None]]:
        if self.names:
            yield 0, None
            return
        if self.whole:
            with fs.open_input_file(file["path"]) as raw:
                yield 0, raw.read().decode(errors="replace")
            return
        with fs.open_input_file(file["path"]) as raw, io.BufferedReader(raw, 1 << 20) as lines:
            if a:  # the line that begins before is another piece's
                lines.seek(a - 1)
                a += len(lines.readline()) - 1
            while a < b and (line := lines.readline()):
                yield a, line.removesuffix(b"\n").removesuffix(b"\r").decode(errors="replace")
                a += len(line)


class FileReader(DataSourceReader):
    def __init__(self, folders: Folders) -> None:
        self.folders, self.filters = folders, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] not in ("place", "value"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        return self.folders.shares(self.folders.files(self.filters)) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.folders.read(partition)


class FileStream(DataSourceStreamReader):
    def __init__(self, folders: Folders) -> None:
        self.folders = folders

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        limit = datetime.now(UTC) - timedelta(seconds=self.folders.settle)
        return {"changed": max((micros(f["mtime"]) for f in self.folders.files([]) if f["mtime"] <= limit), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return self.folders.shares([f for f in self.folders.files([]) if start["changed"] < micros(f["mtime"]) <= end["changed"]])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return self.folders.read(partition)


def micros(at: datetime) -> int:
    return (at - START) // timedelta(microseconds=1)


class FileWriter(DataSourceWriter):
    """A file `<path>/<folder>/<stem><suffix>` for each folder and stem, whose rows must come together, in the order of both: see write().

    A file appears under its name when it is whole, so attempts that fail or run twice leave either the same file or none.
    """

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, base = open_uri(self.path)
        key = out = hidden = None

        def done() -> None:
            out.close()
            fs.move(hidden, f"{base}/{key[0]}/{key[1]}{self.suffix}")

        try:
            for row in rows:
                if (row.folder, row.stem) != key:
                    if key is not None:
                        done()
                        out = None
                        if (row.folder, row.stem) < key:
                            raise ValueError("transcripts: rows are not in order of folder and stem")
                    if key is None or row.folder != key[0]:
                        fs.create_dir(f"{base}/{row.folder}", recursive=True)
                    key = row.folder, row.stem
                    hidden = f"{base}/{key[0]}/.{key[1]}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden)
                out.write(row.value.encode() + b"\n")
            if key is not None:
                done()
        finally:
            if out is not None and not out.closed:
                out.close()
                fs.delete_file(hidden)
        return WriterCommitMessage()


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> FileReader:
        return FileReader(Folders(self.options))

    def streamReader(self, schema) -> FileStream:
        return FileStream(Folders(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("suffix", ".jsonl"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TranscriptFiles)


def read(spark: SparkSession, roots: dict[str, str], **options: str) -> DataFrame:
    """Rows of the format from folders by harness."""
    register(spark)
    return spark.read.format(NAME).options(**{f"root.{k}": v for k, v in roots.items()}, **options).load()


def stream(spark: SparkSession, roots: dict[str, str], **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(**{f"root.{k}": v for k, v in roots.items()}, **options).load()


def made(path: str) -> str:
    """The folder, which is there from now on."""
    fs, base = open_uri(path)
    fs.create_dir(base, recursive=True)
    return path


def write(rows: DataFrame, path: str, order: str = "pos", suffix: str = ".jsonl") -> None:
    """rows (folder, stem, value and what orders a file's lines) as files; a file is written by one task, as its lines come. Files of that name are replaced, others stay.

    A null value is left out, and so is a row without a folder or a stem, as no file can have it.
    """
    register(rows.sparkSession)
    made(path)
    own = rows.filter("folder is not null and stem is not null and value is not null").repartition("folder", "stem").sortWithinPartitions("folder", "stem", order)
    own.select("folder", "stem", "value").write.format(NAME).mode("append").option("suffix", suffix).save(path)


def lines(rows: DataFrame) -> DataFrame:
    """Rows as sources of lines take them: file_path, stem, folder, mtime, pos, value, v; blank lines left out."""
    own = rows.filter(F.trim("value") != "")
    return own.select("file_path", "stem", "folder", "mtime", F.struct("place").alias("pos"), "value", F.try_parse_json("value").alias("v"))


def manifest(rows: DataFrame) -> DataFrame:
    """harness, file_path, id, mtime by newest file, as incremental.changed() takes them; ask for `names`."""
    newest = F.struct("mtime", "file_path")
    return rows.groupBy("harness", F.col("stem").alias("id")).agg(F.max(newest).alias("m")).select("harness", "m.file_path", "id", "m.mtime")
