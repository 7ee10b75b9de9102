"""Helpers that the operators share: scratch tables in the cluster's shared folder, Arrow mapping, key columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own if all tasks run in this process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's setting by which a query's shuffle files go when it has ended; what save() has written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """df as a written table: cuts the lineage, and survives the loss of executors.

    With `by`, the table is bucketed by that column, so that later groups of it need no shuffle of this side.
    """
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        if by is None:
            df.write.parquet(at)
            return spark.read.schema(df.schema).parquet(at)
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
        df.write.bucketBy(buckets, by).option("path", at).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.conf.set(CLEANUP, before)


def drop(*tables: DataFrame) -> None:
    """Removes tables of save() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str, columns: str) -> DataFrame:
    """The named columns of a table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns.split())


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], batch: int = 256, binary: tuple[str, ...] = ("text",)) -> DataFrame:
    """mapInArrow with column lists: rows() gets an iterator of {column: list} of at most `batch` rows; text columns come as UTF-8 bytes.

    A column named CARRIED goes through untouched as the last one; rows() must then give a row for each row, batch by batch.
    """
    carried = CARRIED in df.columns
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = None, deque()

        def parts():
            for b in batches:
                for i in range(0, b.num_rows, batch):
                    part = b.slice(i, batch)
                    if carried:
                        waiting.append(part.column(CARRIED))
                    yield {n: (part.column(n).cast(pa.binary()) if n in binary else part.column(n)).to_pylist() for n in part.schema.names if n != CARRIED}

        for cols in rows(parts()):
            own = [waiting.popleft()] if carried else []
            out = out or arrow_schema(schema)
            arrays = [pa.array(cols[f.name], f.type) for f in out] + own
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*out, *[pa.field(CARRIED, x.type) for x in own]]))
            del cols, arrays, own
        trim()

    kinds = StructType.fromDDL(schema)
    return df.mapInArrow(run, kinds.add(CARRIED, df.schema[CARRIED].dataType) if carried else kinds)


#: Spark's setting of the bytes that go to a Python worker at once, its own default, and what map_rows() takes in its place:
#: ten thousand whole texts would be held by the JVM and by the worker, some times over, before a batch of a few hundred begins.
BATCH_BYTES, DEFAULT_BYTES, SMALL_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers BATCH_BYTES for the session, unless its user has set another value. No result depends on it."""
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(DEFAULT_BYTES):
        spark.conf.set(BATCH_BYTES, str(SMALL_BYTES))


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What make() gave in this worker process, which Spark uses again for later tasks. One key at a time: what an operator
    before it has left behind goes, so a job of several stages doesn't add up their vocabularies."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Gives memory that a finished task has freed back to the system: the worker process stays, and the next stage may be the JVM's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc's
        libc.malloc_trim(0)


#: A row of documents as one column, for decisions that are to go along with it.
CARRIED = "carried"


#: Spark's type names as Arrow types.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, ..."; array<type> is a list."""
    fields = []
    for item in schema.split(","):
        name, kind = item.split()
        fields.append(pa.field(name, pa.list_(pa.field("element", ARROW[kind[6:-1]])) if kind.startswith("array<") else ARROW[kind]))
    return pa.schema(fields)


def whole(docs: DataFrame, carry: bool) -> list[F.Column]:
    """The column that carries rows of docs along, if it is wanted."""
    return [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(CARRIED)] if carry else []


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of a key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


class WordIndex:
    """Numbers the distinct words of batches of texts, `keep` of them or so at once; new ones get the next numbers."""

    def __init__(self, keep: int) -> None:
        self.keep, self.words = keep, pa.array([], pa.string())

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, list[int], pa.Array]:
        """The number of each word, where each text's words begin (and the last end), and the words not seen before, in the
        order of their numbers. After more than `keep` words all are forgotten: then all words are new, and numbers start at 0 again."""
        if len(self.words) > self.keep:
            self.words = pa.array([], pa.string())
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        places, new = pc.index_in(coded.dictionary, self.words), pa.array([], pa.string())
        if places.null_count:
            new = coded.dictionary.filter(places.is_null())
            self.words = pa.concat_arrays([self.words, new])
            places = pc.index_in(coded.dictionary, self.words)
        return places.to_numpy()[coded.indices.to_numpy()] if len(places) else np.zeros(0, np.int64), split.offsets.to_pylist(), new
