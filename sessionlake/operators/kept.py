"""Kept tables that cost what changes: rows in buckets of a key, runs that add files to the buckets they touch, one pointer for all tables.

A table is a list of parts, each written by one run in folders of buckets. A run that replaces keys writes their fresh rows and a list of the
keys; what older parts hold of these keys counts no more. So a run writes its own rows and nothing else, and files of untouched
buckets stay as they are. Readers take buckets without replaced keys as they are, and drop replaced rows from the others.
Buckets with many parts are written anew now and then (compact).

All tables of a run are published together, by one small file that is made only if no other run has made it: a job that dies leaves the
run before it, and of two writers that began at the same run the second fails.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sessionlake.operators.packing import without_shuffles

BUCKET, KEY, RUN = "_bucket", "_key", "_run"
LISTED = 256  # parts whose list of files is remembered
MOST_BUCKETS = 64  # a bucket is a folder in each part, to be made and listed; over this, buckets grow, and large ones are written and read by several tasks


class Conflict(RuntimeError):
    """Another run was published since this one began."""


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(n: int, per_bucket: int) -> int:
    """How many buckets a table of n rows gets: of about per_bucket rows, as long as folders stay few, as each is listed in every part."""
    return min(MOST_BUCKETS, max(1, -(-n // per_bucket)))


class Tables:
    """A folder of kept tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._listed: dict[str, DataFrame] = {}

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, at: str) -> list[str]:
        fs, path = self._path(at)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def state(self) -> dict:
        """The last published run: its number and its tables."""
        for name in reversed(self._names(f"{self.folder}/runs")):
            fs, path = self._path(f"{self.folder}/runs/{name}")
            stream = fs.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):  # else it is still being written
                return json.loads(text)
        return {"run": 0, "tables": {}}

    def run(self) -> Run:
        """A run on top of the last one."""
        return Run(self, self.state())

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """The table as the last run has it; only: some of its buckets."""
        return rows_of(self, self.state()["tables"][name], only)

    def has(self, name: str) -> bool:
        return name in self.state()["tables"]

    def files(self, name: str) -> dict[int, list[str]]:
        """The folders of each bucket's rows."""
        out: dict[int, list[str]] = {}
        for part in self.state()["tables"][name]["rows"]:
            for b in part["buckets"]:
                out.setdefault(b, []).append(f"{part['dir']}/{BUCKET}={b}")
        return out

    def vacuum(self) -> int:
        """Removes folders that the last run does not refer to; only when nothing reads an older one. Returns how many."""
        held = {p["dir"].rpartition("/")[2] for t in self.state()["tables"].values() for p in t["rows"] + t["gone"] + t.get("bounds", [])}
        loose = [n for n in self._names(f"{self.folder}/data") if n not in held]
        for n in loose:
            fs, path = self._path(f"{self.folder}/data/{n}")
            fs.delete(path, True)
        return len(loose)

    def delete(self, table: DataFrame) -> None:
        """Removes the folder of a written table that nothing reads any more."""
        for at in {f.rpartition("/")[0] for f in table.inputFiles()}:
            fs, path = self._path(at)
            fs.delete(path, True)

    def scan(self, part: dict, schema: StructType, only: set[int] | None = None) -> DataFrame | None:
        """A part's rows in its live buckets, or in some of them."""
        wanted = [b for b in part["buckets"] if only is None or b in only]
        if not wanted:
            return None
        df = self.listed(part["dir"], schema)
        return (df if len(wanted) == part["written"] else df.filter(F.col(BUCKET).isin(wanted))).select(*[f"`{c}`" for c in schema.names])


    def listed(self, at: str, schema: StructType = StructType()) -> DataFrame:
        """The files of a part with these columns and the bucket. A part never changes, so its folders are listed once, however often it is read."""
        df = self._listed.get(at)
        if df is None or not set(schema.names) <= set(df.columns):
            if len(self._listed) >= LISTED:
                self._listed.clear()
            df = self._listed[at] = self.spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(at)
        return df


def union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return empty if out is None else out


def rows_of(kept: Tables, table: dict, only: Iterable[int] | None = None) -> DataFrame:
    """A table's rows: those of buckets without replaced keys as they are, the others less what was replaced after they were written."""
    schema, only = StructType.fromJson(json.loads(table["schema"])), None if only is None else set(only)
    last: dict[int, int] = {}
    for g in table["gone"]:
        for b in g["buckets"]:
            last[b] = max(last.get(b, 0), g["run"])
    clean, dirty, mixed = [], [], set()
    for part in table["rows"]:
        old = {b for b in part["buckets"] if last.get(b, 0) > part["run"] and (only is None or b in only)}
        mixed |= old
        clean.append(kept.scan(part, schema, {b for b in part["buckets"] if b not in old and (only is None or b in only)}))
        d = kept.scan(part, schema, old)
        dirty.append(None if d is None else d.withColumn(RUN, F.lit(part["run"])))
    found = [df for df in clean if df is not None]
    if mixed:
        rows, gone = union([df for df in dirty if df is not None], None), replaced(kept, table["gone"], mixed)
        found.append(rows.join(gone, (rows[table["key"]] == gone[KEY]) & (gone["_after"] > rows[RUN]), "left_anti").select(*[f"`{c}`" for c in schema.names]))
    return union(found, kept.spark.createDataFrame([], schema))


def replaced(kept: Tables, gone: list[dict], only: set[int] | None = None) -> DataFrame | None:
    """_key, _after: the last run that replaced each key."""
    parts = []
    for g in gone:
        df = kept.scan(g, StructType.fromJson(json.loads(g["schema"])), only)
        if df is not None:
            parts.append(df.withColumn("_after", F.lit(g["run"])))
    return union(parts, None).groupBy(KEY).agg(F.max("_after").alias("_after")) if parts else None


class Run:
    """Changes to tables that become visible together."""

    def __init__(self, kept: Tables, state: dict) -> None:
        self.kept, self.state = kept, copy.deepcopy(state)
        self.number = self.state["run"] = self.state["run"] + 1
        self.tables = self.state["tables"]

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """The table with this run's changes."""
        return rows_of(self.kept, self.tables[name], only)

    def part(self, df: DataFrame, key: str, buckets: int, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict:
        """df written in folders of buckets; a bucket that is far larger than others is written by several tasks. then: what is done to rows where they are written, which keeps their bucket."""
        at = f"{self.kept.folder}/data/{self.number:09d}-{uuid.uuid4().hex[:8]}"
        with without_shuffles(self.kept.spark):
            then(df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)).write.partitionBy(BUCKET).parquet(at)
        own = sorted(int(n.partition("=")[2]) for n in self.kept._names(at) if n.startswith(BUCKET))
        return {"dir": at, "run": self.number, "buckets": own, "written": len(own)}

    def whole(self, name: str, df: DataFrame, key: str, buckets: int) -> dict:
        """The table from nothing; what it was before is gone."""
        part = self.part(df, key, buckets)
        self.tables[name] = {"key": key, "buckets": buckets, "schema": df.schema.json(), "rows": [part], "gone": []}
        return part

    def keys(self, touched: DataFrame, key: str, buckets: int) -> dict:
        """Written keys that replace() takes, for one or more tables of as many buckets."""
        own = touched.select(F.col(key).alias(KEY)).filter(F.col(KEY).isNotNull()).distinct()
        return self.part(own, KEY, buckets) | {"schema": own.schema.json()}

    def read_keys(self, gone: dict, key: str) -> DataFrame:
        """The keys again."""
        schema = StructType.fromJson(json.loads(gone["schema"]))
        found = self.kept.scan(gone, schema)
        return (self.kept.spark.createDataFrame([], schema) if found is None else found).withColumnRenamed(KEY, key)

    def read_part(self, name: str, part: dict) -> DataFrame:
        """The rows of the table that were written as one part, again."""
        schema = StructType.fromJson(json.loads(self.tables[name]["schema"]))
        found = self.kept.scan(part, schema)
        return self.kept.spark.createDataFrame([], schema) if found is None else found

    def replace(self, name: str, fresh: DataFrame | None, gone: dict) -> dict | None:
        """All rows of the keys go, fresh ones come: columns by name, null where fresh has none. Only these are written."""
        table = self.tables[name]
        schema, part = StructType.fromJson(json.loads(table["schema"])), None
        if fresh is not None:
            own = fresh.select(*[(F.col(f"`{f.name}`") if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            part = self.part(own, table["key"], table["buckets"])
            table["rows"].append(part)
        table["gone"].append(gone)
        return part

    def compact(self, name: str, most: int = 4) -> list[int]:
        """Buckets with more than `most` parts, replaced keys included, are written anew as one. Returns these buckets."""
        table, held = self.tables[name], {}
        for p in table["rows"] + table["gone"]:
            for b in p["buckets"]:
                held[b] = held.get(b, 0) + 1
        many = sorted(b for b, n in held.items() if n > most)
        if many:
            part = self.part(self.read(name, many), table["key"], table["buckets"])
            for kind in ("rows", "gone"):
                for i, p in enumerate(table[kind]):
                    table[kind][i] = p | {"buckets": [b for b in p["buckets"] if b not in set(many)]}
                table[kind] = [p for p in table[kind] if p["buckets"]]
            table["rows"].append(part)
        return many

    def publish(self) -> int:
        """Makes the run the last one, or raises Conflict."""
        fs, path = self.kept._path(f"{self.kept.folder}/runs/{self.number:09d}")
        if fs.exists(path):
            raise Conflict(str(path))
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise Conflict(str(path)) from e
        stream.write(bytearray((json.dumps(self.state) + "\n").encode()))
        stream.close()
        return self.number


def rows_in(kept: Tables, part: dict | None, schema: StructType = StructType()) -> int:
    """How many rows a part has, by its files' footers. schema: what is read of it later, so that it is listed once."""
    return kept.listed(part["dir"], schema).count() if part and part["buckets"] else 0
