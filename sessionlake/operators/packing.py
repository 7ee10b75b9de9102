"""Packing items in order to a budget, for sessions of any length: no task holds a session.

The fold "a new chunk begins where the total would pass the budget" looks sequential, as where a chunk begins depends on
where the one before it began. But where the next chunk begins, if one begins at an item, follows from running totals
alone; so every item gets a pointer, and the starts that are reached from a session's first item are marked by
doubling: after k rounds of self-joins the first 2^k chunks of every session are known.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sequence numbers of a block: running totals are taken in blocks, and over blocks.
BLOCK = 4096


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; where none is set, in a temporary one if all tasks run in this process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{at.rstrip('/')}/sessionlake/{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here go when it has ended, as nothing needs them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a written table: cuts the lineage, and survives the loss of executors."""
    at = scratch(df.sparkSession)
    with without_shuffles(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def running(df: DataFrame, value: Column, out: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """Adds the running total of value in each session, by `order` of which the first, a number, is cut into blocks; its nulls come first.

    A window holds a block, or a row for each block of a session.
    """
    part = F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(1 << 62)))
    own = df.withColumns({"_part": part, "_value": value})
    sums = own.groupBy("session_id", "_part").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("session_id").alias("_session"), F.col("_part").alias("_block"), before.alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("session_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = own.withColumn("_inside", inside).join(sums, F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_part") == F.col("_block")))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).select(*[f"`{c}`" for c in df.columns if c != out], out)


def reached(pointers: DataFrame) -> DataFrame:
    """session_id, at: all places that pointers (session_id, at, to) lead to from place 0, which is not among them. `to` is always over `at`."""
    jumps, found, number = pointers, None, 0
    while True:
        jumps = written(jumps)
        if not jumps.limit(1).count():
            return found if found is not None else jumps.select("session_id", F.col("at"))
        first = jumps.filter("at = 0").select("session_id", F.col("to").alias("at"))
        if found is not None:
            far = jumps.select(F.col("session_id").alias("_s"), F.col("at").alias("_at"), "to")
            first = first.unionByName(found.join(far, found["session_id"].eqNullSafe(F.col("_s")) & (found["at"] == F.col("_at"))).select("session_id", F.col("to").alias("at")))
            first = first.unionByName(found)
        number += 1
        found = first if number % 3 else written(first)  # a plan that isn't cut doubles in each round
        again = jumps.select(F.col("session_id").alias("_s"), F.col("at").alias("_at"), F.col("to").alias("_to"))
        jumps = jumps.join(again, jumps["session_id"].eqNullSafe(F.col("_s")) & (jumps["to"] == F.col("_at"))).select("session_id", "at", F.col("_to").alias("to"))


def packed(items: DataFrame, budget: int, order: list[str], size: str = "tokens", block: int = BLOCK) -> DataFrame:
    """Adds inner, the number from 0 of each item's chunk in its session: items in order fill a chunk to the budget, none is cut, one over it stands alone.

    items: session_id, a size of 1 at least, and the columns of `order`, the first of them a number. Rows that are equal in order may come either
    way, but stay so. A null session is a session of its own. An empty table gives an empty result.
    """
    end = F.col("_end")
    placed = written(running(items, F.col(size).cast("long"), "_end", order, block).withColumn("_start", end - F.col(size)))
    # A chunk from _start takes what ends by _start + budget, or its first item alone. The next one begins with the item that lies across that place.
    goal = F.greatest(F.col("_start") + budget, end)
    asked = placed.select("session_id", F.col("_start").alias("at"), goal.alias("goal"), F.floor(goal / budget).alias("slot"))
    slots = F.explode(F.sequence(F.floor(F.col("_start") / budget), F.floor((end - 1) / budget)))
    lies = placed.select(F.col("session_id").alias("_s"), F.col("_start").alias("to"), end.alias("past"), slots.alias("_slot"))
    pointers = asked.join(lies, asked["session_id"].eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_slot")) & (F.col("to") <= F.col("goal")) & (F.col("goal") < F.col("past"))).select("session_id", "at", "to")
    starts = reached(pointers).select(F.col("session_id").alias("_s"), F.col("at").alias("_at"))
    marked = placed.join(starts, placed["session_id"].eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_at")), "left").withColumn("_first", F.col("_at").isNotNull().cast("long"))
    return running(marked, F.col("_first"), "inner", ["_start"], block * budget).withColumn("inner", F.col("inner").cast("int")).select(*[f"`{c}`" for c in items.columns], "inner")
