"""Vectors as integers: floor(256 * component), for operators whose scores and distances are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 1 << 24  # of a component as an integer, so that sums of products of some thousands of components are long integers


def integers(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and x (array<int>) of rows whose vector can be used.

    Left out: null vectors, those with null or non-finite components, those with a component of 65,536 or more either way, and those of
    another length than most (the longer one, if two are as frequent). Other columns are left out; repeated rows stay.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(SCALE * c) < LARGEST))
    x = F.transform(v, lambda c: F.floor(SCALE * c).cast("int"))
    found = rows.filter(fine).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    size = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found.filter(F.size("x") == size["size"]) if size else found


def named(label: str) -> Column:
    """A label as text, null as one of its own."""
    return F.when(F.col(label).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(label).cast("string")))


#: The same for the test tables in SQL.
VECTORS_SQL = """SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""
