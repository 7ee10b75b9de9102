"""All occurrences of a table of needles, in one pass over each text.

The needles are an Aho-Corasick automaton, which finds all of them, overlapping ones too, in one reading of a text however many they are. Their strings
are broadcast, in blocks of bounded size, and each worker builds a block's automaton once; texts are read once a block, and only matches are shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import folded_case

MOST = 16_000_000  # characters of the needles of a block
ROWS = 32_768  # matches that a worker holds before it passes them on
_LAST: list = [None, None]  # the needles that this worker's last automaton is of, and it


def automaton(needles: list[str]):
    """The automaton of these needles on this worker, which keeps the last one; values are numbers of needles."""
    import ahocorasick

    if _LAST[0] != needles:
        found = ahocorasick.Automaton()
        for i, n in enumerate(needles):
            found.add_word(n, i)
        found.make_automaton()
        _LAST[:] = [needles, found]
    return _LAST[1]


def matches(text: str, found, needles: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Number of the needle, place (from 0), line and column (from 0) of each occurrence in a text that is folded already, one at a time."""
    starts, at = array("q", [0]), text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    for end, i in found.iter(text):
        place = end - len(needles[i]) + 1
        line = bisect_right(starts, place) - 1
        yield i, place, line, place - starts[line]


def occurrences_of(texts: DataFrame, needles: DataFrame, text: str = "content", needle: str = "needle", most: int = MOST) -> DataFrame:
    """Columns of texts but the text, needle (folded), offset, line, column: without regard to case, overlapping ones too.

    Null texts and null or empty needles match nothing; needles that differ in case alone are one; repeated texts keep their rows. Places are those in the folded text. most: characters
    of needles that are broadcast at once.
    """
    spark, keys = texts.sparkSession, [c for c in texts.columns if c != text]
    own = needles.select(folded_case(needle).alias("needle")).filter("needle <> ''").distinct()
    blocks = max(1, -(-(own.agg(F.sum(F.length("needle"))).first()[0] or 0) // most))
    rows = texts.filter(F.col(text).isNotNull()).select(*[f"`{c}`" for c in keys], folded_case(text).alias("_text"))
    schema = texts.select(*[f"`{c}`" for c in keys]).withColumns({"needle": F.lit(""), "offset": F.lit(0), "line": F.lit(0), "column": F.lit(0)}).schema
    out = None
    for b in range(blocks):
        some = [r["needle"] for r in own.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()]  # `most` characters, about
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            strings = shared.value
            found = automaton(strings) if strings else None
            names = pa.array(strings, pa.string())

            def rows_of(p: pa.RecordBatch, hits: array) -> pa.RecordBatch:
                at, number, *places = np.frombuffer(hits, np.int32).reshape(-1, 5).T
                taken = p.take(pa.array(at, pa.int32()))
                arrays = [taken.column(c) for c in keys] + [names.take(pa.array(number, pa.int32())), *[pa.array(x, pa.int32()) for x in places]]
                return pa.RecordBatch.from_arrays(arrays, names=[*keys, "needle", "offset", "line", "column"])

            for p in batches if strings else ():
                texts, hits = p.column("_text"), array("i")
                for i in range(p.num_rows):
                    for hit in matches(texts[i].as_py(), found, strings):
                        hits.extend((i, *hit))
                        if len(hits) >= 5 * ROWS:
                            yield rows_of(p, hits)
                            hits = array("i")
                if hits:
                    yield rows_of(p, hits)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def find_all(messages: DataFrame, needles: DataFrame) -> DataFrame:
    """session_id, message_id, needle, offset, line, column, and i (from 1) of n in the session for each needle."""
    found = occurrences_of(messages.select("session_id", "message_id", "seq", "content"), needles)
    w = Window.partitionBy("needle", "session_id")
    return found.withColumns({"i": F.row_number().over(w.orderBy("seq", "message_id", "offset")), "n": F.count("*").over(w)}).drop("seq")
