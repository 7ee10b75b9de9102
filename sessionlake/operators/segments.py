"""A kept inverted index: segments that refreshes add, tombstones, and merges by size.

A refresh writes the postings of its documents as a segment, in buckets of terms, and the documents that it replaces or removes as tombstones: a
posting counts if no later run has replaced its document. The table of documents and the totals that BM25 needs are kept beside it, and
whether texts were folded and stemmed. Segments of about the same size are merged when there are `fan` of them, so a posting is
written again only a logarithmic number of times, and tombstones go when no older segment is left. A search reads the buckets of its own terms.

A posting has its block of documents, by which a search for the k best leaves blocks out (search.best_by_blocks).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.functions.text import stems
from sessionlake.operators import search
from sessionlake.operators.kept import BUCKET, KEY, RUN, Run, Tables, bucket_of, buckets_for, replaced, rows_in, union
from sessionlake.operators.packing import written

PER_BUCKET = 4_000_000  # postings and documents of a bucket, about
PER_BLOCK = 64  # documents of a block, about, when the index is made, as most lengths fall in some sixteen classes


def _tables(name: str) -> tuple[str, str]:
    return f"{name}-postings", f"{name}-docs"


def refresh(kept: Tables, name: str, index: search.Index, gone: DataFrame | None = None, fan: int = 4, per_bucket: int = PER_BUCKET) -> dict[str, int]:
    """Adds an index's documents to the kept one, in place of what it had of them, and removes those of `gone` (doc). The first refresh makes it.

    The number of buckets comes from the first one's size. Returns numbers of documents, segments and merged segments. A refresh that folds or stems otherwise than the kept
    index is an error.
    """
    index, scratch = search.told(index)
    try:
        return _refresh(kept, name, index, gone, fan, per_bucket)
    finally:
        if scratch is not None:  # its postings are kept now
            kept.delete(scratch)


def _refresh(kept: Tables, name: str, index: search.Index, gone: DataFrame | None, fan: int, per_bucket: int) -> dict[str, int]:
    run, (postings, docs) = kept.run(), _tables(name)
    lengths, flags = index.lengths.select("doc", "session_id", "length"), {"stem": index.stem, "folded": index.folded}
    if docs not in run.tables:
        n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        buckets, spread = buckets_for(max(n, total), per_bucket), 1 << max(0, (n // (PER_BLOCK * 16)).bit_length() - 1)  # postings are fewer than words
        run.whole(docs, lengths, "doc", buckets)
        segment = _segment(run, index, buckets, spread)
        schema = index.postings.withColumn("block", search.block_of(spread)).select("term", "doc", "tf", "block", "length").schema
        run.tables[postings] = {"key": "term", "buckets": buckets, "schema": schema.json(), "rows": [segment], "gone": [], "spread": spread}
        run.tables[docs] |= flags | {"n_docs": n, "total": total}
        run.publish()
        return {"docs": n, "segments": 1, "merged": 0}
    table, held = run.tables[postings], run.tables[docs]
    if flags != {k: held[k] for k in flags}:
        raise ValueError(f"the kept index has {held['stem']=}, {held['folded']=}")
    touched = lengths.select("doc") if gone is None else lengths.select("doc").unionByName(gone.select("doc"))
    keys = run.keys(touched, "doc", held["buckets"])
    old = run.read(docs, keys["buckets"]).join(run.read_keys(keys, "doc"), "doc", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    own = run.replace(docs, lengths, keys)
    new = run.read_part(docs, own).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if own["buckets"] else (0, 0)
    held["n_docs"], held["total"] = held["n_docs"] - old[0] + new[0], held["total"] - old[1] + new[1]
    run.compact(docs)
    table["rows"].append(_segment(run, index, table["buckets"], table["spread"]))
    table["gone"].append(keys)
    merged = _merge(run, postings, fan)
    table["gone"] = [g for g in table["gone"] if any(p["run"] < g["run"] for p in table["rows"])]
    run.publish()
    return {"docs": held["n_docs"], "segments": len(table["rows"]), "merged": merged}


def _segment(run: Run, index: search.Index, buckets: int, spread: int) -> dict:
    """Postings with their blocks, as a part."""
    own = lambda postings: postings.withColumn("block", search.block_of(spread)).select("term", "doc", "tf", "block", "length", *[c for c in postings.columns if c == BUCKET])
    schema = own(index.postings).schema
    # Lists are dealt out as they are, and their documents told apart where they are written.
    part = run.part(own(index.postings), "term", buckets) if index.lists is None else run.part(index.lists, "term", buckets, lambda lists: own(search.each(lists)))
    return part | {"n": rows_in(run.kept, part, schema)}


def _merge(run: Run, postings: str, fan: int) -> int:
    """Segments of one size class, a power of `fan`, become one when there are `fan` of them; then the next class may be full."""
    table, merged = run.tables[postings], 0
    while True:
        classes: dict[int, list[dict]] = {}
        for p in table["rows"]:
            classes.setdefault(int(math.log(max(p["n"], 1), fan)), []).append(p)
        full = next((ps for _, ps in sorted(classes.items()) if len(ps) >= fan), None)
        if full is None:
            return merged
        whole = run.part(_live(run.kept, table, full), "term", table["buckets"])
        table["rows"] = [p for p in table["rows"] if p not in full] + [whole | {"n": rows_in(run.kept, whole, StructType.fromJson(json.loads(table["schema"])))}]
        merged += len(full)


def _live(kept: Tables, table: dict, parts: list[dict], only: set[int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Postings of some segments that no later run has replaced; wanted (term): of these terms only, before any join with tombstones."""
    schema = StructType.fromJson(json.loads(table["schema"]))
    gone, newest = replaced(kept, table["gone"]), max((g["run"] for g in table["gone"]), default=0)
    empty, out = kept.spark.createDataFrame([], schema), []
    for old in (False, True):  # the newest segments have nothing replaced
        own = [df.withColumn(RUN, F.lit(p["run"])) for p in parts if (p["run"] < newest) == old and (df := kept.scan(p, schema, only)) is not None]
        if own:
            rows = union(own, None)
            rows = rows if wanted is None else rows.join(wanted, "term", "left_semi")
            if old and gone is not None:
                rows = rows.join(gone, (rows["doc"] == gone[KEY]) & (gone["_after"] > rows[RUN]), "left_anti")
            out.append(rows.select(*schema.names))
    return union(out, empty)


def kept_index(kept: Tables, name: str, terms: DataFrame) -> search.Index:
    """The index as a search for `terms` (term) needs it: only the buckets of these terms are read, and only their postings go on."""
    state, (postings, docs) = kept.state(), _tables(name)
    table, held = state["tables"][postings], state["tables"][docs]
    wanted = written((stems(terms).select(F.col("stem").alias("term")) if held["stem"] else terms.select("term")).distinct())  # so that its size is known, and few terms don't have all postings dealt out
    only = {r["b"] for r in wanted.select(bucket_of("term", table["buckets"]).alias("b")).distinct().collect()}  # as many as there are buckets at most
    rows = _live(kept, table, table["rows"], only, wanted)
    corpus = kept.spark.createDataFrame([(held["n_docs"], held["total"] / held["n_docs"] if held["n_docs"] else None)], "n_docs long, avg_len double")
    return search.Index(rows, kept.read(docs), rows.groupBy("term").agg(F.count("*").alias("df")), corpus, held["stem"], held["folded"], True)
