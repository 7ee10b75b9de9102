"""Keyword search for a table of queries: inverted index, conjunctive match, BM25, best message of a session, hybrid ranking.

Queries are a table (qid, ...), so one job answers all of them. The index is a table of postings by term; a search reads
only postings of the queries' own terms, adds up scores where they are, and attaches texts to what is left at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sessionlake.functions.text import clean_snippet, query_terms, spaced, stemmed, stems, tokens
from sessionlake.operators import blocks
from sessionlake.operators.packing import written


@dataclass(frozen=True)
class RankParams:
    """Weights and limits of a search."""

    keyword_weight: float = 0.3
    vector_weight: float = 0.7
    one_side: float = 0.5
    similarity_floor: float = 0.35
    score_floor: float = 0.2
    limit: int = 50
    over_fetch: int = 2
    k1: float = 1.2
    b: float = 0.75


DEFAULT = RankParams()


@dataclass(frozen=True)
class Index:
    """postings (term, doc, tf), lengths (doc, session_id, length), terms (term, df), and corpus (n_docs, avg_len), one row.

    Postings may have more columns: length of the document; of a kept index block, of the documents. split (doc, session_id, spaced) are
    the documents of a fresh index without stems, not run yet. lists (term, docs, tfs), if there, are the postings, many documents a row.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame
    stem: bool = False
    folded: bool = False
    kept: bool = False  # corpus and lengths are tables that are there
    split: DataFrame | None = None
    lists: DataFrame | None = None


def block_of(spread: int) -> Column:
    """The block of a document (doc, length): `spread` of them for each class of lengths, as scores follow lengths."""
    return (F.floor(2 * F.log2(F.col("length") + 1)) * spread + F.pmod(F.xxhash64("doc"), F.lit(spread))).cast("int")


def _counted(own: DataFrame) -> DataFrame:
    """term, doc, tf, length of rows (doc, words), each for itself: words are sorted, and first places told apart. Steps are columns, else each word would sort them again."""
    first = F.filter(F.transform("sorted", lambda w, i: F.struct(w.alias("term"), i.alias("i"))), lambda p: (p["i"] == 0) | (F.get("sorted", p["i"] - 1) != p["term"]))
    rows = own.select("doc", F.sort_array("words").alias("sorted")).select("doc", F.size("sorted").alias("length"), first.alias("first"))
    tf = lambda p, k: (F.coalesce(F.get("first", k + 1)["i"], F.col("length")) - p["i"]).cast("long")
    return rows.select("doc", "length", F.inline(F.transform("first", lambda p, k: F.struct(p["term"].alias("term"), tf(p, k).alias("tf"))))).select("term", "doc", "tf", "length")


def _told(own: DataFrame, sizes: bool = False) -> DataFrame:
    """term, docs, tfs, doc, session_id, length of rows (doc, session_id, spaced): for each word of some documents a row with its documents and uses, and for each document one without a term that has its session and length. With `sizes` also lengths, those of docs.

    Words are counted where texts are split, some documents at a time, so nothing is shuffled and texts are split once for both.
    """
    kinds = own.schema
    doc = kinds["doc"].dataType
    schema = StructType([StructField("term", StringType()), StructField("docs", ArrayType(doc)), StructField("tfs", ArrayType(LongType())), StructField("doc", doc), StructField("session_id", kinds["session_id"].dataType), StructField("length", IntegerType()), *([StructField("lengths", ArrayType(IntegerType()))] if sizes else [])])

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = pc.binary_length(b.column("spaced")).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
        edges = np.unique(np.searchsorted(ends, np.arange(TOLD, ends[-1], TOLD), "right")).tolist() if len(ends) else []
        return (b.slice(i, j - i) for i, j in zip([0, *edges], [*edges, len(b)], strict=True) if j > i)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, more = to_arrow_schema(schema), ["lengths"] if sizes else []
        nulls = lambda n, *names: [pa.nulls(n, out.field(c).type) for c in names]
        for b in (part for whole in batches for part in parts(whole)):
            docs, text = b.column("doc"), b.column("spaced").cast(pa.string())
            _, at, data = text.buffers()
            at = np.frombuffer(at, np.int32)[text.offset : text.offset + len(b) + 1]
            # A word ends behind each space, which no other character's bytes have.
            ends = np.flatnonzero(np.frombuffer(data, np.uint8)[at[0] : at[-1]] == 32) + 1 if at[-1] > at[0] else np.zeros(0, np.int64)
            lengths = np.diff(np.searchsorted(ends, at - at[0], "right"))
            yield pa.RecordBatch.from_arrays([*nulls(len(b), "term", "docs", "tfs"), docs, b.column("session_id"), pa.array(lengths, pa.int32()), *nulls(len(b), *more)], schema=out)
            if not len(ends):
                continue
            words = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), data.slice(at[0], at[-1] - at[0])])
            coded = words.dictionary_encode()
            pairs, tf = np.unique(coded.indices.to_numpy() * np.int64(len(b)) + np.repeat(np.arange(len(b)), lengths), return_counts=True)
            codes, rows = np.divmod(pairs, len(b))
            n = len(coded.dictionary)
            lists = lambda own: pa.ListArray.from_arrays(pa.array(np.searchsorted(codes, np.arange(n + 1)), pa.int32()), own)
            columns = [pc.utf8_rtrim(coded.dictionary, " "), lists(docs.take(pa.array(rows))).cast(out.field("docs").type), lists(pa.array(tf, pa.int64())).cast(out.field("tfs").type)]
            own_lengths = [lists(pa.array(lengths[rows], pa.int32())).cast(out.field(c).type) for c in more]
            yield pa.RecordBatch.from_arrays([*columns, *nulls(n, "doc", "session_id", "length"), *own_lengths], schema=out)

    return own.select("doc", "session_id", "spaced").mapInArrow(tell, schema)


TOLD = 8 << 20  # bytes of text that _told() counts at once, besides one document


def build_index(docs: DataFrame, doc: str, session: str, fields: list[str], folded: bool = False, stem: bool = False) -> Index:
    """Inverted index over the fields' texts taken together. Documents without a word are in lengths with length 0."""
    text = F.concat_ws(" ", *fields)
    own = docs.select(F.col(doc).alias("doc"), F.col(session).alias("session_id"), tokens(text, folded).alias("words"))
    lengths = own.select("doc", "session_id", F.size("words").alias("length"))
    # A document's words are counted where it is; those of a number that several rows have are counted together.
    twice = F.broadcast(docs.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n")).filter("n > 1").select("doc"))
    same = lambda kind: own.join(twice, own["doc"].eqNullSafe(twice["doc"]), kind)
    single = _counted(same("left_anti"))
    several = same("left_semi").select("doc", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    postings = single.unionByName(several)
    if stem:  # counted first, so a frequent word passes once a document
        postings = postings.withColumn("term", stemmed("term")).groupBy("term", "doc").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_len"))
    return Index(postings, lengths, terms, corpus, stem, folded, split=None if stem else docs.select(F.col(doc).alias("doc"), F.col(session).alias("session_id"), spaced(text, folded).alias("spaced")))


def terms_of(queries: DataFrame, text: str = "text", ascii_terms: bool = True, folded: bool = False) -> DataFrame:
    """qid, term, n_terms: a row for each distinct term; queries without a term match nothing and have none. folded: as the index is."""
    found = queries.select("qid", F.array_distinct(query_terms(F.coalesce(F.col(text), F.lit("")), ascii_terms, folded)).alias("terms"))
    return found.select("qid", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def scored_docs(index: Index, terms: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """qid, doc, session_id, score for documents with every term of a query; BM25, more is better.

    Postings of other terms are left out where words are split or postings are read, before any shuffle of them. A query meets the postings of its rarest
    term only; these documents' postings are then matched with its other terms, so a frequent word costs a query no more than its rarest.
    """
    asked = written(_asked(index, terms))
    index = sifted(index, asked)
    known = written(_known(index, asked))
    whole = known.groupBy("qid", "n_terms").agg(F.min(F.struct("df", "term")).alias("first"), F.count("*").alias("n")).filter("n = n_terms")
    first = whole.select("qid", "first.term")
    of_first = index.postings.select("doc", "term").join(first, "term") if index.lists is None else index.lists.join(first, "term").select("qid", F.explode("docs").alias("doc"))
    met = written(of_first.select("qid", "doc"))  # so that its size is known, and few documents don't have all postings dealt out
    return _summed(index, index.postings.select("term", "doc", "tf").join(met, "doc").join(known, ["qid", "term"]), params)


def sifted(index: Index, terms: DataFrame) -> Index:
    """The index as a search for some terms (term) needs it, as written tables: texts are split once for these terms' postings and for lengths, however often they are read."""
    asked = terms.select("term").distinct()
    of_terms = lambda postings: postings.groupBy("term").agg(F.count("*").alias("df"))
    of_lengths = lambda lengths: lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_len"))
    if index.split is not None:
        told = written(_told(index.split).join(asked.withColumn("asked", F.lit(True)), "term", "left").filter("term is null or asked").drop("asked"))
        lengths, lists = told.filter("term is null").select("doc", "session_id", "length"), told.filter("term is not null").select("term", "docs", "tfs")
        own = lists.select("term", F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("tfs").alias("tf"))).alias("doc", "tf"))
        twice = written(lengths.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"))
        if twice.isEmpty():
            terms = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
            return replace(index, postings=own, lengths=lengths, terms=terms, corpus=of_lengths(lengths), split=None, lists=lists)
        # Those of a number that several documents have are counted together.
        same = lambda kind: own.join(twice, own["doc"].eqNullSafe(twice["doc"]), kind)
        postings = same("left_anti").unionByName(same("left_semi").groupBy("term", "doc").agg(F.sum("tf").alias("tf")))
        return replace(index, postings=postings, lengths=lengths, terms=of_terms(postings), corpus=of_lengths(lengths), split=None)
    postings = written(index.postings.select("term", "doc", "tf").join(asked, "term", "left_semi"))
    if index.kept:
        return replace(index, postings=postings, terms=of_terms(postings))
    lengths = written(index.lengths)
    return replace(index, postings=postings, lengths=lengths, terms=of_terms(postings), corpus=of_lengths(lengths))


def told(index: Index) -> tuple[Index, DataFrame | None]:
    """A fresh index without stems as tables of one written table, which is the second, so that texts are split once; lists have lengths too. Postings stay as they are where documents share a number."""
    if index.split is None:
        return index, None
    own = written(_told(index.split, sizes=True))
    lengths = own.filter("term is null").select("doc", "session_id", "length")
    index = replace(index, lengths=lengths, split=None)
    if lengths.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        lists = own.filter("term is not null").select("term", "docs", "tfs", "lengths")
        index = replace(index, postings=each(lists), lists=lists)
    return index, own


def each(lists: DataFrame) -> DataFrame:
    """term, doc, tf, length and other columns of rows (term, docs, tfs, lengths): a row for each document."""
    others = [c for c in lists.columns if c not in ("term", "docs", "tfs", "lengths")]
    return lists.select("term", *others, F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))).alias("doc", "tf", "length"))


def _asked(index: Index, terms: DataFrame) -> DataFrame:
    """qid, term, n_terms as the index has terms."""
    if not index.stem:
        return terms
    asked = terms.join(stems(terms), "term").select("qid", F.col("stem").alias("term"), "n_terms").distinct()
    return asked.withColumn("n_terms", F.count("*").over(Window.partitionBy("qid")))


def _known(index: Index, asked: DataFrame) -> DataFrame:
    """qid, term, n_terms, df, n_docs, avg_len for the queries' terms; a query with a term that the index lacks keeps its n_terms."""
    return asked.join(index.terms.join(asked.select("term").distinct(), "term", "left_semi"), "term").join(F.broadcast(index.corpus))  # corpus is one row


def _idf() -> Column:
    rarity = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(rarity > 0, rarity).otherwise(1e-6)


def _weight(params: RankParams) -> Column:
    """What a term adds to a score: more for rarer ones, for more uses, for shorter documents, and where documents are longer in the mean. Factors in the order in which SQL has them, as the last bit hangs on it."""
    return _idf() * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("length") / F.col("avg_len")))


UNIT = blocks.UNIT


def exact_sum(c: Column) -> Column:
    """The sum of numbers of 0 to a few thousand, the same in any order: as whole multiples of 2^-40 and, of what is left, of 2^-80. So equal documents score equally."""
    whole = F.floor(c * UNIT)
    return (F.sum(whole) + F.sum(F.floor((c * UNIT - whole) * UNIT)) / UNIT) / UNIT


def _summed(index: Index, hits: DataFrame, params: RankParams) -> DataFrame:
    summed = hits.join(index.lengths, "doc").groupBy("qid", "doc", "session_id").agg(exact_sum(_weight(params)).alias("score"), F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
    return summed.filter("found = n_terms").select("qid", "doc", "session_id", "score")


GROUP = 16_384  # documents of a group that meets all queries, at most about


def best_by_blocks(index: Index, terms: DataFrame, limit: int, params: RankParams = RankParams(), probe: int = 16, candidates: DataFrame | None = None, restricted: DataFrame | None = None, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """best_of_sessions() of scored_docs(), without scoring what can't be among the `limit` best, and the blocks (qid, block, postings) that were read.

    Documents are dealt to groups of `group`, each of which meets all queries (blocks.meeting) and passes on a query's best sessions in it. There the `probe` blocks of
    highest bound are scored first; of the others those whose bound reaches the score at rank `limit`. So results are those of a whole search, and no
    table has a row for each pair of query and document or block. Queries of the same terms are one. With candidates all blocks are read. The index is to be a kept one.
    """
    if candidates is None:
        once, same = _once(terms)
        given = lambda df: _given(df, same)
        return tuple(map(given, _by_blocks(index, once, limit, params, probe, None, None, group)))
    return _by_blocks(index, terms, limit, params, probe, candidates, restricted, group)


def _by_blocks(index: Index, terms: DataFrame, limit: int, params: RankParams, probe: int, candidates: DataFrame | None, restricted: DataFrame | None, group: int) -> tuple[DataFrame, DataFrame]:
    asked = _asked(index, terms)
    n_docs = index.corpus.first()["n_docs"] or 0
    groups = 1 << max(0, (-(-n_docs // group) - 1).bit_length())  # a power of two, as numbers of blocks are, so that a block stays in one
    group_of = F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int").alias("group")
    # Terms by numbers, and how many documents have them, once for all.
    known = written(index.terms.join(asked.select("term").distinct(), "term", "left_semi").withColumn("tid", F.monotonically_increasing_id()))
    mean = F.broadcast(index.corpus)  # one row
    whole = asked.join(known, "term").groupBy("qid", "n_terms").agg(F.sort_array(F.collect_list(F.struct("df", "tid"))).alias("parts")).filter(F.size("parts") == F.col("n_terms"))
    queries = whole.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "qid", F.transform("parts", lambda p: p["tid"]).alias("parts"))
    postings = index.postings.filter("doc is not null").join(known, "term").join(mean).select(group_of, "tid", "doc", "block", _weight(params).alias("weight"))
    others = index.lengths.filter("length > 0 and doc is not null").select(group_of, "doc", "session_id").unionByName(queries, allowMissingColumns=True)
    met = postings.groupBy("group").cogroup(others.groupBy("group"))
    of_doc, of_query = index.lengths.select("session_id", "doc").schema, terms.select("qid").schema

    def meet(most: int | None, tell_read: bool) -> DataFrame:
        schema = StructType([*of_query, *StructType.fromDDL("block int, postings long")]) if tell_read else StructType([*of_query, *of_doc, *StructType.fromDDL("score double")])
        schema = StructType([StructField(f.name, f.dataType) for f in schema])
        return met.applyInArrow(blocks.meeting(most, probe, tell_read, to_arrow_schema(schema)), schema)

    most = limit if candidates is None else None
    return best_of_sessions(meet(most, False), limit, candidates, restricted), meet(most, True)


def permitted(rows: DataFrame, candidates: DataFrame | None, restricted: DataFrame | None = None) -> DataFrame:
    """rows (qid, session_id, ...) less those that candidates (qid, session_id) don't have. restricted (qid): the queries that this holds for; None: all."""
    if candidates is None:
        return rows
    allowed = candidates.select("qid", "session_id").distinct()
    if restricted is None:
        return rows.join(allowed, ["qid", "session_id"], "left_semi")
    marked = rows.join(restricted.select("qid", F.lit(True).alias("asks")).distinct(), "qid", "left").join(allowed.withColumn("passes", F.lit(True)), ["qid", "session_id"], "left")
    return marked.filter("asks is null or passes").select(*rows.columns)


def best_of_sessions(scored: DataFrame, limit: int | None, candidates: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """qid, session_id, doc, score, rank: the best document of each session, the `limit` best sessions of each query (None: all).

    candidates and restricted, as in permitted(), leave sessions out before the cut. Ties go to the smaller document, then session.
    """
    scored = permitted(scored, candidates, restricted)
    best = scored.groupBy("qid", "session_id").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("doc"), F.max("score").alias("score"))
    return top(best, limit, F.desc("score"), F.asc("session_id"))


def best_of_all(index: Index, terms: DataFrame, limit: int | None, params: RankParams = RankParams()) -> DataFrame:
    """best_of_sessions() of scored_docs(), where queries of the same terms are searched once, and its few best sessions are given to each of them."""
    once, same = _once(terms)
    return _given(best_of_sessions(scored_docs(index, once, params), limit), same)


def _once(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms of one query of those that ask the same, and as, qid: which one stands for each."""
    sets = written(terms.groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    once = sets.groupBy("terms").agg(F.min("qid").alias("as"))
    return written(once.select(F.col("as").alias("qid"), F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))), sets.join(once, "terms").select("as", "qid")


def _given(found: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of queries that stand for others, for each of them."""
    return found.withColumnRenamed("qid", "as").join(same, "as").select(*found.columns)


def top(rows: DataFrame, limit: int | None, *order: Column, by: str = "qid") -> DataFrame:
    """The first rows of each group (all if limit is None), with their rank from 1."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def normalised(rows: DataFrame, score: str = "score", by: str = "qid") -> DataFrame:
    """Scores brought to 0.5 to 1 within each query; all equal: 1."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(score, F.when(high > low, 0.5 + 0.5 * F.try_divide(F.col(score) - low, high - low)).otherwise(1.0))


def merge_sources(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits in messages and in session fields as one list: a session's metadata hit counts only if it scores strictly more."""
    both = messages.withColumn("source", F.lit("keyword")).unionByName(metadata.withColumn("source", F.lit("metadata")))
    return both.groupBy("qid", "session_id").agg(F.max_by(F.struct("score", "doc", "source"), F.struct("score", F.expr("source = 'keyword'"))).alias("m")).select("qid", "session_id", "m.*")


def combine(keyword: DataFrame, vector: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """Both sides' scores of each session as one; a session that one side has gets half of that side's."""
    k, v = keyword.select("qid", "session_id", F.col("score").alias("fts_score")), vector.select("qid", "session_id", F.col("score").alias("semantic_score"))
    f, s = F.col("fts_score"), F.col("semantic_score")
    score = F.when(f.isNotNull() & s.isNotNull(), params.keyword_weight * f + params.vector_weight * s).otherwise(params.one_side * F.coalesce(f, s))
    source = F.when(f.isNull() | (s >= f), "semantic").otherwise("keyword")
    return k.join(v, ["qid", "session_id"], "full_outer").withColumns({"score": score, "match_source": source})


def hybrid(keyword: DataFrame, vector: DataFrame, params: RankParams = RankParams(), candidates: DataFrame | None = None) -> DataFrame:
    """qid, session_id, score, fts_score, semantic_score, match_source, rank, from both sides' best sessions."""
    both = combine(normalised(keyword), normalised(vector), params).filter(F.col("score") >= params.score_floor)
    if candidates is not None:
        both = both.join(candidates.select("qid", "session_id").distinct(), ["qid", "session_id"], "left_semi")
    return top(both, params.limit, F.desc("score"), F.asc("session_id"))


def snippets(hits: DataFrame, docs: DataFrame, terms: DataFrame, doc: str, text: str, words: int = 24) -> DataFrame:
    """hits with snippet: the window of words with most distinct terms, the earliest of these, dots where it was cut.

    Only the hits' own texts are joined. Windows begin at each hit of a term.
    """
    asked = terms.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    own = hits.join(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc").join(asked, "qid")
    parts = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    lower = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]", ""))
    starts = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.array_contains("terms", F.get("lower", i)))
    scored = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice("lower", i + 1, words), F.col("terms"))).alias("n"), (-i).alias("at")))
    begin = F.coalesce(-F.array_max("scored")["at"], F.lit(0))
    snippet = F.concat(F.when(F.col("begin") > 0, "...").otherwise(""), F.array_join(F.slice("parts", F.col("begin") + 1, words), " "), F.when(F.size("parts") > F.col("begin") + words, "...").otherwise(""))
    out = own.withColumn("parts", parts).withColumn("lower", lower).withColumn("scored", scored).withColumn("begin", begin)
    return out.withColumn("snippet", clean_snippet(snippet)).select(*hits.columns, "snippet")
