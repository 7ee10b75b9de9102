"""Queries that give what SQL can express of some operators, by the operators themselves, and that SQL.

The operators' own queries return columns beside these that SQL can't give, such as a method's verdict or score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm import permutation_index, pitman_yor, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _crc_table() -> list[int]:
    """The remainder of each byte value for the reversed polynomial of CRC-32."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL."""
    table = "[" + ", ".join(map(str, _crc_table())) + "]::BIGINT[]"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, x: xor(a >> 8, ({table})[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rules of op2_quality_rules."""
    return quality.statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *quality.STATS, "base_failed")


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM w), range(5) t(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


def pitman_yor_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of op3_pitman_yor, from its own steps up to where seatings are drawn."""
    found = pitman_yor.query(spark, sf_dir, base_only=True)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


PITMAN_YOR_SQL = rf"""
WITH d AS (SELECT doc_id, {crc_sql("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append(list_transform({WORDS}, lambda w: 'w' || translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 'end') AS words FROM documents),
t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM t LEFT JOIN c USING (word), s GROUP BY doc_id, held_out
"""


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_permutation_index with all files read and all that they hold ranked again: then it is exact."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = permutation_index.search(vectors, vectors.filter("vec_id % 100 = 0"), reads=1.0, share=1.0)
    return found.withColumn("score", F.round("score", 6))


NEAREST_SQL = """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, round(score, 6) AS score FROM p QUALIFY rank <= 10
"""

QUERIES = {"quality_base": quality_base, "pitman_yor_base": pitman_yor_base, "nearest_exact": nearest_exact}
ORACLE_SQL = {"quality_base": QUALITY_SQL, "pitman_yor_base": PITMAN_YOR_SQL, "nearest_exact": NEAREST_SQL}
