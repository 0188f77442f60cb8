"""The operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.llm import (
    decontaminate,
    infill,
    jaccard,
    language,
    periodic,
    pii,
    quality,
    sharding,
    token_counts,
    token_files,
    topk,
    toxicity,
    viterbi,
)
from panelsift.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 40


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(documents(spark, folder).select("doc_id", "text"))
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[q[n].alias(n) for n in names])


SQL["op2_quality_rules"] = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts),
places AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words
  FROM windows, (VALUES (0), (1), (2)) AS o(j) WHERE n >= 2 GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: list_contains({list(quality.STOP_WORDS)!r}, lower(x)))) AS n_stop,
    len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS n_upper
  FROM split LEFT JOIN covered USING (r)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 12.0
    AND n_symbols / n_words::DOUBLE <= 0.1 AND n_stop / n_words::DOUBLE >= 0.02
    AND n_upper / n_words::DOUBLE <= 0.5 AND n_dup_lines / n_lines::DOUBLE <= 0.5 AS kept
FROM based
"""


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder), SHARDS)


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    coded = viterbi.encode_documents(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", "n_ids", "ids_crc32", "lossless")


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return decontaminate.leaks(documents(spark, folder), read_table(spark, folder, "benchmark"))


SQL["op6_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words WHERE len(w) >= 5)),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
pairs AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM doc_shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM pairs JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.identify(docs, language.fit(docs))


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, folder, "labels")))


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


@query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(documents(spark, folder))


@query
def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five greatest inner products of every fiftieth vector with all others."""
    vectors = read_table(spark, folder, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


SQL["op11_exact_top_k"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged, and what its new text gives back."""
    made = infill.fill_in_middle(documents(spark, folder), seed=7, rate=100, suffix_first=50)
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


SQL["op12_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS l,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
cuts AS (
  SELECT *, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS c1,
    CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS c2,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(l[1 : least(c1, c2)], '') AS p,
    array_to_string(l[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
    array_to_string(l[greatest(c1, c2) + 1 : n], '') AS s
  FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
  FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o ELSE p || m || s END) AS restored_sha256
FROM made
"""


def repeated_in_place(name: object, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats a stretch of itself to its end, as its id decides.

    Documents without an id stay as they are.
    """
    h = 1 if name is None else zlib.crc32(str(name).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, some of which repeat themselves by rule."""
    return periodic.digest(periodic.periodic_runs(documents(spark, folder), edit=repeated_in_place))
