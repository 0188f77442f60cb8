"""From raw documents to token ids: five stages, each a table the next one reads.

Every stage works on all rows its predecessor kept, and all but the last return the
columns of ``documents``. A stage is a function of the session, its input and the
folder of the given tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsift.llm import decontaminate, jaccard, pii, quality, viterbi
from panelsift.llm.common import read_table, stored
from panelsift.llm.queries import QUERIES, SQL


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop what the quality rules reject; null and empty texts are rejected.

    A column of the documents that is called like the verdict stays as it is.
    """
    aside = unused(docs, "quality_")
    judged = quality.judge(docs.withColumnRenamed("quality", aside)).where("quality.kept").drop("quality")
    return judged.withColumnRenamed(aside, "quality").select(docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of near copies the document with the least id stays.

    Documents without shingles stay, each for itself. Rows with the same id and text count
    as one document, of which any row stays; the same id with another text is another
    document. Rows without an id stay: nothing could name them as kept.
    """
    key, content = unused(docs, "key"), unused(docs, "content")
    named = docs.where("doc_id IS NOT NULL").withColumn(content, F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = named.select(F.struct("doc_id", content).alias(key), "text")
    kept = jaccard.groups(keyed, key=key).where(F.col(key) == F.col("component_id"))
    least = kept.select(F.col(f"{key}.doc_id").alias("doc_id"), F.col(f"{key}.{content}").alias(content)).distinct()
    first = named.join(least, ["doc_id", content], "left_semi").dropDuplicates(["doc_id", content])
    return first.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, folder, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mask personal data; ``n_chars`` follows the text."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text that is left, and whether they decode to it."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return viterbi.encode_documents(docs, path).drop("decoded")


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("SentencePiece encoding", encoded),
]
#: SQL has no SentencePiece; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


TEXT_QUERIES = {**QUERIES, "pipeline": run}
TEXT_SQL = dict(SQL)
