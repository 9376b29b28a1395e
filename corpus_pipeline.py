"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``. ``run`` applies them one after another, each to what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm import bpe, decontaminate, language, near_dedup, pii
from rankwright.llm.common import row_ids, row_key, session, table, written

#: The columns of ``documents``.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of which benchmark passages cover more than this share of words goes as a whole.
MOST_HIT = 0.5


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not known well enough."""
    found = language.languages(docs, table(session(spark), sf_dir, "pages"))
    good = found.where("kept").select("key").distinct()
    return docs.withColumn("key", row_key("doc_id", "source", "text")).join(good, "key", "left_semi").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates by runs of five words; of equal rows one."""
    session(spark)
    rows, again = row_ids(docs.select(*COLUMNS))
    found = near_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text").distinct() if again else rows.select("doc_id", "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("_row"))
    if again:
        rows = rows.dropDuplicates(["_row"])
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly such passages."""
    found = decontaminate.find_passages(docs.select(*COLUMNS), table(session(spark), sf_dir, "benchmark"), cut=True)
    left = found.where(decontaminate.n_hit() <= F.col("n_words") * MOST_HIT)
    cut = left.withColumn("n_chars", F.when(F.size("hit_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*COLUMNS)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of personal data."""
    found = pii.with_pii(docs.select(*COLUMNS))
    masked = pii.mask_pii(found).withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    shared = bpe.default_codec(session(spark))
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), shared)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("pii", mask_personal),
    ("byte_bpe", to_tokens),
]

#: MinHash candidates, contextual extraction and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(session(spark), sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
