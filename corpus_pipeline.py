"""From raw documents to token ids: quality, near duplicates, benchmark passages, secrets, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of `documents`. Extra columns of docs are not carried on, whatever their names. Null or empty texts and null ids go through
every stage as rows of their own, and so do the different texts of one id; very long texts are read whole; an empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import token_digests
from lodestone.llm.common import durable, released, table
from lodestone.llm.decontaminate import find_contamination
from lodestone.llm.ngram_join import similar_documents
from lodestone.llm.quality import classify
from lodestone.llm.secrets import find_secrets, mask_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The fitted classifier cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    scored = classify(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return scored.where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (null ids last, then by text).

    Rows are judged one by one: of an id with several texts each text stays or goes with its own group. Texts without
    words are in no group and stay.
    """
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    key = F.concat_ws(":", "doc_id", F.md5("text"))  # of a row; equal rows share it
    rows = docs.select(*COLUMNS)
    known = rows.withColumn("row_key", key)
    found = similar_documents(known.select("doc_id", "text", "row_key"), keep=("row_key",)).where("component_key is not null")
    first = found.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).getField("row_key").alias("row_key"))
    met = known.where(words).join(first.select("row_key").distinct(), "row_key", "left_semi")
    one = met.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("lang", "source", "n_chars"))).where("nth = 1")
    return one.select(*COLUMNS).union(rows.where(~words))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of benchmark items go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.where("not contaminated").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    masked = mask_secrets(find_secrets(docs, keep=("lang", "source", "n_chars")))
    length = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of every text, and of the bytes that they decode to."""
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with released(spark):
            docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
