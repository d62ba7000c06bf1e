"""One query for each training-data operator, over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).drop("component_key")  # a number that differs from run to run


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lodestone.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from lodestone.llm.bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_text import main_text, marked_pages, train

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(marked_pages(pages)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.hard_negatives import mine_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm import oracles, secrets

    return oracles.SQL | {"op5_secret_scans": secrets.oracle()}
