"""Thin queries over the corpus operators, one per operator, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread, table
from . import chat, decontam, exact_dedup, ngram_join, packing, quality, secrets, token_count, toxicity, warc


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(texts(spark, sf_dir))


def _tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.expand(chat.with_tricky(spark, table(spark, sf_dir, "conversations"))))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(
        docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(texts(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(texts(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages"))))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(texts(spark, sf_dir)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(texts(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_toxicity, op3_chat_format, op4_best_fit_packing, op5_ngram_jaccard,
    op6_decontamination, op7_warc_revisits, op8_secret_scan, op9_token_counts, op10_quality,
)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op3_chat_format": chat.ORACLE_SQL, "op5_ngram_jaccard": ngram_join.ORACLE_SQL, "op7_warc_revisits": warc.ORACLE_SQL}
