"""Queries of the problems 1 and 3 to 8 with the parameters they run with in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import encoding, mixing, pii, scan_noise, spam, splitting, token_budget
from paperloom.session import table, tune


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.personal_kinds(pii.find_personal(table(tune(spark), d, "docket_review_input")))
    return found.select(F.col("id").alias("input_id"), "field", "kind")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(tune(spark), d, "docket_review_input"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noise_kinds(scan_noise.find_noise(table(tune(spark), d, "chunks_legal")))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repair(table(tune(spark), d, "chunks_legal"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored estimate is wrong. The stated rule decides by characters and rate; the trie's count of each text
    comes with it and is what the budgets add up."""
    return token_budget.chunk_tokens(table(tune(spark), d, "chunks_legal"), table(spark, d, "legal_rag_config")).where("wrong").select("chunk_id")


def p4_chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.chunk_budget(token_budget.chunk_tokens(table(tune(spark), d, "chunks_legal"), table(spark, d, "legal_rag_config")))


def p4_chunk_slices(spark: SparkSession, d: str) -> DataFrame:
    """The chunk budget without the tokens counted by the vocabulary."""
    return p4_chunk_budget(spark, d).drop("counted_tokens")


def p4_document_slices(spark: SparkSession, d: str) -> DataFrame:
    return p4_document_budget(spark, d).drop("counted_tokens")


def p4_document_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.document_budget(table(tune(spark), d, "documents"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(tune(spark), d, "chunks_legal"), table(spark, d, "legal_rag_config"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece_no = 2").select("chunk_id")


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each oversized text give when put together again."""
    whole = splitting.reassembled(p5_pieces(spark, d))
    limits = splitting.oversized(table(spark, d, "chunks_legal"), table(spark, d, "legal_rag_config")).select("chunk_id", "limit").distinct()
    return whole.join(limits, "chunk_id").select("chunk_id", F.md5("text").alias("digest"), (F.col("longest") <= F.col("limit")).alias("within"), F.array_join("overlaps", ",").alias("overlaps"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(tune(spark), d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for."""
    return encoding.decode_corpus(p6_ids(spark, d)).select("doc_id", F.md5("text").alias("digest"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(tune(spark), d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).where(~F.col("reached")).select("plan", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(tune(spark), d, "documents"))


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    judged = spam.judge_pages(table(tune(spark), d, "documents"))
    return judged.select("doc_id", "lang", *(F.round(c, 6).alias(c) for c in ("slope", "residual", "types", "divergence", "excess", "curve")), "spam")


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p3_found, p3_repaired, p4_found, p4_chunk_budget, p4_chunk_slices, p4_document_budget, p4_document_slices, p5_found, p5_pieces, p5_whole, p6_ids, p6_decoded, p7_found, p7_mix, p7_report, p8_found, p8_pages)}
