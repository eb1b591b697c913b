"""One registered query per operator, over whole tables, with the operators' production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, conversations, decontam, exact_dedup, licences, lm_nce, minhash_dedup, pii, quality_gam, sharding, token_files, wacz


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(_table(spark, sf_dir, "documents"), token_files.new_path(spark), _vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.starts(spark, path)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.known(spark))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = _vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, vocabulary))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_nce.score(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(_table(spark, sf_dir, "documents")))


def op10_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = wacz.write(wacz.marked(_table(spark, sf_dir, "pages")), wacz.new_folder(spark))
    return wacz.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), 24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_exact_dedup, op3_token_files, op4_licences, op5_byte_bpe, op6_decontam, op7_lm_score, op8_quality, op9_pii, op10_wacz, op11_conversations,
        op12_alignment, op13_sharding,
    )
}
