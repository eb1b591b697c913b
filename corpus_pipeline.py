"""From raw documents to encoded training text, one written table per stage.

Every stage reads all that its predecessor kept; all but the last return the
columns of ``documents``. Stages decide about rows, not ids: rows without ``doc_id``
and rows that repeat one are judged each by its own text. A null text counts as empty;
empty texts are kept or dropped by the quality score like others, of several one stays,
and they are near copies and leaks of nothing. An empty table gives an empty table; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agropanel.llm import byte_bpe, decontam, exact_dedup, minhash_dedup, quality_gam
from agropanel.runtime import cut_lineage

#: More rows than a file of a table has.
FILE_ROWS = 1 << 40


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(_key, row)``: all columns in a struct, and a number for each row by its file and place there."""
    rows = exact_dedup.located(docs)
    # One row per file of a table, as the driver lists them.
    files = rows.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
    return rows.join(F.broadcast(files), "file").select((F.col("number") * FILE_ROWS + F.col("at")).alias("_key"), "row")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("_key", F.col("row.text").alias("text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, "_key", "left_anti").select("row.*")


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first row, by file and place, stays."""
    rows = keyed(docs)
    found = minhash_dedup.near_duplicates(_texts(rows), id_col="_key")
    return _without(rows, found.where("not kept").select(F.col("doc_id").alias("_key")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    leaks = decontam.contaminated(_texts(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    return _without(rows, leaks.select(F.col("doc_id").alias("_key")).distinct())


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ids of every text and the digest of the bytes they decode to."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return decoded.selectExpr("doc_id", "ids", "cast(size(ids) as long) AS n_tokens", "sha2(bytes, 256) AS decoded_sha256")


STAGES = [
    ("quality classifier", keep_good_texts),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_texts),
]

#: The stages include a fitted classifier and tokenizer ids, which SQL cannot express; tests/llm/test_pipeline.py
#: holds every stage and the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
