"""Exact duplicates by a stateful stream over digests, with full bytes compared on every hit.

The stream keeps, on disk (RocksDB) and without expiry, one state row per digest:
the digest, the smallest ``doc_id`` with its content locator (file and row), and
the number of rows. Digests of equal texts therefore meet in the state whatever
the batch that brought them. Afterwards every group of more than one row is read
back and its smallest and largest normalised text are compared byte by byte; where
a digest covers different texts, its rows are grouped again by the whole text.

Only DataFrame operations run on the executors. A null text counts as empty; texts
are equal after each run of ``[\\x20\\x09-\\x0D]`` becomes one space. Of equal texts
the smallest ``doc_id`` stays; a null ``doc_id`` comes last; of rows that repeat the
id, the first by file and row stays. Only the two named columns are read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, cut_lineage
from .tables import hot_keys, lookup, settings

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every state partition reserves megabytes of disk
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(row, file, at)``: all columns in a struct, and where Spark can read the row again.

    A frame that is no plain read of files is written once to the shared folder.
    """
    def with_place(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("at"))

    try:
        return with_place(docs)
    except AnalysisException:
        return with_place(cut_lineage(docs))


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")


def digest_state(rows: DataFrame, max_bytes_per_trigger: int) -> DataFrame:
    """Stream ``(digest, doc_id, file, at)`` through the keyed state; the state as a table.

    ``rows`` is landed in the shared folder first, so the stream can restart from its
    own checkpoint there. Result: ``digest, doc_id, file, at, n``.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/dedup-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/landed")
    with settings(spark, STATE_SETTINGS):
        stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(f"{folder}/landed")
        query = (
            stream.groupBy("digest").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
            .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").start()
        )
        query.awaitTermination()
        if query.lastProgress is None:  # nothing has landed
            return spark.createDataFrame([], "digest string, doc_id long, file string, at long, n long")
        state = spark.read.format("statestore").load(f"{folder}/state")
        return cut_lineage(state.select("key.digest", "value.min.doc_id", "value.min.file", "value.min.at", F.col("value.count").alias("n")))


def decisions(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, file, at`` for every row; options as in ``decide``."""
    return decide(located(docs), **options)


def decide(
    rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, max_bytes_per_trigger: int = 64 << 30,
) -> DataFrame:
    """The decisions on ``located(...)`` rows.

    ``digest_hex`` is the number of hex digits of the SHA-256 that key the state;
    fewer make collisions, which the byte comparison resolves.
    """
    text = normalised(F.col(f"row.`{text_col}`"))
    texts = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), text.alias("norm"), "file", "at").withColumn("text_sha256", F.sha2("norm", 256)).withColumn(
        "digest", F.substring("text_sha256", 1, digest_hex)
    )
    landed = texts.select("digest", "doc_id", "file", "at", *([] if digest_hex == 64 else ["text_sha256"]))
    landed = cut_lineage(landed)
    state = digest_state(landed.select("digest", "doc_id", "file", "at"), max_bytes_per_trigger)
    total = state.agg(F.sum("n")).first()[0] or 0
    groups = state.where("n > 1")
    sha = F.col("digest") if digest_hex == 64 else F.col("text_sha256")
    own = landed.withColumn("text_sha256", sha)

    first = groups.select("digest", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("at").alias("keep_at"), "n")
    out = lookup(own, first, "digest", total, "n")
    bad = _collisions(texts, groups, total)
    if not bad.isEmpty():
        again = texts.join(bad, "digest", "left_semi")
        exact = again.groupBy("digest", "norm").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
        regrouped = again.join(
            exact.select("digest", "norm", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.at").alias("keep_at"), "n"),
            ["digest", "norm"],
        )
        out = out.join(bad, "digest", "left_anti").unionByName(regrouped.select(out.columns))
    same = F.when(F.col("n").isNull(), F.lit(True)).otherwise((F.col("keep_file") == F.col("file")) & (F.col("keep_at") == F.col("at")))
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), same.alias("kept"), "text_sha256", "file", "at",
    )


def _collisions(texts: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The digests of more than one row whose texts are not all the same bytes.

    The fewer than 2000 hot digests are broadcast and their texts pre-aggregated
    where they are read; the texts of the others are grouped by digest.
    """
    wanted = groups.select("digest", "n")
    hot, cold = wanted.where(hot_keys(wanted, total, "n")), wanted.where(~hot_keys(wanted, total, "n"))
    rows = texts.select("digest", "norm")
    hits = rows.join(F.broadcast(hot), "digest", "left_semi").unionByName(rows.join(cold, "digest", "left_semi"))
    checked = hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return cut_lineage(checked.where("low <> high").select("digest"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    rows = located(docs)
    gone = decide(rows, **options).where("not kept").select("file", "at")
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")
