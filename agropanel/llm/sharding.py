"""Shards of near equal bytes by longest-processing-time scheduling; equal texts stay together.

Groups of equal texts, sorted by their bytes, go one by one to the least loaded shard,
which a heap gives. Groups of the same bytes are interchangeable, so the schedule needs
only how many groups have each size: that table (at most the square root of twice the
table's bytes, as so many different sizes add up to that) is all the driver sees. Where
many groups share a size, the heap's result is taken at once: a level is raised until as
many places lie below it as there are groups. What comes back is, for each size, how many
groups each shard gets; a group finds its shard by its rank among the groups of its size.

Ranks are taken without a group in one task: rows are dealt to ascending ranges of
(group, order), written, and a row's rank is its place in its file less the file's first
row of that group, plus the group's rows in the files before.

A size is the text's UTF-8 bytes plus ``OVERHEAD``; a null text counts as empty and
belongs to the group of empty texts. Slots follow ``doc_id`` (null first), then the
text's digest; rows that repeat both may change places, and look alike. Of two groups of
one size that with the smaller SHA-256 is first. Empty tables give no rows. Columns other
than the two named are carried by ``write`` only.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .exact_dedup import located
from .tables import lookup

#: Fixed value: bytes a row has besides its text.
OVERHEAD = 8
#: From so many groups of one size on, a level is sought in place of asking the heap each time.
MANY = 8


def deal(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` things of one size each shard gets if each goes to the least loaded (the first of equals)."""
    counts = [0] * len(loads)
    if n >= MANY * len(loads):
        below = lambda level: [max(0, -((held - level) // size)) for held in loads]
        low, high = min(loads), max(loads) + size * n
        while low < high:  # the highest level with at most n places below it
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
        counts = below(low)
        n -= sum(counts)
    heap = [(held + size * c, i) for i, (held, c) in enumerate(zip(loads, counts))]
    heapq.heapify(heap)
    for _ in range(n):
        held, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (held + size, i))
    return counts


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, list]:
    """For sizes in descending order: the shard of a size's only group, or how many groups go to the shards up to each."""
    heap = [(0, i) for i in range(shards)]
    first, ends = np.full(len(sizes), -1, np.int32), [None] * len(sizes)
    for k, (size, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if n == 1:
            held, i = heap[0]
            first[k] = i
            heapq.heapreplace(heap, (held + size, i))
            continue
        loads = [held for held, _ in sorted(heap, key=lambda h: h[1])]
        got = deal(loads, size, n)
        heap = [(held + size * c, i) for i, (held, c) in enumerate(zip(loads, got))]
        heapq.heapify(heap)
        ends[k] = np.cumsum(got).tolist()
    return first, ends


def ranked(rows: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """``rows`` with ``out``, each row's place from 0 within its group; no group is gathered in one task."""
    keys = [group, *order]
    table = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
    place = table.metadataColumn("_metadata")
    part = F.regexp_extract(place["file_name"], r"part-(\d+)", 1).cast("int")
    at = table.select("*", part.alias("_part"), place["row_index"].alias("_at"))
    pieces = at.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select("_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return at.join(shift, ["_part", group]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _narrow(doc_id: Column, text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [
        doc_id.cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
    ]


def _placed(narrow: DataFrame, shards: int) -> DataFrame:
    """The rows of ``narrow`` (written before) with ``shard`` and ``slot``."""
    spark = narrow.sparkSession
    groups = narrow.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    groups = ranked(groups, "bytes", ["digest"], "rank")
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n_groups")).toPandas().sort_values("bytes", ascending=False)
    sizes, counts = classes["bytes"].to_numpy(np.int64), classes["n_groups"].to_numpy(np.int64)
    first, ends = schedule(sizes, counts, shards)
    plan = pa.table([pa.array(sizes), pa.array(counts), pa.array(first), pa.array(ends, pa.list_(pa.int64()))], names=["bytes", "n_groups", "first", "ends"])
    plan = spark.createDataFrame(plan)
    shard = F.when(F.col("ends").isNull(), F.col("first")).otherwise(F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    homes = lookup(groups, plan, "bytes", int(counts.sum()), "n_groups", "inner").select("digest", "n_rows", shard.cast("int").alias("shard"))
    homes = cut_lineage(homes)
    total = homes.agg(F.sum("n_rows")).first()[0] or 0
    rows = lookup(narrow, homes, "digest", total, "n_rows", "inner").drop("n_rows")
    return ranked(rows, "shard", ["doc_id", "digest"], "slot")


def place(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``."""
    narrow = cut_lineage(docs.select(*_narrow(docs[f"`{id_col}`"], docs[f"`{text_col}`"])))
    return _placed(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write(docs: DataFrame, path: str, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` with all their columns to ``path/shard=N``, files and rows in the order of the slots.

    Where ``docs`` has a column of that name, the folders' gets as many ``_`` as make it new.
    """
    rows, folder = located(docs), "shard"
    while folder in docs.columns:
        folder += "_"
    narrow = cut_lineage(rows.select(*_narrow(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")), "file", "at"))
    homes = _placed(narrow, shards).select("file", "at", "shard", "slot")
    whole = rows.join(homes, ["file", "at"]).select("shard", "slot", "row")
    ordered = whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(F.col("shard").alias(folder), "row.*").write.partitionBy(folder).parquet(path)
    return path
