"""Joins that hold when one key has a third of all rows, and components of a graph."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage

#: Sets and whole texts go to Python in small batches, which bounds buffers on both sides.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the jobs that run inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A key is hot above this share of all rows, so there are fewer than ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 1 / 2000


def hot_keys(groups: DataFrame, total: int, count: str) -> Column:
    """The condition for hot keys: fewer than 2000 rows can meet it, so they may be broadcast."""
    return F.col(count) > F.lit(max(1.0, total * HOT_SHARE))


def lookup(rows: DataFrame, groups: DataFrame, key: str, total: int, count: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with the one row per key of ``groups``; ``groups[count]`` is the key's number of rows.

    Hot keys (fewer than 2000, see ``hot_keys``) are broadcast, so none is dealt to
    one task; the rest is an ordinary join whose largest key has a share below
    ``HOT_SHARE``. ``how`` is ``left`` or ``inner``.
    """
    hot = groups.where(hot_keys(groups, total, count))
    cold = groups.where(~hot_keys(groups, total, count))
    first = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.unionByName(rest)


MARK_BITS = 1 << 26


def marks(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of ``MARK_BITS`` bits (8 MB) with a bit set for the hash of each key.

    Whatever the number of keys, that is all that reaches the driver and goes into a
    broadcast. A row whose bit is not set has no partner in ``keys``, so a wide table
    can be thinned where it is read, before the join that decides.
    """
    place = mark_place(key) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((MARK_BITS >> 15, 1 << 12), np.uint8)
    for row in rows.collect():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bits at ``place``, from ``mark_place``, are set."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def mark_place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARK_BITS))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; the component is its smallest node.

    Every node takes the smallest of itself and its neighbours as parent, and edges
    are carried over to parents until none is left. A parent is never larger than
    its child, so a component ends at its smallest node. Rows are two numbers wide;
    a node with many edges is pre-aggregated, and its joins are split by AQE.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")))
        labels = cut_lineage(
            parent.withColumnRenamed("parent", "component") if labels is None
            else labels.join(parent.withColumnRenamed("node", "component"), "component", "left")
            .select("node", F.coalesce("parent", "component").alias("component"))
        )
        pa, pb = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = cut_lineage(
            edges.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
