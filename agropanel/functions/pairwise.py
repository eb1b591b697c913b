"""Moments of every two columns over the rows where both are present.

The moments of all pairs are a few small matrix products per Arrow batch.
As plain aggregates they would be about ten running sums for each pair, which
no generated code handles well. Spark merges the matrices of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTIAL = "a INT, b INT, n DOUBLE, ma DOUBLE, mb DOUBLE, saa DOUBLE, sbb DOUBLE, sab DOUBLE"


def _task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, shift = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
        there = ~np.isnan(rows)
        if shift is None:
            shift, known = np.zeros(rows.shape[1]), np.zeros(rows.shape[1], bool)
        # Sums are taken about a column's first present value, so that none of them cancels.
        # Until a column has one, its sums are zero and its shift may still be set.
        new = there.any(axis=0) & ~known
        shift[new] = rows[there.argmax(axis=0), np.arange(rows.shape[1])][new]
        known |= new
        moved = np.where(there, rows - shift, 0.0)
        mask = there.astype("float64")
        sums = np.stack([mask.T @ mask, moved.T @ mask, (moved * moved).T @ mask, moved.T @ moved])
        total = sums if total is None else total + sums
    if total is None:
        return
    n, s, q, c = total
    some = np.maximum(n, 1.0)
    a, b = np.indices(n.shape).reshape(2, -1).astype("int32")
    columns = [
        n, shift[:, None] + s / some, shift[None, :] + s.T / some,
        q - s * s / some, q.T - s.T * s.T / some, c - s * s.T / some,
    ]
    names = ["n", "ma", "mb", "saa", "sbb", "sab"]
    yield pa.RecordBatch.from_pydict({"a": a, "b": b, **{k: v.ravel() for k, v in zip(names, columns)}})


def pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, corr`` for all ordered pairs; NULL where a side is constant or never present."""
    cols = list(cols)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    partial = numbers.mapInArrow(_task_moments, PARTIAL).filter(F.col("n") > 0)
    pair = Window.partitionBy("a", "b")

    def centre(m: str):
        return F.sum(F.col(m) * F.col("n")).over(pair) / F.sum("n").over(pair)

    n, da, db = F.col("n"), F.col("ma") - F.col("ca"), F.col("mb") - F.col("cb")
    merged = (
        partial.withColumns({"ca": centre("ma"), "cb": centre("mb")})
        .groupBy("a", "b")
        .agg(
            F.sum("n").alias("n"), F.first("ca").alias("ca"), F.first("cb").alias("cb"),
            F.sum(F.col("saa") + n * da * da).alias("saa"),
            F.sum(F.col("sbb") + n * db * db).alias("sbb"),
            F.sum(F.col("sab") + n * da * db).alias("sab"),
        )
    )

    def varies(s: str, c: str):
        return F.sqrt(F.col(s) / F.col("n")) > F.abs(F.col(c)) * 1e-12

    names = F.array(*[F.lit(c) for c in cols])
    corr = F.when(
        varies("saa", "ca") & varies("sbb", "cb"),
        F.try_divide(F.col("sab"), F.sqrt("saa") * F.sqrt("sbb")),
    )
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("a"))
    grid = grid.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))))
    return grid.join(merged, ["a", "b"], "left").select(
        names[F.col("a")].alias("feature_a"), names[F.col("b")].alias("feature_b"), corr.alias("corr")
    )
