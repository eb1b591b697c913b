"""Means and scatter matrices of feature vectors, taken in one pass and added up in Spark.

``Moments`` of two sets of rows add up to those of both without loss: means are moved
and the scatter grows by the outer product of their difference, so nothing is ever
subtracted from a large sum. A linear fit on any union of groups needs no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial sums of a group are added up in so many tasks before the last one adds those.
FANS = 64


@dataclass(frozen=True)
class Moments:
    """Rows, their mean and the sum of products of deviations from it."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:
        n, apart = self.n + other.n, other.mean - self.mean
        share = other.n / n
        return Moments(n, self.mean + apart * share, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * share))


def added(parts: Iterable[Moments]) -> Moments | None:
    parts = list(parts)
    return reduce(Moments.__add__, parts) if parts else None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(keys: list[tuple], found: list[Moments], by: Sequence[str], part: int) -> pa.RecordBatch:
    upper = np.triu_indices(len(found[0].mean))
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(len(by))]
    columns += [pa.array([part] * len(found), pa.int32()), pa.array([m.n for m in found], pa.int64())]
    columns += [pa.array([m.mean for m in found], pa.list_(pa.float64())), pa.array([m.scatter[upper] for m in found], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=[*by, "_part", "n", "mean", "upper"])


def _unpacked(table: pa.Table | pa.RecordBatch) -> list[Moments]:
    out = []
    for n, mean, flat in zip(table["n"].to_pylist(), table["mean"], table["upper"]):
        mean, flat = np.array(mean.values), np.array(flat.values)
        scatter = np.zeros((len(mean), len(mean)))
        scatter[np.triu_indices(len(mean))] = flat
        out.append(Moments(n, mean, scatter + np.triu(scatter, 1).T))
    return out


def _partial(by: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple, Moments] = {}
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column(len(by)))
            if not by:
                held[()] = held[()] + Moments.of(values) if held else Moments.of(values)
                continue
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(by))])
            groups, place = np.unique(keys, axis=0, return_inverse=True)
            for i, key in enumerate(map(tuple, groups.tolist())):
                new = Moments.of(values[place.reshape(-1) == i])
                held[key] = held[key] + new if key in held else new
        if held:
            yield _packed(list(held), list(held.values()), by, TaskContext.get().partitionId())

    return run


def _merge(by: Sequence[str]) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = added(_unpacked(table))
        return pa.Table.from_batches([_packed([tuple(k.as_py() for k in key[: len(by)])], [whole], by, 0)])

    return run


def moments(rows: DataFrame, values: Column, by: Sequence[str]) -> dict[tuple, Moments]:
    """``Moments`` of the array ``values`` (no NULL in it) for each key of the whole-number columns ``by``.

    Each task adds up its own rows, one small row per group leaves it, and those are
    added up in two steps. The driver gets one matrix per group, whatever the rows.
    """
    by = list(by)
    keys = "".join(f"{c} long, " for c in by)
    schema = f"{keys}_part int, n long, mean array<double>, upper array<double>"
    parts = rows.select(*[F.col(c).cast("long").alias(c) for c in by], values.alias("_values")).mapInArrow(_partial(by), schema)
    fanned = parts.withColumn("_fan", F.col("_part") % FANS).groupBy(*by, "_fan").applyInArrow(_merge(by), schema)
    table = fanned.groupBy(*by).applyInArrow(_merge(by), schema).toArrow()
    found = _unpacked(table)
    return {tuple(table[c][i].as_py() for c in by): m for i, m in enumerate(found)}
