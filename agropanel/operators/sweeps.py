"""A whole grid of linear fits, over all folds, from one pass over the rows."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.functions.order_stats import trim_bounds
from agropanel.functions.targets import exp_target
from agropanel.operators import linear
from agropanel.operators.annual import feature_array
from agropanel.operators.metrics import METRIC_NAMES, metrics
from agropanel.operators.models import DEFAULTS, label_last, parameter_grid, solve_linear, transformed
from agropanel.operators.moments import Moments, added, moments
from agropanel.operators.splits import Fold


class Cell(NamedTuple):
    """One fit: a fold, the settings, weights of the raw features, and the bounds of the fold's trim."""

    fold: Fold
    params: dict
    weights: np.ndarray
    intercept: float
    low: float
    high: float


def fold_bounds(
    annual: DataFrame, target: str, folds: Sequence[Fold], trim: tuple[float | None, float | None], sequential: bool = True
) -> dict[Fold, tuple[float, float]]:
    """The trim's thresholds for the training rows of every fold, all from one table of counts per year and value."""
    lo, hi = trim[0] if trim[0] and trim[0] > 0 else None, trim[1] if trim[1] and trim[1] < 1 else None
    if lo is None and hi is None:
        return {f: (-np.inf, np.inf) for f in folds}
    y = F.col(target).cast("double")
    counts = annual.filter(y.isNotNull()).groupBy("year", y.alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    plan = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.val_year).alias("v"), F.lit(f.test_year).alias("t")) for i, f in enumerate(folds)])
    dealt = counts.withColumn("_f", F.explode(plan)).filter((F.col("year") != F.col("_f.v")) & (F.col("year") != F.col("_f.t")))
    found = trim_bounds(dealt.select(F.col("_f.i").alias("_fold"), "_y", "_n"), "_y", lo, hi, ["_fold"], sequential, "_n").collect()
    bounds = {folds[r["_fold"]]: (-np.inf if r["low"] is None else r["low"], np.inf if r["high"] is None else r["high"]) for r in found}
    return {f: bounds.get(f, (-np.inf, np.inf)) for f in folds}


def fold_moments(found: Mapping[tuple, Moments], fold: Fold, cuts: Sequence[float], low: float, high: float) -> Moments | None:
    """The training rows of a fold: all years but two, the pieces between its bounds."""
    first = 2 * bisect_left(cuts, low) + 1 if np.isfinite(low) else 0
    last = 2 * bisect_left(cuts, high) + 1 if np.isfinite(high) else 2 * len(cuts)
    return added(m for (year, piece), m in sorted(found.items()) if year not in (fold.val_year, fold.test_year) and first <= piece <= last)


def solve_cells(
    annual: DataFrame, features: Sequence[str], target: str, kind: str, grid: Mapping[str, Sequence], folds: Sequence[Fold],
    trim: tuple[float | None, float | None] = (None, None), log_transform: bool = False, log_offset: float = 1.0,
    derive: Mapping | None = None, **settings,
) -> list[Cell]:
    """All fits of the grid. The rows are read once: their moments are taken per year and piece of the target.

    The pieces lie between the bounds of all folds (a bound is a piece of its own), so
    that every fold's training rows are whole pieces of whole years. Their number does
    not grow with the rows. The fits of a ratio run from strong to weak penalties.
    """
    unknown = sorted({*settings, *grid} - DEFAULTS[kind].keys())
    if unknown:
        raise ValueError(f"{kind!r} has no setting {', '.join(unknown)}; known: {', '.join(DEFAULTS[kind])}")
    bounds = fold_bounds(annual, target, folds, trim)
    cuts = sorted({b for pair in bounds.values() for b in pair if np.isfinite(b)})
    label = transformed(target, log_transform, log_offset)
    rows, values = label_last(annual, features, label, derive or {})
    y = F.col(target).cast("double")
    below = [F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), test)) for test in (lambda c: c < y, lambda c: c <= y)] if cuts else [F.lit(0)] * 2
    found = moments(rows.withColumn("_piece", below[0] + below[1]), values, ["year", "_piece"])
    cells = []
    for fold in folds:
        own = fold_moments(found, fold, cuts, *bounds[fold])
        if own is None:
            continue
        problem = linear.Problem.of(own)
        starts: dict[str, np.ndarray] = {}
        for params in sorted(parameter_grid(grid), key=lambda p: -float(p.get("alpha", 0))):
            p = {**DEFAULTS[kind], **settings, **params}
            rest = json.dumps({k: v for k, v in params.items() if k != "alpha"}, sort_keys=True)
            starts[rest] = solve_linear(kind, problem, p, starts.get(rest))
            weights, intercept = problem.raw(starts[rest], p["fit_intercept"])
            cells.append(Cell(fold, params, weights, intercept, *bounds[fold]))
    return cells


def _predict(cells: Sequence[Cell]) -> Callable:
    """Rows ``(cell, split, y, z)`` of all fits in whose validation or test year a row lies."""
    weights = np.column_stack([c.weights for c in cells])
    intercepts = np.array([c.intercept for c in cells])
    low, high = np.array([c.low for c in cells]), np.array([c.high for c in cells])
    years = np.array([[c.fold.val_year, c.fold.test_year] for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            year, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            for part, name in enumerate(("val", "test")):
                row, cell = np.nonzero((year[:, None] == years[:, part]) & (y[:, None] >= low) & (y[:, None] <= high))
                if len(row):
                    z = np.einsum("ij,ji->i", x[row], weights[:, cell]) + intercepts[cell]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.astype(np.int32)), pa.array([name] * len(row)), pa.array(y[row]), pa.array(z)], names=["cell", "split", "y", "z"]
                    )

    return run


def linear_sweep(
    annual: DataFrame, features: Sequence[str], target: str, kind: str, grid: Mapping[str, Sequence], folds: Sequence[Fold],
    trim: tuple[float | None, float | None] = (None, None), log_transform: bool = False, log_offset: float = 1.0,
    derive: Mapping | None = None, **settings,
) -> DataFrame:
    """``fold, params, split`` and the scores of every fit of the grid on its fold's validation and test year.

    One pass gives the statistics of all fits, a second one all predictions, which are
    scored together.
    """
    spark = annual.sparkSession
    cells = solve_cells(annual, features, target, kind, grid, folds, trim, log_transform, log_offset, derive, **settings)
    names = spark.createDataFrame(
        [(i, c.fold.name, json.dumps(c.params, sort_keys=True)) for i, c in enumerate(cells)], "cell INT, fold STRING, params STRING"
    )
    held = sorted({y for f in folds for y in (f.val_year, f.test_year)})
    y = F.col(target).cast("double")
    rows = annual.filter(F.col("year").isin(held) & y.isNotNull()).select(
        F.col("year").cast("long").alias("year"), y.alias("y"), feature_array(annual.columns, features, derive or {}).alias("x")
    )
    schema = "cell INT, split STRING, y DOUBLE, z DOUBLE"
    tried = rows.mapInArrow(_predict(cells), schema) if cells else spark.createDataFrame([], schema)
    pred = exp_target(F.col("z"), log_offset) if log_transform else F.col("z")
    scores = metrics(tried.withColumn("p", pred), "y", "p", ["cell", "split"])
    # One row per fit.
    return scores.join(F.broadcast(names), "cell").select("fold", "params", "split", *[f"`{m}`" for m in METRIC_NAMES])
