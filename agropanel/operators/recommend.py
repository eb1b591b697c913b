"""Search for fertilizer levels that raise the predicted yield."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.functions.order_stats import exact_quantiles
from agropanel.operators.models import YieldModel, score
from agropanel.runtime import cut_lineage
from agropanel.vocabulary import PIXEL_YEAR

Bounds = dict[str, tuple[float, float]]


def response_bounds_frame(
    df: DataFrame, ferts: Sequence[str], lo: float = 0.01, hi: float = 0.99
) -> DataFrame:
    """``feature, lo, hi``: low and high quantile of each column over all rows."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in ferts]).unpivot([], list(ferts), "feature", "value")
    present = long.filter(F.col("value").isNotNull())
    q = exact_quantiles(present, "value", [lo, hi], ["feature"])
    return q.select("feature", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))


def response_bounds(df: DataFrame, ferts: Sequence[str]) -> Bounds:
    rows = response_bounds_frame(df, ferts).collect()
    return {r["feature"]: (r["lo"], r["hi"]) for r in rows}


def candidates(bounds: Mapping[str, tuple[float, float]], levels: int = 7) -> dict[str, list[float]]:
    """Evenly spaced levels from the low to the high bound."""
    if levels < 2:
        raise ValueError("at least two levels")
    return {c: [lo + (hi - lo) * i / (levels - 1) for i in range(levels)] for c, (lo, hi) in bounds.items()}


def recommend(
    model: YieldModel,
    annual: DataFrame,
    bounds: Mapping[str, tuple[float, float]],
    passes: int = 3,
    levels: int = 7,
) -> DataFrame:
    """``pixel_id, year, pred_base, pred_opt`` and the chosen level per column (NULL where none helped).

    One column after the other, each row tries all levels and takes the best one
    if it beats what the row has so far; among equal predictions the lowest level
    wins. Levels are in the units of ``annual`` and flow through the derived
    features. All trials of a row are unfolded beside it and folded back in the same
    task, so nothing is shuffled; each pass is written, which keeps the plan short and a lost executor cheap.
    """
    grid = candidates(bounds, levels)
    columns = annual.columns
    absent = sorted(grid.keys() - set(columns))
    if absent:
        raise ValueError(f"bounds for columns that the table lacks: {', '.join(absent)}")

    def place(c: str) -> str:
        return f"`{c}`" if c in grid else f"_row.`{c}`"

    def scored(df: DataFrame, out: str) -> DataFrame:
        return score(model, df, out, columns, place)

    # Only the searched columns change; all others travel as one.
    start = annual.select(*PIXEL_YEAR, *grid, F.struct(*[c for c in columns if c not in grid]).alias("_row"))
    best = scored(start, "pred_base").withColumn("pred_opt", F.col("pred_base"))
    best = cut_lineage(best.withColumns({f"_best_{c}": F.lit(None).cast("double") for c in grid}))
    for _ in range(passes):
        step = best
        for c in grid:
            step = _try_levels(scored, step, c, grid[c])
        best = cut_lineage(step)
    return best.select(*PIXEL_YEAR, "pred_base", "pred_opt", *[F.col(f"_best_{c}").alias(c) for c in grid])


def _try_levels(
    scored: Callable[[DataFrame, str], DataFrame], best: DataFrame, column: str, levels: Sequence[float]
) -> DataFrame:
    kind, columns = best.schema[column].dataType, best.columns
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(levels)])
    trials = (
        best.withColumn("_t", F.explode(steps))
        # The row itself travels with its first trial only.
        .withColumn("_now", F.when(F.col("_t.i") == 0, F.struct(*columns)))
        .withColumn(column, F.col("_t.v").cast(kind))
    )
    tried = scored(trials, "_p").select("_now", F.col("_t.v").alias("_v"), F.col("_p").cast("double").alias("_p"))
    return tried.mapInArrow(_fold(column, len(levels)), best.schema)


def _fold(column: str, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's best trial: the trials of a row follow one another, as many as there are levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            rows = held.num_rows // levels
            if not rows:
                continue
            whole, held = held.slice(0, rows * levels), held.slice(rows * levels)
            now = whole.column(0).take(pa.array(np.arange(rows) * levels))
            if now.null_count or whole.column(0).null_count != rows * (levels - 1):
                raise RuntimeError("the trials of a row do not follow one another: the model's stages dealt rows anew")
            p = whole.column(2).to_numpy(zero_copy_only=False).reshape(rows, levels)
            p = np.where(np.isnan(p), -np.inf, p)
            winner = p.argmax(axis=1)  # of equal predictions the lowest level
            place = np.arange(rows)
            v = whole.column(1).to_numpy(zero_copy_only=False).reshape(rows, levels)[place, winner]
            fields = dict(zip([f.name for f in now.type], now.flatten()))
            better = pa.array(p[place, winner] > fields["pred_opt"].to_numpy(zero_copy_only=False))
            for name, values in ((column, v), (f"_best_{column}", v), ("pred_opt", p[place, winner])):
                fields[name] = pc.if_else(better, pa.array(values).cast(fields[name].type), fields[name])
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    return run
