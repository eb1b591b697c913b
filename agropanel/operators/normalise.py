"""Z-scores whose statistics come from training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_zscore(train: DataFrame, cols: Sequence[str], by_month: bool = False) -> DataFrame:
    """Mean and population deviation per column: one row, or one per month."""
    stats = [s for c in cols for s in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return train.groupBy("month").agg(*stats) if by_month else train.agg(*stats)


def _z(c: str, mean: Column, std: Column, clip: float | None) -> Column:
    z = F.when(std == 0, F.col(c) * 0).otherwise(F.try_divide(F.col(c) - mean, std))
    if clip is None:
        return z
    # greatest/least skip NULL, which would turn a missing value into a bound.
    return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip))))


def zscore(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], by_month: bool = False, clip_std: float | None = 5.0
) -> DataFrame:
    """Standardise ``cols`` in place and limit them to ``clip_std`` deviations."""
    if by_month:
        # One row per month of the year: twelve at most.
        known = df.join(F.broadcast(stats), "month", "left")
        of = lambda c, s: F.col(f"{c}_{s}")
        return known.select(
            *[
                _z(c, of(c, "mean"), of(c, "std"), clip_std).alias(c) if c in set(cols) else F.col(c)
                for c in df.columns
            ]
        )
    whole = stats.select(F.struct("*")).scalar()
    of = lambda c, s: F.col(f"_stats.{c}_{s}")
    scaled = {c: _z(c, of(c, "mean"), of(c, "std"), clip_std) for c in cols}
    return df.withColumn("_stats", whole).withColumns(scaled).drop("_stats")


def normalise(
    df: DataFrame, train: DataFrame, cols: Sequence[str], scheme: str = "zscore_global", clip_std: float | None = 5.0
) -> DataFrame:
    """``zscore_global``, ``zscore_by_month`` or ``none``."""
    if scheme == "none":
        return df
    if scheme not in ("zscore_global", "zscore_by_month"):
        raise ValueError(f"unknown normalisation {scheme!r}")
    by_month = scheme == "zscore_by_month"
    return zscore(df, fit_zscore(train, cols, by_month), cols, by_month, clip_std)
