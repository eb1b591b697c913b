"""Observations reduced to one value per cell and month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.functions.climate import vapour_pressure_deficit
from agropanel.functions.order_stats import exact_quantiles
from agropanel.vocabulary import DATASETS, Dataset


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add integer ``year`` and ``month``: the month that starts at its first day, end excluded."""
    return df.withColumns({"year": F.year(ts).cast("int"), "month": F.month(ts).cast("int")})


def month_bounds(df: DataFrame) -> DataFrame:
    """Add ``month_start`` and the excluded ``month_end`` of (year, month)."""
    start = F.make_date("year", "month", F.lit(1))
    return df.withColumns({"month_start": start, "month_end": F.add_months(start, 1)})


def composite(
    df: DataFrame, keys: Sequence[str], agg: str = "mean", value: str = "value", ts: str = "ts"
) -> DataFrame:
    """``sum``, ``median`` or (any other name) ``mean`` per key and month, missing values left out."""
    by = [*keys, "year", "month"]
    rows = with_month(df, ts).select(*by, value)
    agg = agg.lower()
    if agg == "median":
        present = rows.filter(F.col(value).isNotNull())
        middle = exact_quantiles(present, value, [0.5], by)
        return middle.select(*by, F.col("quantiles")[0].alias(value))
    reduced = F.sum(value) if agg == "sum" else F.avg(value)
    return rows.groupBy(*by).agg(reduced.alias(value))


def composite_datasets(
    df: DataFrame, keys: Sequence[str], datasets: Mapping[str, Dataset] = DATASETS, value: str = "value"
) -> DataFrame:
    """All datasets of one observation table: sums and means in one aggregation, medians beside it.

    A dataset whose reduction is neither ``sum`` nor ``median`` is averaged; datasets that are not listed are left out.
    """
    named = {kind: [k for k, d in datasets.items() if d.agg.lower() == kind] for kind in ("sum", "median")}
    other = [k for k in datasets if k not in named["sum"] + named["median"]]
    by = ["dataset", *keys, "year", "month"]
    rows = with_month(df)
    chosen = F.when(F.col("dataset").isin(*named["sum"]), F.col("_sum")).otherwise(F.col("_mean"))
    out = (
        rows.filter(F.col("dataset").isin(*named["sum"], *other))
        .groupBy(*by)
        .agg(F.sum(value).alias("_sum"), F.avg(value).alias("_mean"))
        .select(*by, chosen.alias(value))
    )
    if named["median"]:
        middle = exact_quantiles(rows.filter(F.col("dataset").isin(*named["median"])), value, [0.5], by)
        out = out.unionByName(middle.select(*by, F.col("quantiles")[0].alias(value)))
    return out


def vpd(df: DataFrame, keys: Sequence[str], t: str = "t2m", td: str = "td2m") -> DataFrame:
    """Monthly vapour pressure deficit: temperatures are averaged before the formula."""
    by = [*keys, "year", "month"]
    return with_month(df).groupBy(*by).agg(vapour_pressure_deficit(F.avg(t), F.avg(td)).alias("vpd"))
