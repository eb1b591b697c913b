"""Thinning of training sequences per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.functions.hashing import draw_order
from agropanel.functions.order_stats import exact_quantiles
from agropanel.operators.assemble import keep_keys
from agropanel.vocabulary import PIXEL_YEAR

BINS = 10


def _first_by_order(df: DataFrame, group: list[str], take: Column, most: int, order: Column) -> DataFrame:
    """The first ``take`` rows of each group; no group takes more than ``most``.

    The literal bound lets Spark keep only ``most`` rows of a group in each task
    before the shuffle, so no task sorts a whole group.
    """
    df = df.withColumns({"_o": order, "_t": take})
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_o", *PIXEL_YEAR))
    return df.withColumn("_r", place).filter((F.col("_r") <= F.lit(most)) & (F.col("_r") <= F.col("_t")))


def downsample_keys(
    train: DataFrame,
    target: str,
    per_year_max: int,
    stratify: str = "yield_decile",
    seed: int = 1337,
) -> DataFrame:
    """Kept (pixel, year) keys.

    Years within the cap stay whole. Larger ones are cut at their target deciles
    (equal edges once, bins closed on the right) and give the same number of
    keys per bin, or, with ``random``, ``per_year_max`` keys.
    """
    if stratify not in ("yield_decile", "random"):
        raise ValueError(f"unknown stratification {stratify!r}")
    keys = train.select(*PIXEL_YEAR, F.col(target).cast("double").alias("_y")).distinct()
    order = draw_order(F.col("pixel_id"), F.col("year"), seed=seed)
    # One row per calendar year, here and for the edges below: small whatever the table.
    sizes = keys.groupBy("year").agg(F.count(F.lit(1)).alias("_size"))
    sized = keys.join(F.broadcast(sizes), "year")
    whole = sized.filter(F.col("_size") <= per_year_max).select(*PIXEL_YEAR)
    large = sized.filter(F.col("_size") > per_year_max)
    if stratify == "random":
        picked = _first_by_order(large, ["year"], F.lit(per_year_max), per_year_max, order)
    else:
        edges = exact_quantiles(
            large.filter(F.col("_y").isNotNull()), "_y", [i / BINS for i in range(BINS + 1)], ["year"]
        ).select("year", F.array_distinct("quantiles").alias("_edges"))
        below = F.size(F.filter("_edges", lambda e: e < F.col("_y")))
        bins = F.greatest(F.size("_edges") - 1, F.lit(1))
        per_bin = F.greatest(F.floor(F.lit(per_year_max) / bins), F.lit(1)).cast("int")
        binned = large.join(F.broadcast(edges), "year").withColumn("_bin", F.greatest(below - 1, F.lit(0)))
        picked = _first_by_order(binned.filter(F.col("_y").isNotNull()), ["year", "_bin"], per_bin, max(1, per_year_max), order)
    return whole.unionByName(picked.select(*PIXEL_YEAR)).distinct()


def downsample(
    train: DataFrame,
    target: str,
    per_year_max: int,
    stratify: str = "yield_decile",
    seed: int = 1337,
) -> DataFrame:
    """Training rows whose (pixel, year) was kept."""
    return keep_keys(train, downsample_keys(train, target, per_year_max, stratify, seed))
