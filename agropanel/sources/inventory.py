"""Which layers exist, which are missing and which still have to be made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER_KEY = ["dataset", "year", "month"]


def month_spine(spark: SparkSession, datasets: Sequence[str], start_year: int, end_year: int) -> DataFrame:
    """Every dataset in every month of the inclusive year range."""
    return (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(d) for d in datasets])).alias("dataset"))
        .withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))))
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    )


def source_inventory(existing: DataFrame, datasets: Sequence[str], start_year: int, end_year: int) -> DataFrame:
    """Expected, found and missing months per dataset."""
    found = existing.select(*LAYER_KEY).distinct().withColumn("_hit", F.lit(1))
    spine = month_spine(existing.sparkSession, datasets, start_year, end_year)
    return (
        spine.join(found, LAYER_KEY, "left")
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count("_hit").alias("found"),
            F.count_if(F.col("_hit").isNull()).alias("missing"),
        )
        .orderBy("dataset")
    )


def pending(spine: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Dataset-months still to do: those that do not exist yet, or all when overwriting."""
    if overwrite:
        return spine
    return spine.join(existing.select(*LAYER_KEY).distinct(), LAYER_KEY, "left_anti")
