"""Layers, yearly values and static attributes joined to the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.vocabulary import DYNAMIC_FEATURES, PANEL_KEYS, PIXEL_YEAR


def widen(layers: DataFrame, datasets: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    """One row per pixel and month, one column per dataset; the column list is declared, not discovered."""
    columns = [F.max(F.when(F.col("dataset") == d, F.col("value"))).alias(d) for d in datasets]
    return layers.filter(F.col("dataset").isin(*datasets)).groupBy(*PANEL_KEYS).agg(*columns)


def panel_spine(pixels: DataFrame, layers: DataFrame) -> DataFrame:
    """Every kept pixel in every (year, month) that has at least one layer.

    The months are a calendar: a single short array, attached to each pixel row
    and unfolded there.
    """
    months = layers.select("year", "month").distinct()
    calendar = months.agg(F.sort_array(F.collect_set(F.struct("year", "month")))).scalar()
    return (
        pixels.select("pixel_id")
        .distinct()
        .withColumn("_m", F.explode(calendar))
        .select("pixel_id", F.col("_m.year").alias("year"), F.col("_m.month").alias("month"))
    )


def with_yearly(panel: DataFrame, yearly: DataFrame) -> DataFrame:
    """Yearly columns repeated on each month; a year that is absent stays missing."""
    return panel.join(yearly, PIXEL_YEAR, "left")


def with_static(panel: DataFrame, static: DataFrame) -> DataFrame:
    return panel.join(static, "pixel_id", "left")


def _incomplete(target: str, ferts: Sequence[str]) -> Column:
    bad = F.col(target).isNull()
    for c in ferts:
        bad = bad | F.col(c).isNull()
    return bad


def fert_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("fert_")]


def rule_a(df: DataFrame, target: str, ferts: Sequence[str] | None = None) -> DataFrame:
    """Rows that have the yield and every declared fertilizer."""
    ferts = fert_columns(df) if ferts is None else list(ferts)
    return df.filter(~_incomplete(target, ferts))


def rule_a_report(df: DataFrame, target: str, ferts: Sequence[str] | None = None) -> DataFrame:
    """Per month: rows before, rows dropped, cells still missing in the kept rows."""
    ferts = fert_columns(df) if ferts is None else list(ferts)
    bad = _incomplete(target, ferts)
    gaps = F.lit(0)
    for c in df.columns:
        gaps = gaps + F.col(c).isNull().cast("int")
    return (
        df.groupBy("year", "month")
        .agg(
            F.count(F.lit(1)).alias("rows_before"),
            F.count_if(bad).alias("rows_dropped"),
            F.coalesce(F.sum(F.when(~bad, gaps)), F.lit(0)).cast("long").alias("missing_left"),
        )
        .orderBy("year", "month")
    )


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = PIXEL_YEAR) -> DataFrame:
    """Rows whose key is listed; listed twice counts once."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def history_window(df: DataFrame, year: int, history_years: int = 1) -> DataFrame:
    """Rows of the ``history_years`` years that end with ``year``."""
    return df.filter(F.col("year").between(year - history_years + 1, year))


def sequence_of(df: DataFrame, pixel_id: int, year: int) -> DataFrame:
    """The months of one pixel-year in order."""
    return df.filter((F.col("pixel_id") == pixel_id) & (F.col("year") == year)).orderBy("month")
