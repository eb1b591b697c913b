"""Coverage, missingness and distribution reports over a panel.

Each report is one plan; anything kept per pixel-year is aggregated before it
is counted again, and whatever reaches a single task is as small as a calendar
or a list of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.functions.hashing import draw_order
from agropanel.functions.order_stats import exact_quantiles
from agropanel.functions.pairwise import pairwise_correlation
from agropanel.vocabulary import DYNAMIC_FEATURES, PANEL_KEYS, PIXEL_YEAR, SENTINELS

FULL_YEAR = 12


def fert_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.startswith("fert_"))


def _sequence_lengths(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*PIXEL_YEAR).agg(F.count(F.lit(1)).alias("n_months"))


def q01_overview(panel: DataFrame) -> DataFrame:
    """Rows, distinct pixels and years, year span; pixel-years are counted first."""
    return _sequence_lengths(panel).agg(
        F.coalesce(F.sum("n_months"), F.lit(0)).alias("row_count"),
        F.count_distinct("pixel_id").alias("unique_pixels"),
        F.count_distinct("year").alias("unique_years"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )


def q02_sequence_lengths(panel: DataFrame) -> DataFrame:
    """Sequences per number of months, with the total over all lengths."""
    lengths = _sequence_lengths(panel).groupBy("n_months").agg(F.count(F.lit(1)).alias("num_sequences"))
    total = F.sum("num_sequences").over(Window.partitionBy())
    return lengths.withColumn("total_sequences", total).orderBy("n_months")


def q03_year_coverage(panel: DataFrame) -> DataFrame:
    full = F.sum(F.when(F.col("n_months") == FULL_YEAR, 1).otherwise(0))
    return (
        _sequence_lengths(panel)
        .groupBy("year")
        .agg(
            F.avg("n_months").alias("avg_months"),
            full.alias("full_sequences"),
            F.count(F.lit(1)).alias("total_sequences"),
            (full / F.count(F.lit(1))).alias("full_fraction"),
        )
        .orderBy("year")
    )


def _source_flags(yearly: DataFrame, target: str, ferts: Sequence[str], mask: DataFrame) -> DataFrame:
    has_fert = F.lit(True)
    for c in ferts:
        has_fert = has_fert & F.col(c).isNotNull()
    land = mask.select("pixel_id", (F.coalesce(F.col("mask"), F.lit(0.0)) >= 0.5).alias("has_mask"))
    flags = yearly.select(*PIXEL_YEAR, F.col(target).isNotNull().alias("has_yield"), has_fert.alias("has_fert"))
    return flags.join(land, "pixel_id", "left").withColumn("has_mask", F.coalesce("has_mask", F.lit(False)))


def q04_source_coverage(
    yearly: DataFrame, target: str, ferts: Sequence[str], mask: DataFrame, year: int | None = None
) -> DataFrame:
    """Per year (or for one): pixels with yield, with all fertilizers, on land, and with all of these."""
    if year is not None:
        yearly = yearly.filter(F.col("year") == year)
    has_yield, has_fert, has_mask = F.col("has_yield"), F.col("has_fert"), F.col("has_mask")
    return (
        _source_flags(yearly, target, ferts, mask)
        .groupBy("year")
        .agg(
            F.count_if(has_yield).alias("n_yield"),
            F.count_if(has_fert).alias("n_fert"),
            F.count_if(has_mask).alias("n_mask"),
            F.count_if(has_yield & has_fert).alias("n_yield_fert"),
            F.count_if(has_yield & has_fert & has_mask).alias("n_all"),
        )
        .orderBy("year")
    )


def q04_month_coverage(
    yearly: DataFrame,
    target: str,
    ferts: Sequence[str],
    mask: DataFrame,
    layers: DataFrame,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Per month: pixels with any layer, and those that also have yield, fertilizer and land."""
    if year is not None:
        yearly, layers = yearly.filter(F.col("year") == year), layers.filter(F.col("year") == year)
    if month is not None:
        layers = layers.filter(F.col("month") == month)
    seen = layers.filter(F.col("value").isNotNull()).select(*PANEL_KEYS).distinct()
    complete = _source_flags(yearly, target, ferts, mask).select(
        *PIXEL_YEAR, (F.col("has_yield") & F.col("has_fert") & F.col("has_mask")).alias("complete")
    )
    return (
        seen.join(complete, PIXEL_YEAR, "left")
        .groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("n_layers"), F.count_if(F.col("complete")).alias("n_all"))
        .orderBy("year", "month")
    )


def q05_month_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year", "month").agg(F.count(F.lit(1)).alias("row_count")).orderBy("year", "month")


def q05_month_pivot(panel: DataFrame) -> DataFrame:
    """Year x month grid of row counts, 0 where there is none."""
    cells = [F.count_if(F.col("month") == m).alias(f"m{m:02d}") for m in range(1, 13)]
    return panel.groupBy("year").agg(*cells).orderBy("year")


def q06_month_presence(panel: DataFrame) -> DataFrame:
    """Share of sequences that have a month.

    The months of a pixel-year are twelve counters on its row, so one shuffle
    serves both the numerator and the denominator.
    """
    flags = [F.max(F.when(F.col("month") == m, 1).otherwise(0)).alias(str(m)) for m in range(1, 13)]
    wide = panel.groupBy(*PIXEL_YEAR).agg(*flags)
    totals = wide.agg(
        F.count(F.lit(1)).alias("total_sequences"), *[F.sum(str(m)).alias(str(m)) for m in range(1, 13)]
    )
    return (
        totals.unpivot("total_sequences", [str(m) for m in range(1, 13)], "month", "seq_with_month")
        .filter(F.col("seq_with_month") > 0)
        .select(
            F.col("month").cast("int").alias("month"),
            "seq_with_month",
            "total_sequences",
            (F.col("seq_with_month") / F.col("total_sequences")).alias("fraction"),
        )
        .orderBy("month")
    )


def _missing(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double"))


def q07_missing(panel: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing fraction per column, one scan for all of them."""
    cols = list(cols) if cols is not None else [*DYNAMIC_FEATURES, *fert_columns(panel)]
    wide = panel.agg(*[F.coalesce(_missing(c), F.lit(0.0)).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "fraction_missing").orderBy(F.desc("fraction_missing"), "feature")


def q08_month_means(panel: DataFrame, target: str, cols: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    means = [F.avg(c).alias(f"avg_{c}") for c in cols]
    return panel.groupBy("month").agg(*means, F.avg(target).alias("avg_yield")).orderBy("month")


def q09_missing_by_month(panel: DataFrame, cols: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    cols = list(cols)
    wide = panel.groupBy("month").agg(*[_missing(c).alias(c) for c in cols])
    return wide.unpivot("month", cols, "feature", "fraction_missing").orderBy("month", "feature")


def q10_target_stats(panel: DataFrame, target: str) -> DataFrame:
    present = panel.select(F.col(target).cast("double").alias("t"))
    moments = present.agg(
        F.avg("t").alias("mean"), F.min("t").alias("min"), F.max("t").alias("max"), F.stddev_pop("t").alias("std")
    )
    middle = exact_quantiles(present.filter(F.col("t").isNotNull()), "t", [0.5])
    median = middle.select(F.col("quantiles")[0]).scalar()
    return moments.select("mean", median.alias("median"), "min", "max", "std")


def q11_first_key(panel: DataFrame) -> DataFrame:
    return panel.select(*PIXEL_YEAR).distinct().orderBy(*PIXEL_YEAR).limit(1)


def q12_columns(panel: DataFrame) -> DataFrame:
    """Columns in order, which are fertilizers, and how many rows have a value."""
    cols = panel.columns
    present = panel.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "name", "present")
    return present.select("name", F.col("name").startswith("fert_").alias("is_fert"), "present")


def q13_crop_summary(panels: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per crop from its pixel-years and its target moments."""
    rows = None
    for crop, (panel, target) in panels.items():
        full = F.count_if(F.col("n_months") == FULL_YEAR)
        years = F.concat(
            F.min("year").cast("string"), F.lit("–"), F.max("year").cast("string"),
            F.lit(" ("), F.count_distinct("year").cast("string"), F.lit(" yrs)"),
        )
        coverage = _sequence_lengths(panel).agg(
            F.sum("n_months").alias("rows"),
            F.count(F.lit(1)).alias("pixel_year_sequences"),
            F.count_distinct("pixel_id").alias("unique_pixels"),
            years.alias("years"),
            F.min("n_months").alias("min_months"),
            F.max("n_months").alias("max_months"),
            F.when(full > 0, full / F.count(F.lit(1))).alias("full_sequence_fraction"),
        )
        t = F.col(target).cast("double")
        moments = panel.agg(F.struct(F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"))).scalar()
        row = (
            coverage.withColumn("_m", moments)
            .select(
                F.lit(crop).alias("crop"), *coverage.columns,
                F.col("_m.mean").alias("yield_mean"), F.col("_m.std").alias("yield_std"),
            )
        )
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise ValueError("no crop given")
    return rows


def q14_seasonality(panel: DataFrame, cols: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    """Monthly means, z-scored within each feature; 0 where a feature never varies."""
    cols = list(cols)
    means = panel.groupBy("month").agg(*[F.avg(c).alias(c) for c in cols])
    long = means.unpivot("month", cols, "feature", "value")
    within = Window.partitionBy("feature")
    std = F.stddev_pop("value").over(within)
    z = F.when(std == 0, F.col("value") * 0).otherwise(
        F.try_divide(F.col("value") - F.avg("value").over(within), std)
    )
    return long.withColumn("zscore", z).orderBy("feature", "month")


def q15_histogram(panel: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram between minimum and maximum; the top edge belongs to the last bin."""
    v = F.col(col).cast("double")
    present = panel.select(v.alias("v")).filter(F.col("v").isNotNull())
    edges = present.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spread = edges.select(F.struct("lo", "hi")).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    place = F.least(
        F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_e.lo"), width)).cast("int"), F.lit(0)), F.lit(bins - 1)
    )
    counts = present.withColumn("_e", spread).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = edges.select(
        F.lit(col).alias("feature"), "lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    return (
        frame.join(counts, "bin", "left")
        .select(
            "feature", "bin",
            (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_from"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_to"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        )
        .orderBy("bin")
    )


def q16_example_sequence(panel: DataFrame, target: str, cols: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    """The months of the smallest (pixel, year); the key is one row, so its join broadcasts it."""
    key = F.broadcast(q11_first_key(panel))
    return panel.join(key, PIXEL_YEAR, "left_semi").select("month", *cols, target, *fert_columns(panel)).orderBy("month")


def q17_narrative(panel: DataFrame, cols: Sequence[str] = DYNAMIC_FEATURES) -> DataFrame:
    """Sequences, their shortest and longest, full share, short ones, mean missingness of the dynamics."""
    cols = list(cols)
    total = F.lit(0.0)
    for c in cols:
        total = total + _missing(c)
    lengths = _sequence_lengths(panel)
    full = F.count_if(F.col("n_months") == FULL_YEAR)
    return lengths.agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.min("n_months").alias("min_months"),
        F.max("n_months").alias("max_months"),
        F.when(full > 0, full / F.count(F.lit(1))).alias("full_fraction"),
        F.count_if(F.col("n_months") < FULL_YEAR).alias("short_sequences"),
    ).withColumn("mean_dynamic_missing", panel.agg(total / len(cols)).scalar())


def q18_missing_cells(panel: DataFrame, top: int = 20) -> DataFrame:
    """Columns with most missing cells, with the total over all columns."""
    cols = panel.columns
    wide = panel.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    total = F.lit(0).cast("long")
    for c in cols:
        total = total + F.col(c)
    return (
        wide.withColumn("total_missing", total)
        .unpivot("total_missing", cols, "feature", "missing")
        .filter(F.col("missing") > 0)
        .orderBy(F.desc("missing"), "feature")
        .limit(top)
    )


def _numeric(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def q19_sentinels(panel: DataFrame) -> DataFrame:
    """Cells equal to each no-data marker, compared in the type of their column."""
    def hits(mark: float) -> Column:
        total = F.lit(0).cast("long")
        for f in _numeric(panel):
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                total = total + F.count_if(F.col(f.name) == F.lit(mark).cast(f.dataType))
            elif mark == -9999.0:
                total = total + F.count_if(F.col(f.name) == -9999)
        return total

    names = {"-9999" if m == -9999.0 else "1e20" if m == 1e20 else str(m): m for m in SENTINELS}
    wide = panel.agg(*[hits(m).alias(name) for name, m in names.items()])
    return wide.unpivot([], list(names), "sentinel", "cells")


def q20_calendar(panel: DataFrame) -> DataFrame:
    """Distinct years and months."""
    seen = panel.select("year", "month").distinct()
    parts = seen.select(F.explode(F.array(
        F.struct(F.lit("year").alias("part"), F.col("year").cast("int").alias("value")),
        F.struct(F.lit("month").alias("part"), F.col("month").cast("int").alias("value")),
    )).alias("e"))
    return parts.select("e.*").distinct().orderBy("part", "value")


def q21_rows_per_pixel(panel: DataFrame) -> DataFrame:
    per_pixel = panel.groupBy("pixel_id").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(per_pixel, "n", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["min", "q25", "median", "q75", "max"]
    return q.select(*[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)])


def q22_sample(panel: DataFrame, n: int = 5000, seed: int = 0) -> DataFrame:
    """At most ``n`` rows in a repeatable pseudo-random order of their key."""
    order = draw_order(F.col("pixel_id"), F.col("year"), F.col("month"), seed=seed)
    return panel.orderBy(order, *PANEL_KEYS).limit(n)


def q23_correlation(panel: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete correlation of all numeric columns over all rows."""
    return pairwise_correlation(panel, [f.name for f in _numeric(panel)] if cols is None else cols)
