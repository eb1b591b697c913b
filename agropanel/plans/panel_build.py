"""From layers, yields and fertilizers to the written panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.functions.climate import convert_units, null_sentinels
from agropanel.operators.assemble import rule_a, widen, with_static
from agropanel.operators.grid import GridSpec, fill_3x3, is_filled, kept_pixels
from agropanel.vocabulary import DYNAMIC_FEATURES, PANEL_KEYS, target_column

LAYER = ["dataset", "year", "month"]


def prepared_layers(
    layers: DataFrame, grid: GridSpec, passes: int = 2, convert: bool = True, count: int | None = None
) -> DataFrame:
    """Markers to NULL, physical units, gaps filled; the mask must not have been applied yet. ``count``: how many layers."""
    layers = null_sentinels(layers, ["value"])
    if convert:
        layers = convert_units(layers)
    return fill_3x3(layers, grid, LAYER, passes, layers=count)


def yearly_features(sources: DataFrame, features: Sequence[str], by: Sequence[str] = ("pixel_id", "year")) -> DataFrame:
    """Regridded fertilizer cells (``by``, feature, value) to one column per declared feature."""
    columns = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    return null_sentinels(sources, ["value"]).groupBy(*by).agg(*columns)


def static_features(sources: DataFrame, features: Sequence[str], grid: GridSpec, passes: int = 2) -> DataFrame:
    """Static cells (pixel_id, feature, value) to one column per feature; gaps are filled where the policy allows."""
    filled = [f for f in features if is_filled(f)]
    cells = null_sentinels(sources, ["value"]).select("feature", "pixel_id", "value")
    kept = cells.filter(~F.col("feature").isin(*filled)) if filled else cells
    if filled:
        open_cells = cells.filter(F.col("feature").isin(*filled))
        kept = kept.unionByName(fill_3x3(open_cells, grid, ["feature"], passes))
    return yearly_features(kept, features, ["pixel_id"])


def build_panel(
    layers: DataFrame,
    yields: DataFrame,
    yearly: DataFrame,
    grid: GridSpec,
    crop: str,
    mask: DataFrame | None = None,
    static: DataFrame | None = None,
    passes: int = 2,
    datasets: Sequence[str] = DYNAMIC_FEATURES,
    convert: bool = True,
) -> DataFrame:
    """Panel rows that pass the missing-data rule.

    ``layers`` (dataset, year, month, pixel_id, value) and ``yields``, ``yearly``
    (pixel_id, year, columns) are on the target grid already. Yield and
    fertilizers are yearly, so incomplete pixel-years are dropped before their
    months are unfolded, which is twelve times less work and gives the same rows.
    Months without any layer do not appear.
    """
    target = target_column(crop)
    ferts = [c for c in yearly.columns if c.startswith("fert_")]
    complete = null_sentinels(yields.join(yearly, ["pixel_id", "year"], "left"))
    complete = rule_a(complete, target, ferts)
    if static is not None:
        complete = with_static(complete, null_sentinels(static))
        complete = rule_a(complete, target, [c for c in complete.columns if c.startswith("fert_")])
    if mask is not None:
        complete = complete.join(kept_pixels(mask), "pixel_id", "left_semi")

    # The months seen are a calendar: one short array beside each pixel-year.
    # It is taken once, as the number of layers also tells how many tasks fill the gaps.
    seen = layers.select("year", "month").distinct().agg(F.sort_array(F.collect_set(F.struct("year", "month")))).first()[0]
    kinds = ", ".join(f"{c}: {layers.schema[c].dataType.simpleString()}" for c in ("year", "month"))
    calendar = F.array(*[F.struct(F.lit(m["year"]).alias("year"), F.lit(m["month"]).alias("month")) for m in seen])
    calendar = calendar.cast(f"ARRAY<STRUCT<{kinds}>>")
    months = F.transform(
        F.filter("_calendar", lambda m: m["year"] == F.col("year")), lambda m: m["month"]
    )
    spine = (
        complete.withColumn("_calendar", calendar)
        .withColumn("month", F.explode(months))
        .drop("_calendar")
    )
    wide = widen(prepared_layers(layers, grid, passes, convert, len(seen) * len(datasets)), datasets)
    joined = spine.join(wide, PANEL_KEYS, "left")
    rest = [c for c in complete.columns if c not in ("pixel_id", "year")]
    return joined.select(*PANEL_KEYS, *datasets, *rest)
