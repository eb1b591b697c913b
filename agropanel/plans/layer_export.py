"""From time-stamped observations to monthly layers on the target grid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.functions.climate import null_sentinels, vapour_pressure_deficit
from agropanel.operators.composite import composite_datasets, with_month
from agropanel.operators.grid import GridSpec, clip_aoi, clip_box, grid_frame, regrid, with_pixel_id
from agropanel.sources.inventory import LAYER_KEY, pending
from agropanel.sources.tables import chosen_datasets
from agropanel.vocabulary import DATASETS

VPD = "era5_vpd"
# Observation keys of the two temperatures that the derived layer needs, in kelvin.
AIR, DEW = "era5_temp2m", "era5_dewpoint2m"
CELL = ["lon", "lat"]


def monthly_layers(
    obs: DataFrame,
    target: GridSpec,
    start_year: int,
    end_year: int,
    datasets: str | Iterable[str] | None = None,
    existing: DataFrame | None = None,
    overwrite: bool = False,
    method: str = "average",
    box: tuple[float, float, float, float] | None = None,
    area: DataFrame | None = None,
    country: str | None = None,
) -> DataFrame:
    """``dataset, year, month, pixel_id, value`` from ``dataset, lon, lat, ts, value``.

    Months whose layer is in ``existing`` are left out unless ``overwrite``. Each
    dataset has its own grid, read off its coordinates: one pass gives the grids of
    all of them, a second one all monthly values. ``box`` (west, south, east, north)
    bounds the observations; with ``area`` (``pixel_id, country`` on the target
    grid) only pixels of ``country`` are kept.
    """
    if (area is None) != (country is None):
        raise ValueError("an area needs a country, and a country an area")
    wanted = chosen_datasets(datasets)
    needed = [*wanted, *([AIR, DEW] if VPD in wanted else [])]
    seen = with_month(null_sentinels(obs, ["value"]).filter(F.col("dataset").isin(*needed)))
    seen = seen.filter(F.col("year").between(start_year, end_year))
    if box is not None:
        seen = clip_box(seen, *box)
    # At most one row per known dataset.
    grids = {r["dataset"]: GridSpec(**{k: r[k] for k in r.asDict() if k != "dataset"}) for r in grid_frame(seen, ["dataset"]).collect()}
    of_grid: dict[GridSpec, list[str]] = {}
    for key in wanted:
        grid = grids.get(AIR if key == VPD else key)
        if grid is not None:
            of_grid.setdefault(grid, []).append(key)
    if not of_grid:
        raise ValueError("no observation of the chosen datasets in these years")
    reductions = {k: DATASETS.get(k, DATASETS[AIR]) for k in needed if k != VPD}
    monthly = composite_datasets(seen, CELL, reductions)
    values = monthly.filter(F.col("dataset").isin(*wanted))
    if VPD in wanted:
        values = values.unionByName(_derived(monthly))
    if existing is not None:
        values = pending(values, existing, overwrite)
    out = None
    for source, keys in of_grid.items():
        part = with_pixel_id(values.filter(F.col("dataset").isin(*keys)), source).drop("pixel_id")
        layer = regrid(part, source, target, method, LAYER_KEY)
        out = layer if out is None else out.unionByName(layer)
    return out if area is None else clip_aoi(out, area, country)


def _derived(monthly: DataFrame) -> DataFrame:
    """The derived layer from the monthly means of both temperatures."""
    mean = lambda key: F.max(F.when(F.col("dataset") == key, F.col("value")))
    return (
        monthly.filter(F.col("dataset").isin(AIR, DEW))
        .groupBy(*CELL, "year", "month")
        .agg(vapour_pressure_deficit(mean(AIR), mean(DEW)).alias("value"))
        .withColumn("dataset", F.lit(VPD))
    )
