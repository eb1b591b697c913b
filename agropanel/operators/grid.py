"""Cells on a latitude/longitude grid: pixel keys, regridding, masks and gap filling.

Row 0 is the northernmost row and column 0 the westernmost column. Layer
columns (dataset, year, month ...) are part of the key everywhere, so all layers
of all months go through one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The step used when an axis has one coordinate only, and the share
# of a mask cell from which a pixel counts as land.
SINGLE_STEP = 0.083333333333
LAND_SHARE = 0.5

TILE = 64
#: So many cells go to one task of a filling; all its passes hold their cells at once.
TASK_CELLS = 200_000
_TINY = 1e-9


@dataclass(frozen=True)
class GridSpec:
    """Outer north-west corner, cell size and extent of a grid."""

    west: float
    north: float
    xres: float
    yres: float
    width: int
    height: int

    def row_of(self, pixel: Column) -> Column:
        return F.call_function("div", pixel, F.lit(self.width).cast("long"))

    def col_of(self, pixel: Column) -> Column:
        return F.pmod(pixel, F.lit(self.width).cast("long"))

    def pixel(self, row: Column, col: Column) -> Column:
        return row.cast("long") * F.lit(self.width).cast("long") + col.cast("long")

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)


def grid_frame(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Grid of a coordinate table as one row per ``by``; any file order gives the same grid.

    The mean step of sorted distinct coordinates is their span over their
    number less one, so nothing needs sorting.
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    seen = cells.groupBy(*by).agg(
        F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.count_distinct(lon).alias("nx"),
        F.min(lat).alias("y0"), F.max(lat).alias("y1"), F.count_distinct(lat).alias("ny"),
    )

    def step(first: str, last: str, n: str) -> Column:
        return F.coalesce(F.try_divide(F.col(last) - F.col(first), F.col(n) - 1), F.lit(SINGLE_STEP))

    return seen.withColumns({"xres": step("x0", "x1", "nx"), "yres": step("y0", "y1", "ny")}).select(
        *by,
        (F.col("x0") - F.col("xres") / 2).alias("west"),
        (F.col("y1") + F.col("yres") / 2).alias("north"),
        "xres", "yres",
        F.col("nx").alias("width"), F.col("ny").alias("height"),
    )


def grid_spec(cells: DataFrame) -> GridSpec:
    row = grid_frame(cells).first()
    if not row["width"]:
        raise ValueError("no coordinates to derive a grid from")
    return GridSpec(**row.asDict())


def with_pixel_id(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Add ``row``, ``col`` and ``pixel_id``; cells outside the grid have no pixel and drop out."""
    col = F.floor((F.col("lon") - grid.west) / grid.xres).cast("long")
    row = F.floor((F.lit(grid.north) - F.col("lat")) / grid.yres).cast("long")
    placed = cells.withColumns({"row": row, "col": col}).filter(grid.holds(F.col("row"), F.col("col")))
    return placed.withColumn("pixel_id", grid.pixel(F.col("row"), F.col("col")))


def yield_by_year(
    series: DataFrame, y0: int, y1: int, time: str | None = "time", slice_col: str | None = None, value: str = "value"
) -> DataFrame:
    """Yield per pixel and year within [y0, y1].

    ``time`` may be a date or an integer year; where a year occurs twice the last
    slice counts. Without a time axis the value holds for every year.
    """
    v = F.when(~F.isnan(value), F.col(value))
    if time is None:
        years = F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year")
        return series.select("pixel_id", years, v.alias(value))
    kind = series.schema[time].dataType.typeName()
    year = F.col(time).cast("int") if kind in ("integer", "long", "short") else F.year(time)
    last = F.col(slice_col) if slice_col else F.col(time)
    return (
        series.select("pixel_id", year.alias("year"), v.alias("_v"), last.alias("_s"))
        .filter(F.col("year").between(y0, y1))
        .groupBy("pixel_id", "year")
        .agg(F.max_by("_v", "_s").alias(value))
    )


# --- regridding -------------------------------------------------------------

# A kernel tells, along one axis, which target cells a source cell reaches and
# with which weight. Arguments are positions in target-cell units.
Reach = tuple[Column, Column]


def _overlap(begin: Column, end: Column, ratio: float, index: Column) -> tuple[Reach, Callable[[Column], Column]]:
    reach = (F.floor(begin + _TINY), F.ceil(end - _TINY) - 1)
    return reach, lambda k: F.least(end, k + 1) - F.greatest(begin, k)


def _centre_inside(begin: Column, end: Column, ratio: float, index: Column) -> tuple[Reach, Callable[[Column], Column]]:
    reach = (F.ceil(begin - 0.5), F.ceil(end - 0.5) - 1)
    return reach, lambda k: F.lit(1.0)


def _tent(begin: Column, end: Column, ratio: float, index: Column) -> tuple[Reach, Callable[[Column], Column]]:
    # Weight falls from 1 at the source centre to 0 one source cell away.
    middle = (begin + end) / 2
    reach = (F.ceil(middle - ratio - 0.5), F.floor(middle + ratio - 0.5))
    return reach, lambda k: 1 - F.abs(k + 0.5 - middle) / ratio


KERNELS = {"average": _overlap, "nearest": _centre_inside, "bilinear": _tent}


def regrid(
    cells: DataFrame,
    source: GridSpec,
    target: GridSpec,
    method: str = "average",
    layer: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Values on ``target`` as (``layer``, pixel_id, ``value``); missing source cells count for nothing.

    Each source cell names the target cells it reaches, so the grids are never
    joined. Unknown methods average. ``nearest`` moves no data at all, the other
    two are one aggregation with partial sums.
    """
    kernel = KERNELS.get(method.lower(), _overlap)
    present = cells.filter(F.col(value).isNotNull())

    def edge(index: Column, origin_gap: float, step: float, target_step: float) -> Column:
        return (F.lit(origin_gap) + index * step) / target_step

    dx, dy = source.west - target.west, target.north - source.north
    reaches, weights = {}, {}
    for axis, gap, step, tstep in (("col", dx, source.xres, target.xres), ("row", dy, source.yres, target.yres)):
        index = F.col(axis)
        begin, end = edge(index, gap, step, tstep), edge(index + 1, gap, step, tstep)
        reaches[axis], weights[axis] = kernel(begin, end, step / tstep, index)

    def cells_reached(axis: str, extent: int) -> Column:
        low = F.greatest(reaches[axis][0], F.lit(0)).cast("long")
        high = F.least(reaches[axis][1], F.lit(extent - 1)).cast("long")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    spread = (
        present.withColumn("_tc", F.explode(cells_reached("col", target.width)))
        .withColumn("_tr", F.explode(cells_reached("row", target.height)))
        .withColumn("_w", weights["col"](F.col("_tc")) * weights["row"](F.col("_tr")))
        .withColumn("pixel_id", target.pixel(F.col("_tr"), F.col("_tc")))
    )
    if kernel is _centre_inside:
        return spread.select(*layer, "pixel_id", F.col(value))
    if kernel is _tent:
        # A centre outside the source has no value even if it is near the edge.
        x = (F.col("_tc") + 0.5) * target.xres - dx
        y = (F.col("_tr") + 0.5) * target.yres - dy
        spread = spread.filter(
            x.between(0, source.width * source.xres) & y.between(0, source.height * source.yres)
        )
    return (
        spread.filter(F.col("_w") > _TINY)
        .groupBy(*layer, "pixel_id")
        .agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))
    )


# --- masks and areas --------------------------------------------------------


def land_mask(water: DataFrame, threshold: float = 50) -> DataFrame:
    """1 where water was seen in less than ``threshold`` percent of looks; never seen counts as land."""
    dry = F.coalesce(F.col("occurrence"), F.lit(0.0)) < threshold
    return water.withColumn("mask", F.when(dry, 1.0).otherwise(0.0)).drop("occurrence")


def kept_pixels(mask: DataFrame) -> DataFrame:
    """Keys of masked-in pixels; an empty mask is an error."""
    kept = mask.filter(F.col("mask") >= LAND_SHARE).select("pixel_id").distinct()
    if mask.filter(F.col("mask") >= LAND_SHARE).isEmpty():
        raise ValueError("the mask keeps no pixel: check its scale and threshold")
    return kept


def apply_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of masked-in pixels. The side to broadcast is left to measured sizes."""
    return df.join(kept_pixels(mask), "pixel_id", "left_semi")


def clip_aoi(df: DataFrame, cells: DataFrame, country: str) -> DataFrame:
    """Rows of pixels that belong to one country."""
    inside = cells.filter(F.col("country") == country).select("pixel_id").distinct()
    return df.join(inside, "pixel_id", "left_semi")


def clip_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows inside a longitude/latitude box; reaches the scan as a plain range filter."""
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


# --- gap filling ------------------------------------------------------------


def fill_3x3(
    df: DataFrame, grid: GridSpec, layer: Sequence[str] = (), passes: int = 2, value: str = "value",
    layers: int | None = None,
) -> DataFrame:
    """Missing cells become the mean of their valid neighbours, ``passes`` times.

    A pass reads only what the pass before left, never wraps at an edge and
    leaves a cell without valid neighbours missing. Cells may be missing as NULL
    or as absent rows; masks come afterwards, so that masked cells still count
    as neighbours.

    The table is shuffled once, by layer and square tile, with a rim of
    ``passes`` cells copied to the tiles next to it. All passes then aggregate
    inside that partitioning, and no tile holds more than (side + 2 passes)^2
    cells, whatever the layers look like. The number of tasks follows the cells of the
    grid and the number of ``layers`` (counted if not given), so a task's memory does
    not grow with the table.
    """
    layer = list(layer)
    if layers is None:
        layers = df.select(*layer).distinct().count() if layer else 1
    tasks = max(-(-grid.width * grid.height * layers // TASK_CELLS), df.sparkSession.sparkContext.defaultParallelism)
    passes = max(1, int(passes))
    side = max(TILE, passes)  # no rim reaches beyond the next tile

    def tiles(axis: str) -> Column:
        low = F.floor((F.col(axis) - passes) / side)
        high = F.floor((F.col(axis) + passes) / side)
        return F.sequence(low, high)

    tile = [*layer, "_tr", "_tc"]
    cells = (
        df.withColumns({"row": grid.row_of(F.col("pixel_id")), "col": grid.col_of(F.col("pixel_id"))})
        .filter(grid.holds(F.col("row"), F.col("col")))
        .select(*layer, "row", "col", F.col(value).alias("_v"))
        .withColumn("_tr", F.explode(tiles("row")))
        .withColumn("_tc", F.explode(tiles("col")))
        .repartition(tasks, *tile)
    )
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in steps])
    itself = F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc")))

    def in_tile(axis: str, tile_axis: str) -> Column:
        start = F.col(tile_axis) * side
        return F.col(axis).between(start - passes, start + side - 1 + passes)

    for _ in range(passes):
        own = (F.col("_s.dr") == 0) & (F.col("_s.dc") == 0)
        cells = (
            cells.withColumn("_s", F.explode(F.when(F.col("_v").isNull(), itself).otherwise(around)))
            .select(
                *tile,
                (F.col("row") + F.col("_s.dr")).alias("row"),
                (F.col("col") + F.col("_s.dc")).alias("col"),
                F.when(own, F.col("_v")).alias("_own"),
                F.when(~own, F.col("_v")).alias("_near"),
            )
            .filter(grid.holds(F.col("row"), F.col("col")) & in_tile("row", "_tr") & in_tile("col", "_tc"))
            .groupBy(*tile, "row", "col")
            .agg(F.coalesce(F.max("_own"), F.avg("_near")).alias("_v"))
        )
    home = (F.floor(F.col("row") / side) == F.col("_tr")) & (F.floor(F.col("col") / side) == F.col("_tc"))
    return cells.filter(home).select(
        *layer, grid.pixel(F.col("row"), F.col("col")).alias("pixel_id"), F.col("_v").alias(value)
    )


def is_filled(column: str) -> bool:
    """Fill policy: dynamic and other layers are filled, yields and fertilizers never."""
    return not (column.startswith("fert_") or column.startswith("yield_"))
