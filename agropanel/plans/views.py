"""Panel-shaped views over the supplied tables.

The modulo terms below only decide which *values* are missing, so that the
missing-data rules have something to work on; no row is left out by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agropanel.operators.grid import GridSpec
from agropanel.vocabulary import DYNAMIC_FEATURES

FERTS = ["fert_n", "fert_p"]
TARGET = "yield_wheat"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _year(column: str = "l_shipdate") -> Column:
    return F.year(column).cast("int").alias("year")


def _month(column: str = "l_shipdate") -> Column:
    return F.month(column).cast("int").alias("month")


def _hundredths(column: str) -> Column:
    """Amounts with two decimals as whole numbers: their sums are exact in any order."""
    return F.round(F.col(column) * 100).cast("long")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel x year x month panel: one scan, yearly values from the monthly partial sums.

    The window spans the months of one pixel-year, twelve rows at most.
    """
    qty, disc = F.col("l_quantity"), F.col("l_discount")
    returned = F.when(F.col("l_returnflag") == "R", qty)
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("pixel_id"), _year(), _month())
        .agg(
            F.sum(qty).alias("chirps_precip"),
            F.sum(_hundredths("l_discount")).alias("_disc"),
            F.min(disc).alias("modis_evi"),
            F.max(qty).alias("modis_lst_day"),
            F.min(qty).alias("modis_lst_night"),
            (F.max(disc) - F.min(disc)).alias("era5_vpd"),
            F.sum(_hundredths("l_extendedprice")).alias("_price"),
            F.sum(_hundredths("l_tax")).alias("_tax"),
            F.count(F.lit(1)).alias("_rows"),
            F.sum(returned).alias("_returned"),
            F.count(returned).alias("_returns"),
        )
        .withColumns(
            {
                "era5_temp2m": F.col("_disc") / F.col("_rows"),
                "era5_soil_moisture": F.col("_tax") / (F.col("_rows") * 100),
                "modis_ndvi": F.when(F.col("_rows") >= 3, F.col("_price") / (F.col("_rows") * 10_000_000)),
            }
        )
    )
    whole = Window.partitionBy("pixel_id", "year")
    year, pixel = F.col("year"), F.col("pixel_id")
    price = F.sum("_price").over(whole) / (F.sum("_rows").over(whole) * 100)
    applied = F.try_divide(F.sum("_returned").over(whole), F.sum("_returns").over(whole))
    return monthly.select(
        "pixel_id", "year", "month", *DYNAMIC_FEATURES,
        F.when((pixel * 7 + year) % 17 != 0, price).alias(TARGET),
        (F.sum("_tax").over(whole) / 100).alias("fert_n"),
        F.when((pixel + year) % 13 != 0, applied).alias("fert_p"),
    )


def panel_grid(spark: SparkSession, folder: str) -> GridSpec:
    """Ten columns; as many rows as the largest supplier key needs."""
    top = table(spark, folder, "supplier").agg(F.max("s_suppkey")).first()[0]
    return GridSpec(west=0.0, north=0.0, xres=1.0, yres=1.0, width=10, height=int(top) // 10 + 1)


def layers(spark: SparkSession, folder: str) -> DataFrame:
    """The dynamic part of the panel as one row per pixel, month and layer."""
    return panel(spark, folder).unpivot(
        ["pixel_id", "year", "month"], DYNAMIC_FEATURES, "dataset", "value"
    )


def yearly(spark: SparkSession, folder: str) -> DataFrame:
    """Yield and fertilizers, one row per pixel and year."""
    year, pixel = F.col("year"), F.col("pixel_id")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("pixel_id"), _year())
        .agg(
            (F.sum(_hundredths("l_extendedprice")) / (F.count(F.lit(1)) * 100)).alias("_y"),
            (F.sum(_hundredths("l_tax")) / 100).alias("fert_n"),
            F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("_p"),
        )
        .select(
            "pixel_id", "year",
            F.when((pixel * 7 + year) % 17 != 0, F.col("_y")).alias(TARGET),
            "fert_n",
            F.when((pixel + year) % 13 != 0, F.col("_p")).alias("fert_p"),
        )
    )


def mask(spark: SparkSession, folder: str) -> DataFrame:
    land = F.when(F.col("s_acctbal") >= 0, 1.0).otherwise(0.0)
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("pixel_id"), land.alias("mask"))


def water(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("pixel_id"), F.when(key % 9 != 0, ((key * 37) % 101).cast("double")).alias("occurrence")
    )


def static_attr(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("pixel_id"), F.col("s_nationkey").cast("double").alias("static_zone")
    )


def countries(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("pixel_id"), F.col("n_name").alias("country"))
    )


def obs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value")
    )


def obs_daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("cell"), "ts", "value")


def temps(spark: SparkSession, folder: str) -> DataFrame:
    qty = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.col("l_shipdate").alias("ts"),
        (F.lit(273.15) + qty).alias("t2m"),
        (F.lit(273.15) + qty * (1 - F.col("l_discount"))).alias("td2m"),
    )


def fine_cells(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        (key % 40).alias("col"),
        F.floor(key / 40).cast("long").alias("row"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("value"),
    )


def fine_grid(spark: SparkSession, folder: str) -> GridSpec:
    top = table(spark, folder, "part").agg(F.max("p_partkey")).first()[0]
    return GridSpec(west=0.0, north=0.0, xres=1.0, yres=1.0, width=40, height=int(top) // 40 + 1)


def coarse_grid(fine: GridSpec, step: float = 5.0) -> GridSpec:
    return GridSpec(
        west=fine.west, north=fine.north, xres=step, yres=step,
        width=int(-(-fine.width // step)), height=int(-(-fine.height // step)),
    )


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names as a fertilizer folder would list them, one per year of the data and one without a year."""
    years = table(spark, folder, "lineitem").select(_year()).distinct()
    dated = years.select(F.concat(F.lit("Wheat-N_app "), F.col("year").cast("string"), F.lit(".v2.tif")).alias("name"))
    undated = years.agg(F.concat(F.lit("wheat_zone"), F.when(F.count("year") > 0, ".tif")).alias("name"))
    return dated.unionByName(undated)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_returnflag").alias("dataset"), _year(), _month())
        .distinct()
    )


def preds(spark: SparkSession, folder: str) -> DataFrame:
    y = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        _year(), y.alias("y"), (y * (F.lit(0.75) + F.col("l_discount") * 5 + F.col("l_tax"))).alias("p")
    )
