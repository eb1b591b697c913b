"""Column expressions for units, missing markers and vapour pressure."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.vocabulary import SENTINELS


def physical_units(dataset: Column, value: Column) -> Column:
    """Stored numbers to physical ones; layers without a rule keep their value."""
    return (
        F.when(dataset.isin("modis_ndvi", "modis_evi"), value * 0.0001)
        .when(dataset.isin("modis_lst_day", "modis_lst_night"), value * 0.02 - 273.15)
        .when(dataset == "era5_temp2m", value - 273.15)
        .otherwise(value)
    )


def convert_units(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, physical_units(F.col("dataset"), F.col(value)))


def saturation_pressure(celsius: Column) -> Column:
    """Tetens formula, kPa."""
    return F.lit(0.6108) * F.exp(celsius * 17.27 / (celsius + 237.3))


def vapour_pressure_deficit(t_kelvin: Column, td_kelvin: Column) -> Column:
    """Deficit in kPa from air and dew-point temperature; never negative, NULL stays NULL."""
    gap = saturation_pressure(t_kelvin - 273.15) - saturation_pressure(td_kelvin - 273.15)
    return F.when(gap < 0, F.lit(0.0)).otherwise(gap)


def _is_sentinel(column: Column, dtype: T.DataType) -> Column:
    # A float column holds float(1e20), which differs from the double 1e20.
    marks = [F.lit(s).cast(dtype) for s in SENTINELS]
    return F.isnan(column) | column.isin(*marks)


def null_sentinels(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Every no-data marker and NaN in floating columns becomes NULL."""
    wanted = set(df.columns if columns is None else columns)
    changed = {
        f.name: F.when(~_is_sentinel(F.col(f.name), f.dataType), F.col(f.name))
        for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(changed)
