"""Names and settings that the data model fixes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dataset:
    """One monthly layer: how its observations become one value per cell and month."""

    key: str
    band: str
    agg: str


# The eight dynamic layers, their band and their monthly reduction.
DATASETS = {
    "chirps_precip": Dataset("chirps_precip", "precipitation", "sum"),
    "era5_temp2m": Dataset("era5_temp2m", "temperature_2m", "mean"),
    "era5_soil_moisture": Dataset("era5_soil_moisture", "volumetric_soil_water_layer_1", "mean"),
    "modis_ndvi": Dataset("modis_ndvi", "NDVI", "mean"),
    "modis_evi": Dataset("modis_evi", "EVI", "mean"),
    "modis_lst_day": Dataset("modis_lst_day", "LST_Day_1km", "mean"),
    "modis_lst_night": Dataset("modis_lst_night", "LST_Night_1km", "mean"),
    "era5_vpd": Dataset("era5_vpd", "", "vpd"),
}

# The order of the dynamic features inside a feature vector.
DYNAMIC_FEATURES = [
    "chirps_precip",
    "era5_temp2m",
    "era5_soil_moisture",
    "modis_ndvi",
    "modis_evi",
    "modis_lst_day",
    "modis_lst_night",
    "era5_vpd",
]

# Which columns repeat within a year, which never change, which crops exist.
YEARLY_REGEX = "^fert_.*"
STATIC_REGEX = "^static_.*"
CROPS = ("wheat", "maize")

# Numbers that stand for "no data" in the sources.
SENTINELS = (-9999.0, 1e20, float("inf"), float("-inf"))

# Named feature sets as (dynamic columns, yearly pattern).
FEATURE_SETS = {
    "all": (DYNAMIC_FEATURES, YEARLY_REGEX),
    "weather_only": (["chirps_precip", "era5_temp2m", "era5_soil_moisture", "era5_vpd"], ""),
    "veg_lst_only": (["modis_ndvi", "modis_evi", "modis_lst_day", "modis_lst_night"], ""),
    "no_fertilizer": (DYNAMIC_FEATURES, ""),
    "fertilizer_only": ([], YEARLY_REGEX),
}

PIXEL_YEAR = ["pixel_id", "year"]
PANEL_KEYS = ["pixel_id", "year", "month"]


def target_column(crop: str) -> str:
    """Name of the yield column; other crops than the known ones are refused."""
    crop = crop.strip().lower()
    if crop not in CROPS:
        raise ValueError(f"crop must be one of {', '.join(CROPS)}, not {crop!r}")
    return f"yield_{crop}"
