"""Feature and year from the name of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a year in a name, and what is not kept of a name.
YEAR_PATTERN = r"(19|20)\d{2}"
OTHER_CHARACTERS = "[^A-Za-z0-9]+"


def _sanitised(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    words = F.regexp_replace(F.regexp_replace(stem, YEAR_PATTERN, ""), OTHER_CHARACTERS, "_")
    return F.lower(F.btrim(words, F.lit("_")))


def parse_source_name(name: Column, prefix: str = "fert") -> Column:
    """Struct of ``feature`` (prefix and sanitised name) and ``year`` (NULL without one)."""
    year = F.regexp_extract(name, YEAR_PATTERN, 0)
    return F.struct(
        F.concat_ws("_", F.lit(prefix), _sanitised(name)).alias("feature"),
        F.when(year != "", year.cast("int")).alias("year"),
    )


def parse_names(df: DataFrame, name: str = "name", prefix: str = "fert") -> DataFrame:
    return df.withColumn("_p", parse_source_name(F.col(name), prefix)).select("*", "_p.*").drop("_p")


def for_crop(df: DataFrame, crop: str | None, name: str = "name") -> DataFrame:
    """Sources whose sanitised name mentions the crop; all of them without a crop."""
    return df.filter(_sanitised(F.col(name)).contains(crop.lower())) if crop else df


def split_yearly_static(
    df: DataFrame, crop: str | None, name: str = "name", prefix: str = "fert"
) -> tuple[DataFrame, DataFrame]:
    """Sources of a crop with a year in their name, and those without."""
    parsed = parse_names(for_crop(df, crop, name), name, prefix)
    return parsed.filter(F.col("year").isNotNull()), parsed.filter(F.col("year").isNull()).drop("year")


def pick_source(df: DataFrame, crop: str, name: str = "name") -> str:
    """The first name in order that mentions the crop, else the first of all; none is an error."""
    fits = F.lower(F.col(name)).contains(crop.lower())
    row = df.select(name).orderBy(F.desc(fits), name).first()
    if row is None:
        raise FileNotFoundError(f"no source for crop {crop!r}")
    return row[0]
