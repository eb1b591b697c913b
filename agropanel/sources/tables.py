"""Panels, layer tables and file listings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.functions.climate import null_sentinels
from agropanel.vocabulary import DATASETS, DYNAMIC_FEATURES, target_column

LAYER_SCHEMA = "pixel_id BIGINT, value FLOAT, dataset STRING, year INT, month INT"


def panel_schema(crop: str, ferts: Iterable[str] = (), static: Iterable[str] = ()) -> T.StructType:
    """Declared schema of a panel; columns that a source lacks are NULL."""
    fields = [
        T.StructField("pixel_id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.ShortType()),
    ]
    values = [*DYNAMIC_FEATURES, target_column(crop), *ferts, *static]
    return T.StructType(fields + [T.StructField(c, T.FloatType()) for c in values])


def panel_path(paths: Mapping[str, str], crop: str, explicit: str | None = None) -> str:
    """An explicit path wins over the one configured for the crop."""
    if explicit:
        return explicit
    if crop not in paths:
        raise FileNotFoundError(f"no panel path for crop {crop!r}")
    return paths[crop]


def read_panel(spark: SparkSession, path: str, markers_done: bool = False) -> DataFrame:
    """A panel with NaN and no-data markers as NULL. A path that does not exist raises.

    ``markers_done`` leaves the columns untouched, so that value filters reach
    the scan; use it for panels written by ``write_panel``.
    """
    panel = spark.read.parquet(path)
    return panel if markers_done else null_sentinels(panel)


def register_panel(panel: DataFrame, name: str = "panel") -> None:
    """Make a panel available to ``spark.sql``."""
    panel.createOrReplaceTempView(name)


def chosen_datasets(listed: str | Iterable[str] | None) -> list[str]:
    """Dataset keys from a comma-separated list; nothing listed means all of them."""
    if listed is None:
        return list(DATASETS)
    names = listed.split(",") if isinstance(listed, str) else list(listed)
    return [n.strip() for n in names if n.strip()] or list(DATASETS)


def read_layers(
    spark: SparkSession,
    root: str,
    start_year: int,
    end_year: int,
    datasets: str | Iterable[str] | None = None,
    schema: str = LAYER_SCHEMA,
) -> DataFrame:
    """Monthly layers from a table partitioned by dataset, year and month; other partitions are not opened."""
    layers = spark.read.schema(schema).parquet(root)
    wanted = F.col("dataset").isin(*chosen_datasets(datasets))
    return layers.filter(wanted & F.col("year").between(start_year, end_year))


def list_sources(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Names and paths of all files below ``root``; hidden and temporary files are passed over.

    Only the listing is read, never the content.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path")
    )
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order and types; missing ones are NULL."""
    def column(f: T.StructField) -> Column:
        return (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])
