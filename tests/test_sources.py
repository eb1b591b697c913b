import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.operators.metrics import METRIC_NAMES, metrics, metrics_by_year
from agropanel.sources.inventory import month_spine, pending, source_inventory
from agropanel.sources.names import for_crop, parse_names, pick_source, split_yearly_static
from agropanel.sources.sinks import (
    aggregate_runs, collect_runs, metrics_document, write_csv, write_layers, write_metrics, write_panel,
)
from agropanel.sources.tables import (
    chosen_datasets, conform, list_sources, panel_path, panel_schema, read_layers, read_panel, register_panel,
)
from agropanel.vocabulary import DATASETS, target_column


@pytest.fixture
def names(spark):
    listed = ["Wheat-N_2010 v2.tif", "wheat_zone.tif", "Maize P 1999.tif", "__2003__soil.v1.tif"]
    return spark.createDataFrame([(n,) for n in listed], "name string")


def test_parse_names(names):
    got = {r["name"]: (r["feature"], r["year"]) for r in parse_names(names).collect()}
    assert got == {
        "Wheat-N_2010 v2.tif": ("fert_wheat_n_v2", 2010),
        "wheat_zone.tif": ("fert_wheat_zone", None),
        "Maize P 1999.tif": ("fert_maize_p", 1999),
        "__2003__soil.v1.tif": ("fert_soil_v1", 2003),
    }


def test_yearly_and_static_groups(names):
    yearly, static = split_yearly_static(names, "Wheat")
    assert [r["feature"] for r in yearly.collect()] == ["fert_wheat_n_v2"]
    assert [r["feature"] for r in static.collect()] == ["fert_wheat_zone"]
    assert for_crop(names, None).count() == 4


def test_pick_source(spark, names):
    assert pick_source(names, "MAIZE") == "Maize P 1999.tif"
    assert pick_source(names, "barley") == "Maize P 1999.tif"
    with pytest.raises(FileNotFoundError):
        pick_source(names.filter("false"), "wheat")


def test_list_sources_skips_hidden_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.tif", "y.tif", ".nfs0001.tif", "a/._x.tif", "z.txt"):
        (tmp_path / name).write_text("0")
    assert sorted(r["name"] for r in list_sources(spark, str(tmp_path), "*.tif*").collect()) == ["x.tif", "y.tif"]


def test_inventory_and_pending(spark):
    have = spark.createDataFrame([("a", 2000, 1), ("a", 2000, 1), ("a", 2001, 5)], "dataset string, year int, month int")
    got = {r["dataset"]: tuple(r)[1:] for r in source_inventory(have, ["a", "b"], 2000, 2001).collect()}
    assert got == {"a": (24, 2, 22), "b": (24, 0, 24)}
    spine = month_spine(spark, ["a", "b"], 2000, 2001)
    assert pending(spine, have).count() == 46 and pending(spine, have, overwrite=True).count() == 48


def test_chosen_datasets():
    assert chosen_datasets(" modis_ndvi, ,era5_vpd") == ["modis_ndvi", "era5_vpd"]
    assert chosen_datasets("") == chosen_datasets(None) == list(DATASETS)


def test_panel_paths_and_crops():
    assert panel_path({"wheat": "w"}, "wheat") == "w"
    assert panel_path({"wheat": "w"}, "wheat", "x") == "x"
    with pytest.raises(FileNotFoundError):
        panel_path({}, "wheat")
    with pytest.raises(ValueError):
        target_column("rice")


def test_read_panel(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT 1L pixel_id, 2000 year, float(-9999) chirps_precip, float('NaN') modis_ndvi, 2D fert_n").write.parquet(path)
    row = read_panel(spark, path).first()
    assert row["chirps_precip"] is None and row["modis_ndvi"] is None and row["fert_n"] == 2.0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_panel(spark, str(tmp_path / "none"))
    register_panel(read_panel(spark, path), "p_view")
    assert spark.sql("SELECT count(*) FROM p_view").first()[0] == 1


def test_conform(spark):
    schema = panel_schema("wheat", ["fert_n"])
    df = conform(spark.sql("SELECT 3 AS month, 1 AS pixel_id, 2000L AS year, 1.5D AS fert_n, 'x' AS other"), schema)
    assert df.schema.fieldNames() == schema.fieldNames()
    assert [f.dataType for f in df.schema.fields] == [f.dataType for f in schema.fields]
    row = df.first()
    assert row["fert_n"] == 1.5 and row["yield_wheat"] is None and isinstance(df.schema["month"].dataType, T.ShortType)


def test_write_panel(spark, tmp_path):
    df = spark.sql("SELECT id AS pixel_id, int(2000 + id % 3) AS year, smallint(1) AS month, float(id) AS v FROM range(30)")
    path = str(tmp_path / "panel")
    assert write_panel(df, path) == 30
    assert {p.name for p in Path(path).glob("year=*")} == {"year=2000", "year=2001", "year=2002"}
    assert all(".snappy.parquet" in p.name for p in Path(path).rglob("*.parquet"))
    pruned = spark.read.parquet(path).filter("year = 2001")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        write_panel(df.filter("v < 0"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        write_panel(df.filter("v < 0"), path)
    with pytest.raises(Exception, match="no such yield"):
        write_panel(df.withColumn("v", F.expr("float(raise_error('no such yield'))")), path)
    assert spark.read.parquet(path).count() == 30  # neither touched the panel
    assert write_panel(df.filter("v < 5"), path) == 5 and spark.read.parquet(path).count() == 5
    assert write_panel(df.filter("v < 2"), path, "append") == 2 and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["panel"]


def test_layers_are_pruned_by_partition(spark, tmp_path):
    root = str(tmp_path / "layers")
    df = spark.sql("""SELECT id AS pixel_id, float(id) AS value, d AS dataset, y AS year, m AS month FROM range(5)
        LATERAL VIEW explode(array('modis_ndvi', 'era5_vpd')) AS d LATERAL VIEW explode(array(2000, 2001)) AS y
        LATERAL VIEW explode(array(1, 2)) AS m""")
    write_layers(df, root)
    got = read_layers(spark, root, 2001, 2002, "modis_ndvi")
    assert got.count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: []" in plan and "year" in plan.split("PartitionFilters")[1][:400]


def test_metrics_documents(spark, tmp_path):
    preds = spark.createDataFrame([(2000, 1.0, 1.1), (2000, 2.0, 2.5), (2001, 3.0, 3.0), (2001, 4.0, 1.0)], "year int, y double, p double")
    parts = metrics(preds.withColumn("split", F.when(F.col("year") == 2000, "train").otherwise("val")), "y", "p", ["split"])
    doc = metrics_document(metrics(preds, "y", "p"), metrics_by_year(preds, "y", "p"), parts, crop="wheat")
    write_metrics(doc, str(tmp_path / "a" / "metrics_wheat_x.json"))
    text = next((tmp_path / "a" / "metrics_wheat_x.json").glob("part-*")).read_text()
    got = json.loads(text)
    assert list(got["overall"]) == METRIC_NAMES and set(got["per_year"]) == {"2000", "2001"}
    assert got["overall"]["n"] == 4 and got["crop"] == "wheat"
    assert got["train_metrics"] == got["per_year"]["2000"] and got["val_metrics"] == got["per_year"]["2001"]

    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "b" / "c" / "metrics_plain.json").write_text(json.dumps({"overall": {"acc@20%": 10.0}}, indent=2))
    (tmp_path / "b" / "metrics_broken.json").write_text("{ no json")
    (tmp_path / "b" / "metrics_other.json").write_text(json.dumps({"overall": {"rmse": 1.0}}))
    (tmp_path / "b" / "notes.json").write_text(json.dumps({"overall": {"acc@20%": 99.0}}))
    runs = sorted(r["value"] for r in collect_runs(spark, str(tmp_path)).collect())
    assert runs == [10.0, 50.0]
    assert aggregate_runs(spark, str(tmp_path)) == {"metric": "acc@20%", "n": 2, "mean": 30.0}
    with pytest.raises(ValueError):
        aggregate_runs(spark, str(tmp_path), "nothing")


def test_write_csv(spark, tmp_path):
    write_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id"]
