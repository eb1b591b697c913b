"""The command line, end to end over the supplied tables re-shaped as files."""

import pytest
from pyspark.sql import functions as F

from agropanel.__main__ import main, parser
from agropanel.operators.grid import GridSpec
from agropanel.plans import views as V
from agropanel.plans.layer_export import monthly_layers


def test_layers_build_train_suggest(spark, data, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    obs = V.layers(spark, data).select(
        "dataset", (F.col("pixel_id") % 10 + 0.5).alias("lon"), (-F.floor(F.col("pixel_id") / 10) - 0.5).alias("lat"),
        F.make_timestamp("year", "month", F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), "value",
    )
    dew = obs.filter("dataset = 'era5_temp2m'").withColumns({"dataset": F.lit("era5_dewpoint2m"), "value": F.col("value") - 1})
    obs.unionByName(dew).write.parquet(at("obs"))
    V.yearly(spark, data).select("pixel_id", "year", "yield_wheat").write.parquet(at("yields"))
    V.yearly(spark, data).select("pixel_id", "year", "fert_n", "fert_p").write.parquet(at("ferts"))
    V.water(spark, data).write.parquet(at("water"))
    years = ["--start_year", "1995", "--end_year", "2001"]
    grid = ["--grid", "0,0,1,1,10,1"]

    main(["layers", "--obs", at("obs"), "--out", at("layers"), *years, *grid])
    main(["mask", "--water", at("water"), "--out", at("mask")])
    main(["build", "--layers", at("layers"), "--yields", at("yields"), "--fertilizers", at("ferts"), "--mask", at("mask"),
          "--crop", "wheat", "--out", at("panel"), *years, *grid])
    assert "rows in" in capsys.readouterr().out
    panel = spark.read.parquet(at("panel"))
    assert panel.filter("yield_wheat IS NULL OR fert_n IS NULL OR fert_p IS NULL").isEmpty() and panel.count() > 100

    main(["diagnose", "--panel", at("panel"), "--crop", "wheat"])
    assert "full_sequence_fraction" in capsys.readouterr().out
    split = ["--train_max_year", "1998", "--val_year", "1999", "--test_year_min", "2000"]
    model = ["--crop", "wheat", "--panel", at("panel"), "--model", "linear", "--params", '{"alpha": 10}', *split]
    main(["train", "--out", at("run"), *model])
    main(["scores", "--runs", at("run"), "--metric", "rmse"])
    assert "metric=rmse  n=1" in capsys.readouterr().out
    main(["suggest", "--trained", at("run/model_wheat_linear"), "--out", at("recs"), *model])
    recs = spark.read.option("header", True).csv(at("recs"))
    assert recs.columns == ["pixel_id", "year", "pred_base", "pred_opt", "fert_n", "fert_p"]
    assert {r[0] for r in recs.select("year").distinct().collect()} == {"2000"}


def test_finished_layers_are_skipped(spark):
    obs = spark.sql("""SELECT 'modis_evi' AS dataset, x + 0.5D AS lon, -0.5D AS lat, make_timestamp(2000, m, 1, 0, 0, 0) AS ts,
        double(x + m) AS value FROM VALUES (0), (1) AS a(x), VALUES (1), (2) AS b(m)""")
    grid = GridSpec(0, 0, 1, 1, 2, 1)
    done = spark.sql("SELECT 'modis_evi' AS dataset, 2000 AS year, 1 AS month")
    got = monthly_layers(obs, grid, 2000, 2000, "modis_evi", done)
    assert sorted((r["month"], r["pixel_id"], r["value"]) for r in got.collect()) == [(2, 0, 2.0), (2, 1, 3.0)]
    assert monthly_layers(obs, grid, 2000, 2000, "modis_evi", done, overwrite=True).count() == 4
    with pytest.raises(ValueError):
        monthly_layers(obs, grid, 2000, 2000, "modis_ndvi")


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["train", "--crop", "wheat"])
