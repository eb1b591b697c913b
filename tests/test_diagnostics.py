import math

import pytest
from pyspark.sql import functions as F

from agropanel.operators import diagnostics as Q

PANEL = "pixel_id long, year int, month int, modis_ndvi float, fert_n double, y double"


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(1, 2000, m, None if m < 4 else m / 10, 1.0, float(m)) for m in range(1, 13)]
    rows += [(1, 2001, m, 0.5, None, None) for m in range(1, 10)]
    rows += [(2, 2000, m, -9999.0 if m == 5 else 1e20, 2.0, 12.0) for m in (5, 6)]
    return spark.createDataFrame(rows, PANEL)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts(panel):
    assert rows(Q.q01_overview(panel)) == [(23, 2, 2, 2000, 2001)]
    assert rows(Q.q02_sequence_lengths(panel)) == [(2, 1, 3), (9, 1, 3), (12, 1, 3)]
    assert rows(Q.q03_year_coverage(panel)) == [(2000, 7.0, 1, 2, 0.5), (2001, 9.0, 0, 1, 0.0)]
    assert rows(Q.q05_month_counts(panel))[4] == (2000, 5, 2)
    assert rows(Q.q05_month_pivot(panel))[1] == (2001, *[1] * 9, 0, 0, 0)
    assert rows(Q.q11_first_key(panel)) == [(1, 2000)]
    assert rows(Q.q20_calendar(panel))[-2:] == [("year", 2000), ("year", 2001)]
    assert rows(Q.q01_overview(panel.filter("false"))) == [(0, 0, 0, None, None)]


def test_presence(panel):
    got = {r[0]: r[1:] for r in rows(Q.q06_month_presence(panel))}
    assert got[5] == (3, 3, 1.0) and got[12] == (1, 3, pytest.approx(1 / 3))
    copies = panel.union(panel)
    assert rows(Q.q06_month_presence(copies)) == rows(Q.q06_month_presence(panel))
    assert 12 not in {r[0] for r in rows(Q.q06_month_presence(panel.filter("month < 12")))}


def test_missing(panel):
    assert rows(Q.q07_missing(panel, ["modis_ndvi", "fert_n"])) == [("fert_n", 9 / 23), ("modis_ndvi", 3 / 23)]
    by_month = {(r[0], r[1]): r[2] for r in rows(Q.q09_missing_by_month(panel, ["modis_ndvi"]))}
    assert by_month[(1, "modis_ndvi")] == 0.5 and by_month[(5, "modis_ndvi")] == 0.0
    assert rows(Q.q18_missing_cells(panel)) == [(21, "fert_n", 9), (21, "y", 9), (21, "modis_ndvi", 3)]
    assert len(rows(Q.q18_missing_cells(panel, 1))) == 1
    plan = Q.q07_missing(panel.sparkSession.range(3).selectExpr("id a", "id b", "id c"), ["a", "b", "c"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_sentinels(panel):
    assert dict(rows(Q.q19_sentinels(panel))) == {"-9999": 1, "1e20": 1, "inf": 0, "-inf": 0}


def test_target(panel):
    row = Q.q10_target_stats(panel, "y").first()
    values = [*range(1, 13), 12, 12]
    mean = sum(values) / 14
    assert row["mean"] == pytest.approx(mean) and row["median"] == 7.5 and (row["min"], row["max"]) == (1.0, 12.0)
    assert row["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 14))


def test_histogram(panel):
    got = rows(Q.q15_histogram(panel, "y", 4))
    assert [r[4] for r in got] == [3, 3, 3, 5] and got[0][2] == 1.0 and got[3][3] == 12.0
    flat = rows(Q.q15_histogram(panel.filter("fert_n = 1"), "fert_n", 3))
    assert [r[4] for r in flat] == [12, 0, 0]
    assert sum(r[4] for r in rows(Q.q15_histogram(panel, "fert_n", 7))) == 14


def test_seasonality(panel):
    df = panel.withColumn("c", F.lit(3.0))
    got = rows(Q.q14_seasonality(df, ["c", "y"]))
    assert {r[3] for r in got if r[1] == "c"} == {0.0}
    z = [r[3] for r in got if r[1] == "y"]
    assert sum(z) == pytest.approx(0.0) and sum(v * v for v in z) / 12 == pytest.approx(1.0)


def test_summary_and_narrative(panel):
    row = Q.q13_crop_summary({"wheat": (panel, "y"), "maize": (panel.filter("month < 9"), "y")}).collect()
    assert row[0]["years"] == "2000–2001 (2 yrs)" and row[0]["full_sequence_fraction"] == pytest.approx(1 / 3)
    assert row[1]["full_sequence_fraction"] is None and row[1]["max_months"] == 8
    told = Q.q17_narrative(panel, ["modis_ndvi"]).first()
    assert told["short_sequences"] == 2 and told["mean_dynamic_missing"] == pytest.approx(3 / 23)
    with pytest.raises(ValueError):
        Q.q13_crop_summary({})


def test_example_columns_and_sample(panel):
    example = Q.q16_example_sequence(panel, "y", ["modis_ndvi"])
    assert example.columns == ["month", "modis_ndvi", "y", "fert_n"] and [r["month"] for r in example.collect()] == list(range(1, 13))
    assert rows(Q.q12_columns(panel))[3:] == [("modis_ndvi", False, 20), ("fert_n", True, 14), ("y", False, 14)]
    assert Q.q22_sample(panel, 5).count() == 5 and Q.q22_sample(panel, 500).count() == 23
    assert rows(Q.q22_sample(panel, 5)) == rows(Q.q22_sample(panel.repartition(7), 5))
    assert rows(Q.q22_sample(panel, 5, 1)) != rows(Q.q22_sample(panel, 5, 2))


def test_rows_per_pixel(panel):
    assert rows(Q.q21_rows_per_pixel(panel)) == [(2.0, 6.75, 11.5, 16.25, 21.0)]


def test_source_coverage(spark):
    yearly = spark.createDataFrame(
        [(1, 2000, 1.0, 1.0), (2, 2000, None, 1.0), (3, 2000, 1.0, None), (4, 2000, 1.0, 1.0), (1, 2001, 1.0, 1.0)],
        "pixel_id long, year int, y double, fert_n double")
    mask = spark.createDataFrame([(1, 1.0), (2, 1.0), (4, 0.2)], "pixel_id long, mask double")
    assert rows(Q.q04_source_coverage(yearly, "y", ["fert_n"], mask)) == [(2000, 3, 3, 2, 2, 1), (2001, 1, 1, 1, 1, 1)]
    assert len(rows(Q.q04_source_coverage(yearly, "y", ["fert_n"], mask, 2001))) == 1
    layers = spark.createDataFrame(
        [(1, 2000, 3, 0.5), (1, 2000, 3, None), (4, 2000, 3, 0.5), (1, 2000, 4, None), (9, 2000, 3, 1.0)],
        "pixel_id long, year int, month int, value double")
    assert rows(Q.q04_month_coverage(yearly, "y", ["fert_n"], mask, layers)) == [(2000, 3, 3, 1)]
    assert rows(Q.q04_month_coverage(yearly, "y", ["fert_n"], mask, layers, 2001, 3)) == []
