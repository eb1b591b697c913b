"""Compositing, units, assembly, cleaning, annual tables and normalisation."""

import datetime as dt
import math
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agropanel.functions.climate import convert_units, null_sentinels
from agropanel.functions.targets import exp_target, log_target
from agropanel.operators import annual as A
from agropanel.operators import assemble as J
from agropanel.operators import clean as C
from agropanel.operators import composite as M
from agropanel.operators import normalise as N
from agropanel.operators.grid import GridSpec
from agropanel.plans.panel_build import build_panel, static_features, yearly_features
from agropanel.vocabulary import DATASETS

PIXEL = "pixel_id long, year int, month int"


def test_month_edges(frame):
    ts = [dt.datetime(2000, 1, 31, 23, 59, 59), dt.datetime(2000, 2, 1), dt.datetime(2000, 2, 29, 12)]
    df = frame([(1, t, float(i + 1)) for i, t in enumerate(ts)], "cell long, ts timestamp_ntz, value double")
    got = {(r["year"], r["month"]): r["value"] for r in M.composite(df, ["cell"], "sum").collect()}
    assert got == {(2000, 1): 1.0, (2000, 2): 5.0}
    bounds = M.month_bounds(frame([(2000, 2), (2001, 12)], "year int, month int")).collect()
    assert [(r["month_start"], r["month_end"]) for r in bounds] == [
        (dt.date(2000, 2, 1), dt.date(2000, 3, 1)), (dt.date(2001, 12, 1), dt.date(2002, 1, 1))]


@pytest.mark.parametrize("agg, want", [("sum", 16.0), ("mean", 4.0), ("median", 3.0), ("odd name", 4.0)])
def test_composite(frame, agg, want):
    values = [1.0, 2.0, 4.0, 9.0, None]
    df = frame([(1, dt.datetime(2000, 5, 1 + i), v) for i, v in enumerate(values)], "cell long, ts timestamp_ntz, value double")
    assert [r["value"] for r in M.composite(df, ["cell"], agg).collect()] == [want]


def test_composite_datasets_uses_the_reduction_of_each(frame):
    rows = [(d, 1, dt.datetime(2000, 1, i), float(i)) for d in ("chirps_precip", "modis_evi", "other", "mid", "odd") for i in (1, 3, 8)]
    df = frame(rows, "dataset string, cell long, ts timestamp_ntz, value double")
    got = {r["dataset"]: r["value"] for r in M.composite_datasets(df, ["cell"]).collect()}
    assert got == {"chirps_precip": 12.0, "modis_evi": 4.0}
    kinds = {"mid": "median", "odd": "some other name"}
    listed = {k: replace(next(iter(DATASETS.values())), agg=a) for k, a in kinds.items()}
    got = {r["dataset"]: r["value"] for r in M.composite_datasets(df, ["cell"], listed).collect()}
    assert got == {"mid": 3.0, "odd": 4.0}


def test_vpd(frame):
    day = dt.datetime(2000, 1, 1)
    rows = [(1, day, 300.0, 290.0), (1, day, 302.0, 292.0), (2, day, 290.0, 295.0), (3, day, None, 290.0)]
    df = frame(rows, "cell long, ts timestamp_ntz, t2m double, td2m double")
    es = lambda k: 0.6108 * math.exp(17.27 * (k - 273.15) / (k - 273.15 + 237.3))
    got = {r["cell"]: r["vpd"] for r in M.vpd(df, ["cell"]).collect()}
    assert got[1] == pytest.approx(es(301) - es(291)) and got[2] == 0.0 and got[3] is None


def test_units(frame):
    rows = [("modis_ndvi", 5000.0), ("modis_lst_day", 15000.0), ("era5_temp2m", 300.0), ("chirps_precip", 7.0), ("modis_evi", None)]
    got = {r["dataset"]: r["value"] for r in convert_units(frame(rows, "dataset string, value double")).collect()}
    assert got["modis_ndvi"] == pytest.approx(0.5) and got["modis_lst_day"] == pytest.approx(26.85)
    assert got["era5_temp2m"] == pytest.approx(26.85) and got["chirps_precip"] == 7.0 and got["modis_evi"] is None


@pytest.mark.parametrize("kind", ["float", "double"])
def test_sentinels(frame, kind):
    rows = [(1, x) for x in (-9999.0, 1e20, math.inf, -math.inf, math.nan, 5.0, None)]
    got = [r["v"] for r in null_sentinels(frame(rows, f"k int, v {kind}")).collect()]
    assert got == [None] * 5 + [5.0, None]


def test_widen_and_spine(frame):
    layers = frame(
        [("modis_ndvi", 1, 2000, 1, 0.5), ("modis_evi", 1, 2000, 1, 0.25), ("modis_evi", 2, 2000, 3, 1.0), ("junk", 1, 2000, 5, 0.0)],
        f"dataset string, {PIXEL}, value double",
    )
    wide = {tuple(r)[:3]: (r["modis_ndvi"], r["modis_evi"]) for r in J.widen(layers).collect()}
    assert wide == {(1, 2000, 1): (0.5, 0.25), (2, 2000, 3): (None, 1.0)}
    pixels = frame([(1,), (2,), (7,)], "pixel_id long")
    assert J.panel_spine(pixels, layers).count() == 9


def test_rule_a(frame):
    rows = [(1, 2000, 1, None, 1.0, 1.0, 1.0), (2, 2000, 1, 1.0, None, 1.0, 1.0), (3, 2000, 1, 1.0, 1.0, 1.0, 1.0), (4, 2000, 1, 1.0, 1.0, 1.0, None)]
    df = frame(rows, f"{PIXEL}, yield_wheat double, fert_n double, fert_p double, modis_ndvi double")
    assert [r["pixel_id"] for r in J.rule_a(df, "yield_wheat").orderBy("pixel_id").collect()] == [3, 4]
    assert tuple(J.rule_a_report(df, "yield_wheat").first()) == (2000, 1, 4, 2, 1)


def test_joins(frame):
    panel = frame([(1, 2000, 1), (1, 2001, 1), (2, 2000, 1)], PIXEL)
    yearly = frame([(1, 2000, 5.0)], "pixel_id long, year int, yield_wheat double")
    assert [r["yield_wheat"] for r in J.with_yearly(panel, yearly).orderBy("pixel_id", "year").collect()] == [5.0, None, None]
    keys = frame([(1, 2000), (1, 2000)], "pixel_id long, year int")
    assert J.keep_keys(panel, keys).count() == 1
    assert J.history_window(panel, 2001, 2).count() == 3 and J.history_window(panel, 2001).count() == 1


@pytest.fixture
def small_build(frame):
    layers = frame(
        [("era5_temp2m", p, 2000, m, 273.15 + p) for p in range(4) for m in (1, 2)]
        + [("modis_ndvi", 0, 2000, 1, 10000.0), ("modis_ndvi", 3, 2000, 1, -9999.0)],
        f"dataset string, {PIXEL}, value double",
    )
    yields = frame([(p, y, 1.0 + p) for p in range(4) for y in (2000, 2001)] , "pixel_id long, year int, yield_wheat double")
    ferts = frame([(p, 2000, None if p == 2 else 3.0) for p in range(4)], "pixel_id long, year int, fert_n double")
    return layers, yields, ferts


def test_build_panel(frame, small_build):
    layers, yields, ferts = small_build
    mask = frame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 1.0)], "pixel_id long, mask double")
    static = frame([(1, 7.0)], "pixel_id long, static_zone double")
    out = build_panel(layers, yields, ferts, GridSpec(0, 0, 1, 1, 2, 2), "wheat", mask, static)
    rows = {(r["pixel_id"], r["year"], r["month"]): r for r in out.collect()}
    # Pixel 0 is water, pixel 2 lacks fertilizer, 2001 has neither fertilizer nor layers.
    assert set(rows) == {(p, 2000, m) for p in (1, 3) for m in (1, 2)}
    first = rows[(1, 2000, 1)]
    assert first["era5_temp2m"] == pytest.approx(1.0) and first["static_zone"] == 7.0
    # The vegetation gap is filled from the masked-out neighbour, the marker is gone before.
    assert first["modis_ndvi"] == pytest.approx(1.0) and rows[(3, 2000, 1)]["modis_ndvi"] == pytest.approx(1.0)
    assert rows[(3, 2000, 2)]["modis_ndvi"] is None and rows[(3, 2000, 2)]["static_zone"] is None


def test_build_panel_equals_the_month_by_month_order(frame, small_build):
    """Dropping incomplete pixel-years first gives what dropping monthly rows gives."""
    layers, yields, ferts = small_build
    grid = GridSpec(0, 0, 1, 1, 2, 2)
    out = build_panel(layers, yields, ferts, grid, "wheat")
    from agropanel.plans.panel_build import prepared_layers
    pixels = frame([(p,) for p in range(4)], "pixel_id long")
    slow = J.panel_spine(pixels, layers).join(J.widen(prepared_layers(layers, grid)), ["pixel_id", "year", "month"], "left")
    slow = J.rule_a(J.with_yearly(J.with_yearly(slow, yields), ferts), "yield_wheat").select(*out.columns)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)


def test_yearly_features(frame):
    src = frame([(1, 2000, "fert_a", 1.0), (1, 2000, "fert_b", -9999.0)], "pixel_id long, year int, feature string, value double")
    assert tuple(yearly_features(src, ["fert_a", "fert_b", "fert_c"]).first()) == (1, 2000, 1.0, None, None)


def test_static_features_follow_the_fill_policy(frame):
    rows = [("fert_s", 0, 1.0), ("fert_s", 1, -9999.0), ("static_s", 0, 4.0), ("static_s", 1, None)]
    src = frame(rows, "feature string, pixel_id long, value double")
    got = static_features(src, ["fert_s", "static_s"], GridSpec(0, 0, 1, 1, 2, 1)).orderBy("pixel_id").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 4.0), (1, None, 4.0)]


def test_roles():
    cols = ["pixel_id", "fert_n", "static_a", "modis_ndvi", "era5_vpd", "x_fert_"]
    roles = C.select_columns(cols)
    assert roles == C.Roles(["modis_ndvi", "era5_vpd"], ["fert_n"], ["static_a"])
    assert C.select_columns(cols, [], "", "").yearly == []
    assert C.feature_set("veg_lst_only", cols) == C.Roles(["modis_ndvi"], [], ["static_a"])
    assert C.feature_set("fertilizer_only", cols).dynamic == []
    with pytest.raises(ValueError):
        C.feature_set("none", cols)


def test_clean(frame):
    rows = [(1, None, 1.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 5.0, None, None), (4, 5.0, -1.0, 1.0), (5, 5.0, None, 2.0), (6, 4.0, 1.0, 0.0)]
    df = frame(rows, "pixel_id int, y double, fert_a double, fert_b double")
    ids = lambda d: sorted(r[0] for r in d.select("pixel_id").collect())
    assert ids(C.clean(df, "y")) == [2, 3, 4, 5, 6]
    assert ids(C.clean(df, "y", drop_missing=False)) == [1, 2, 3, 4, 5, 6]
    assert ids(C.clean(df, "y", min_yield=4)) == [3, 4, 5]
    assert ids(C.clean(df, "y", ["fert_a", "fert_b"], min_yield=1e-6, any_fertilizer=True)) == [5, 6]
    assert tuple(C.clean_report(df, "y", min_yield=4).first()) == (6, 3)
    for wrong in ("much", -1.0):
        with pytest.raises(ValueError):
            C.clean(df, "y", min_yield=wrong)


def yearly_table(frame, **kw):
    rows = [(1, y, m, float(m), float(y), float(y - 1990), 2.0) for y in (2000, 2001, 2003) for m in range(1, 13)]
    df = frame(rows, f"{PIXEL}, chirps_precip double, modis_ndvi double, yield_wheat double, fert_n double")
    return A.aggregate_yearly(df, ["chirps_precip", "modis_ndvi"], ["fert_n"], "yield_wheat", **kw).orderBy("year").collect()


def test_annual(frame):
    first = yearly_table(frame, extra_stats=["std", "min", "max"])[0]
    assert first["chirps_precip"] == 6.5 and first["chirps_precip_q1"] == 2.0 and first["chirps_precip_q4"] == 11.0
    assert first["chirps_precip_std"] == pytest.approx(math.sqrt(143 / 12)) and first["chirps_precip_max"] == 12.0
    assert first["yield_wheat"] == 10.0 and first["fert_n"] == 2.0
    assert yearly_table(frame, aggregate_to_year="mean_sum")[0]["chirps_precip"] == 78.0
    assert yearly_table(frame, aggregate_to_year="mean_sum", sum_keywords=[], sum_features=["modis_ndvi"])[0]["modis_ndvi"] == 24000.0
    with pytest.raises(ValueError):
        yearly_table(frame, aggregate_to_year="median")
    with pytest.raises(ValueError):
        yearly_table(frame, extra_stats=["mode"])


def test_earlier_years_do_not_cross_gaps(frame):
    rows = yearly_table(frame, lag_years=2)
    assert [r["prev_yield_wheat"] for r in rows] == [None, 10.0, None]
    assert [r["modis_ndvi_lag1"] for r in rows] == [None, 2000.0, None]
    assert [r["modis_ndvi_lag2"] for r in rows] == [None, None, 2001.0]


def test_derived_columns(frame):
    df = frame([(2.0, -3.0, 4.0, None)], "fert_a double, fert_b double, chirps_precip double, fert_c double")
    row = A.derive_features(df, True, ["fert_", "chirps"]).first()
    assert row["fert_a"] == pytest.approx(math.log(3)) and row["fert_b"] == 0.0 and row["fert_c"] is None
    assert row["fert_a_x_fert_b"] == 0.0 and row["chirps_precip"] == pytest.approx(math.log(5))
    assert A.derive_features(df, True).first()["fert_a_x_fert_b"] == -6.0
    names = A.model_features(["pixel_id", "year", "y", "fert_a", "fert_b"], "y", {"add_fertilizer_interactions": True})
    assert names == ["fert_a", "fert_b", "fert_a_x_fert_b"]
    vector = df.select(A.feature_vector(df.columns, ["fert_c", "fert_a"], {}).alias("v")).first()["v"]
    assert list(vector) == [0.0, 2.0]
    with pytest.raises(ValueError):
        A.feature_columns(["pixel_id", "year", "y"], "y")


def test_annual_shuffles_by_pixel_year_then_pixel(data, spark):
    from agropanel.plans import views
    df = spark.createDataFrame([], f"{PIXEL}, a double, y double")
    plan = A.aggregate_yearly(df, ["a"], [], "y", lag_years=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert views.panel(spark, data)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_zscore(frame):
    train = frame([(1, 1.0, 5.0), (1, 3.0, 5.0), (2, 10.0, 5.0), (2, None, 5.0)], "month int, a double, c double")
    df = frame([(1, 100.0, 7.0), (2, None, 7.0), (2, 10.0, 5.0)], "month int, a double, c double")
    got = [tuple(r) for r in N.normalise(df, train, ["a", "c"], clip_std=2.0).collect()]
    assert got[0][:2] == (1, 2.0) and got[0][2] == 0.0 and got[1][1] is None
    months = [tuple(r) for r in N.normalise(df, train, ["a"], "zscore_by_month", clip_std=None).collect()]
    assert (1, 98.0, 7.0) in months and (2, 0.0, 5.0) in months and (2, None, 7.0) in months
    assert N.normalise(df, train, ["a"], "none") is df
    with pytest.raises(ValueError):
        N.normalise(df, train, ["a"], "minmax")


def test_log_target(frame):
    df = frame([(-5.0,), (0.0,), (None,)], "y double")
    rows = df.select(log_target(F.col("y")).alias("z"), exp_target(log_target(F.col("y"))).alias("b")).collect()
    assert rows[0]["z"] == pytest.approx(math.log(1e-6)) and rows[0]["b"] == 0.0
    assert rows[1]["z"] == 0.0 and rows[2]["z"] is None and rows[2]["b"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=20))
def test_log_target_round_trip(spark, ys):
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    back = [r[0] for r in df.select(exp_target(log_target(F.col("y")))).collect()]
    assert back == pytest.approx(ys, rel=1e-9, abs=1e-9)
