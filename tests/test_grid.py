import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agropanel.operators.grid import (
    GridSpec, apply_mask, clip_aoi, clip_box, fill_3x3, grid_spec, is_filled, kept_pixels, land_mask, regrid,
    with_pixel_id, yield_by_year,
)

NONE = None


def brute_fill(a, passes):
    a = np.array(a, dtype=float)
    for _ in range(passes):
        padded = np.pad(a, 1, constant_values=np.nan)
        near = np.stack([
            padded[1 + dr:padded.shape[0] - 1 + dr, 1 + dc:padded.shape[1] - 1 + dc]
            for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)
        ])
        count = (~np.isnan(near)).sum(axis=0)
        mean = np.where(count > 0, np.nansum(near, axis=0) / np.maximum(count, 1), np.nan)
        a = np.where(np.isnan(a), mean, a)
    return a


def fill(spark, a, passes=2, drop_holes=False):
    a = np.array(a, dtype=float)
    h, w = a.shape
    grid = GridSpec(0, 0, 1, 1, w, h)
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(a.ravel())]
    if drop_holes:
        rows = [r for r in rows if r[1] is not None]
    df = spark.createDataFrame(rows, "pixel_id long, value double")
    out = np.full(h * w, np.nan)
    for r in fill_3x3(df, grid, passes=passes).collect():
        out[r["pixel_id"]] = np.nan if r["value"] is None else r["value"]
    return out.reshape(h, w)


n = np.nan


@pytest.mark.parametrize("cells", [
    [[1, 2, 3], [4, n, 6], [7, 8, 9]],
    [[1, 2, n, n, 5], [2, 3, n, n, 6], [3, 4, n, n, 7], [4, 5, n, n, 8], [5, 6, n, n, 9]],
    [[n, n, n], [n, n, n], [n, n, n]],
    [[1, 2], [3, n]],
    [[1, n, n, n, n, n, n]],
])
@pytest.mark.parametrize("drop_holes", [False, True])
def test_fill_cases(spark, cells, drop_holes):
    np.testing.assert_allclose(fill(spark, cells, drop_holes=drop_holes), brute_fill(cells, 2))


def test_fill_lone_hole_and_corner(spark):
    assert fill(spark, [[1, 2, 3], [4, n, 6], [7, 8, 9]])[1, 1] == pytest.approx(5.0)
    assert fill(spark, [[1, 2], [3, n]])[1, 1] == pytest.approx(2.0)


def test_fill_does_not_wrap(spark):
    out = fill(spark, [[n, n, n, n, 9]], passes=1)
    assert np.isnan(out[0, 0]) and out[0, 3] == 9


def test_fill_across_tiles_and_layers(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (70, 135))
    a[rng.random(a.shape) < 0.7] = n
    a[60:68, 60:70] = n
    grid = GridSpec(0, 0, 1, 1, 135, 70)
    rows = [(layer, i, float(v) + layer) for layer in (0, 1) for i, v in enumerate(a.ravel()) if not np.isnan(v)]
    df = spark.createDataFrame(rows, "layer int, pixel_id long, value double")
    got = fill_3x3(df, grid, ["layer"], 2).toPandas()
    assert not got.duplicated(["layer", "pixel_id"]).any()
    want = brute_fill(a, 2)
    for layer in (0, 1):
        out = np.full(a.size, n)
        part = got[got.layer == layer]
        out[part.pixel_id.to_numpy()] = part.value
        np.testing.assert_allclose(out.reshape(a.shape), want + layer)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=4, max_size=4), min_size=2, max_size=5))
def test_fill_keeps_present_values(spark, cells):
    a = np.array([[n if v is None else v for v in row] for row in cells], dtype=float)
    once, twice = fill(spark, a, 1), fill(spark, a, 2)
    present = ~np.isnan(a)
    assert (once[present] == a[present]).all() and (twice[present] == a[present]).all()
    assert np.isnan(twice).sum() <= np.isnan(once).sum() <= np.isnan(a).sum()
    np.testing.assert_allclose(twice, brute_fill(a, 2))


def test_fill_shuffles_once(spark):
    df = spark.createDataFrame([(1, 1.0)], "pixel_id long, value double")
    plan = fill_3x3(df, GridSpec(0, 0, 1, 1, 4, 4), passes=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_filled_before_masked(spark):
    """A hole whose only valid neighbour is masked out is filled."""
    filled = fill_3x3(spark.createDataFrame([(0, 4.0)], "pixel_id long, value double"), GridSpec(0, 0, 1, 1, 2, 1))
    mask = spark.createDataFrame([(0, 0.0), (1, 1.0)], "pixel_id long, mask double")
    assert [tuple(r) for r in apply_mask(filled, mask).collect()] == [(1, 4.0)]


def test_grid_ignores_file_order(spark):
    cells = spark.createDataFrame([(10.0, 30.0, 1.0), (10.5, 30.0, 2.0), (10.5, 30.5, 3.0)], "lon double, lat double, v double")
    grid = grid_spec(cells)
    assert grid == grid_spec(cells.orderBy(F.desc("lat")))
    assert (grid.west, grid.north, grid.xres, grid.yres, grid.width, grid.height) == (9.75, 30.75, 0.5, 0.5, 2, 2)
    rows = {r["v"]: (r["row"], r["col"], r["pixel_id"]) for r in with_pixel_id(cells, grid).collect()}
    assert rows == {1.0: (1, 0, 2), 2.0: (1, 1, 3), 3.0: (0, 1, 1)}


def test_single_coordinate_step(spark):
    grid = grid_spec(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"))
    assert grid.xres == pytest.approx(1 / 12) and grid.width == 1
    with pytest.raises(ValueError):
        grid_spec(spark.createDataFrame([], "lon double, lat double"))


def test_pixel_round_trip(spark):
    grid = GridSpec(-180, 90, 1 / 12, 1 / 12, 4320, 2160)
    ids = spark.range(0, 4320 * 2160, 99991).withColumnRenamed("id", "p")
    back = ids.filter(grid.pixel(grid.row_of(F.col("p")), grid.col_of(F.col("p"))) != F.col("p"))
    assert back.isEmpty()


def brute_regrid(values, src, dst, method):
    out = {}
    for r in range(dst.height):
        for c in range(dst.width):
            x0, y0 = dst.west + c * dst.xres, dst.north - r * dst.yres
            cx, cy = x0 + dst.xres / 2, y0 - dst.yres / 2
            total = weight = 0.0
            for i in range(src.height):
                for j in range(src.width):
                    v = values[i][j]
                    if v is None:
                        continue
                    sx, sy = src.west + j * src.xres, src.north - i * src.yres
                    if method == "average":
                        w = max(0, min(x0 + dst.xres, sx + src.xres) - max(x0, sx)) * max(
                            0, min(y0, sy) - max(y0 - dst.yres, sy - src.yres))
                    elif method == "nearest":
                        w = float(sx <= cx < sx + src.xres and sy - src.yres < cy <= sy)
                    else:
                        u = abs(cx - sx - src.xres / 2) / src.xres
                        t = abs(cy - sy + src.yres / 2) / src.yres
                        inside = (src.west <= cx <= src.west + src.width * src.xres
                                  and src.north - src.height * src.yres <= cy <= src.north)
                        w = max(0, 1 - u) * max(0, 1 - t) * inside
                    total, weight = total + w * v, weight + w
            if weight > 1e-9:
                out[r * dst.width + c] = total / weight
    return out


@pytest.mark.parametrize("method", ["average", "nearest", "bilinear"])
@pytest.mark.parametrize("dst", [
    GridSpec(0.3, 10.1, 0.7, 0.9, 7, 5), GridSpec(-1, 11, 2.5, 1.7, 3, 4), GridSpec(1, 9, 0.25, 0.25, 5, 6),
])
def test_regrid_against_brute_force(spark, method, dst):
    src = GridSpec(0.0, 10.0, 1.0, 1.0, 5, 4)
    rng = np.random.default_rng(2)
    values = [[None if rng.random() < 0.2 else float(rng.normal()) for _ in range(5)] for _ in range(4)]
    rows = [(r, c, values[r][c]) for r in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "row long, col long, value double")
    got = {r["pixel_id"]: r["value"] for r in regrid(df, src, dst, method).collect()}
    want = brute_regrid(values, src, dst, method)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_nearest_needs_no_shuffle_and_unknown_method_averages(spark):
    g = GridSpec(0, 0, 1, 1, 4, 4)
    df = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, value double")
    plan = lambda m: regrid(df, g, GridSpec(0, 0, 2, 2, 2, 2), m)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("nearest")
    assert plan("whatever").count("Exchange") == plan("average").count("Exchange") == 1


def test_mask_threshold(spark):
    mask = spark.createDataFrame([(1, 0.5), (2, 0.49), (3, NONE)], "pixel_id long, mask double")
    assert [r[0] for r in kept_pixels(mask).collect()] == [1]
    with pytest.raises(ValueError):
        kept_pixels(mask.filter("pixel_id > 1"))


def test_water(spark):
    water = spark.createDataFrame([(1, 49.0), (2, 50.0), (3, NONE)], "pixel_id long, occurrence double")
    assert {r["pixel_id"]: r["mask"] for r in land_mask(water).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def test_area(spark):
    cells = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "pixel_id long, country string")
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0)], "pixel_id long, lon double, lat double")
    assert [r["pixel_id"] for r in clip_aoi(df, cells, "A").collect()] == [1]
    assert [r["pixel_id"] for r in clip_box(df, 2, 2, 4, 4).collect()] == [2]


def test_yield_series(spark):
    rows = [(1, 2000, 1.0, 0), (1, 2000, 2.0, 1), (1, 2001, float("nan"), 2), (1, 1990, 5.0, 3)]
    series = spark.createDataFrame(rows, "pixel_id long, time int, value double, slice int")
    got = {(r["year"]): r["value"] for r in yield_by_year(series, 2000, 2002, slice_col="slice").collect()}
    assert got == {2000: 2.0, 2001: None}
    dated = spark.sql("SELECT 1L AS pixel_id, DATE'2001-05-01' AS time, 3D AS value")
    assert [tuple(r) for r in yield_by_year(dated, 2000, 2002).collect()] == [(1, 2001, 3.0)]
    static = yield_by_year(dated.drop("time"), 2000, 2002, time=None)
    assert sorted(r["year"] for r in static.collect()) == [2000, 2001, 2002]


def test_fill_policy():
    assert is_filled("modis_ndvi") and is_filled("static_zone")
    assert not is_filled("fert_n") and not is_filled("yield_wheat")


def test_tasks_of_a_filling_follow_the_cells(spark, monkeypatch):
    """Twice the layers are twice the tasks, so a task's memory does not grow with the table."""
    from agropanel.operators import grid as module

    monkeypatch.setattr(module, "TASK_CELLS", 1000)
    grid = GridSpec(west=0.0, north=0.0, xres=1.0, yres=1.0, width=100, height=100)

    def tasks(months):
        cells = spark.range(months * 10).select((F.col("id") % months).alias("month"), F.col("id").alias("pixel_id"), F.lit(1.0).alias("value"))
        return module.fill_3x3(cells, grid, ["month"])._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].splitlines()[0]

    assert tasks(6).endswith(" 60") and tasks(12).endswith(" 120")
