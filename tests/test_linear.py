"""Linear fits from sufficient statistics against the rows themselves."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agropanel.functions.order_stats import trim_bounds
from agropanel.operators import linear
from agropanel.operators import metrics as E
from agropanel.operators import models as L
from agropanel.operators import splits as P
from agropanel.operators import sweeps
from agropanel.operators.moments import Moments, added, moments

FEATURES = ["a", "b", "c", "fert_n", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    """Correlated features far from zero, a constant one, and a tail of large targets."""
    rng = np.random.default_rng(5)
    n = 900
    base = rng.normal(0, 1, n)
    pdf = pd.DataFrame({
        "a": base + rng.normal(0, 0.3, n), "b": 1000 - 5 * base + rng.normal(0, 4, n), "c": rng.normal(0, 1e-3, n), "fert_n": rng.gamma(2, 30, n), "flat": 7.0,
    })
    pdf["y"] = np.exp(3 + 0.2 * pdf.a + 0.004 * pdf.fert_n + rng.normal(0, 0.2, n))
    pdf = pdf.assign(pixel_id=np.arange(n), year=2000 + np.arange(n) % 6)
    pdf.loc[::50, "fert_n"] = None
    df = spark.createDataFrame(pdf).withColumn("fert_n", F.when(~F.isnan("fert_n"), F.col("fert_n")))
    return pdf, df.repartition(7).cache()


def matrix(pdf):
    return pdf[FEATURES].fillna(0).to_numpy().astype("float32").astype(float)


def problem_of(x, y):
    return linear.Problem.of(Moments.of(np.column_stack([x, y])))


def test_moments_add_up(table):
    pdf, df = table
    whole = Moments.of(matrix(pdf))
    found = moments(df, F.array(*[F.coalesce(c, F.lit(0)).cast("float").cast("double") for c in FEATURES]), ["year"])
    assert set(found) == {(y,) for y in range(2000, 2006)} and sum(m.n for m in found.values()) == len(pdf)
    both = added(found.values())
    np.testing.assert_allclose(both.mean, whole.mean, rtol=1e-12)
    np.testing.assert_allclose(both.scatter, whole.scatter, rtol=1e-9, atol=1e-9)
    shifted = added([Moments.of(matrix(pdf)[:100] + 1e8), Moments.of(matrix(pdf)[100:] + 1e8)])  # nothing cancels far from zero
    np.testing.assert_allclose(np.diag(shifted.scatter), np.diag(whole.scatter), rtol=1e-4, atol=1e-4)
    assert added([]) is None and moments(df.limit(0), F.array(F.col("a")), []) == {}


@pytest.mark.parametrize("alpha, ratio", [(0.001, 0.35), (0.01, 0.9), (0.05, 1.0), (0.2, 0.1), (5.0, 0.5)])
def test_elastic_net_is_optimal(table, alpha, ratio):
    pdf, _ = table
    x, y = matrix(pdf), np.log(pdf["y"].to_numpy())
    problem = problem_of(x, y)
    w = linear.elastic_net(problem, alpha, ratio, tol=1e-13)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - ratio) * w
    on = w != 0
    np.testing.assert_allclose(slope[on], alpha * ratio * np.sign(w[on]), atol=1e-9)
    assert (np.abs(slope[~on]) <= alpha * ratio + 1e-9).all() and w[4] == 0
    cost = lambda v: ((y - y.mean() - z @ v) ** 2).mean() / 2 + alpha * (ratio * np.abs(v).sum() + (1 - ratio) * v @ v / 2)
    rng = np.random.default_rng(1)
    for _ in range(50):  # the gap is an upper bound of what any point is away from the least cost
        v = w + rng.normal(0, 0.1, len(w))
        assert 0 <= cost(v) - cost(w) <= problem.gap(v, alpha, ratio) + 1e-12


def test_paths_and_limits(table):
    pdf, _ = table
    problem = problem_of(matrix(pdf), np.log(pdf["y"].to_numpy()))
    alphas = [0.2, 0.001, 0.05, 0.01]
    warm = linear.path(problem, alphas, 0.5, tol=1e-12)
    for alpha in alphas:
        np.testing.assert_allclose(warm[alpha], linear.elastic_net(problem, alpha, 0.5, tol=1e-12), atol=1e-6)
    assert [np.count_nonzero(warm[a]) for a in sorted(alphas)] == sorted([np.count_nonzero(w) for w in warm.values()], reverse=True)
    with pytest.raises(linear.NotConverged):
        linear.elastic_net(problem, 1e-6, 0.5, max_iter=1, tol=1e-15)
    np.testing.assert_allclose(linear.elastic_net(problem, 0.3, 0.0), linear.ridge(problem, 0.3 * problem.n))


def test_without_intercept(table):
    pdf, df = table
    for kind, params in (("linear", {"alpha": 3.0}), ("elasticnet", {"alpha": 0.5, "l1_ratio": 0.5, "tol": 1e-12})):
        one = L.fit(kind, df, FEATURES, "y", fit_intercept=True, **params)
        two = L.fit(kind, df, FEATURES, "y", fit_intercept=False, **params)
        np.testing.assert_allclose(one.weights, two.weights, atol=1e-8)
        assert one.intercept - two.intercept == pytest.approx(pdf["y"].mean())


def test_trim_bounds_are_those_of_the_rows(table):
    pdf, df = table
    for sequential in (True, False):
        found = {r["year"]: (r["low"], r["high"]) for r in trim_bounds(df, "y", 0.1, 0.8, ["year"], sequential).collect()}
        for year, rows in pdf.groupby("year")["y"]:
            low = rows.quantile(0.1)
            assert found[year] == pytest.approx((low, (rows[rows >= low] if sequential else rows).quantile(0.8)))
    assert tuple(trim_bounds(df, "y", None, 0.5, ["flat"]).select("low", "high").first()) == (None, pytest.approx(pdf["y"].median()))


@pytest.mark.parametrize("kind, grid, settings", [
    ("linear", {"alpha": [0.5, 50.0]}, {}), ("elasticnet", {"alpha": [0.001, 0.02, 0.2], "l1_ratio": [0.35, 0.9]}, {"tol": 1e-14, "max_iter": 9000}),
])
def test_sweep_equals_separate_fits(table, kind, grid, settings):
    _, df = table
    folds, trim = [P.Fold(2001, 2002), P.Fold(2004, 2005), P.Fold(2005, 2006)], (0.02, 0.97)
    derive = {"log1p_features": ["fert_"]}
    out = L.sweep(df, FEATURES, "y", kind, grid, folds, trim=trim, log_transform=True, derive=derive, **settings)
    got = {(r["fold"], r["params"], r["split"]): r for r in out.collect()}
    assert len(got) == len(L.parameter_grid(grid)) * 5  # no row has the year 2006
    for fold in folds:
        split = P.quantile_trim(P.temporal_leaveout(df, fold.val_year, fold.test_year), "y", *trim)
        for params in L.parameter_grid(grid):
            model = L.fit(kind, split.train, FEATURES, "y", log_transform=True, derive=derive, **settings, **params)
            for r in E.metrics(L.predict(model, P.labelled(split, ("val", "test"))), "y", "y_pred", ["split"]).collect():
                same = got[(fold.name, json.dumps(params, sort_keys=True), r["split"])]
                for m in E.METRIC_NAMES:
                    assert same[m] == (r[m] if r[m] is None else pytest.approx(r[m], rel=1e-8, abs=1e-8)), (m, fold, params)


def test_sweep_reads_the_rows_once_for_all_fits(table):
    _, df = table
    jobs = []
    many = lambda n: sweeps.solve_cells(df, FEATURES, "y", "linear", {"alpha": [float(i + 1) for i in range(n)]}, P.temporal_cv(2000, 2004))
    tracker = df.sparkSession.sparkContext.statusTracker()
    for n in (1, 40):
        df.sparkSession.sparkContext.setJobGroup(f"sweep-{n}", "fits")
        assert len(many(n)) == 5 * n
        jobs.append(len(tracker.getJobIdsForGroup(f"sweep-{n}")))
    df.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    with pytest.raises(ValueError):
        L.sweep(df, FEATURES, "y", "linear", {"alpa": [1.0]}, P.temporal_cv(2000, 2001))
