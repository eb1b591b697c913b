"""Range-wise quantiles and ranks against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agropanel.functions.order_stats import exact_quantiles, placed_values, quantile_values, quantiles_of, ranked, ranks_of
from agropanel.functions.pairwise import pairwise_correlation
from agropanel.operators.metrics import METRIC_NAMES, metrics

PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value fills a third of it, values span many magnitudes."""
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(700, 5.0), rng.normal(0, 1, 700), rng.lognormal(3, 4, 600), [-1e12, 1e15]])
    pdf = pd.DataFrame({
        "g": ["hot"] * len(hot) + ["cold"] * 9 + ["one"],
        "v": np.concatenate([hot, rng.normal(0, 1, 9), [3.5]]),
    })
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_grouped_quantiles(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in exact_quantiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == {"hot", "cold", "one"}
    for g, part in pdf.groupby("g"):
        assert got[g]["n"] == len(part)
        np.testing.assert_allclose(got[g]["quantiles"], np.quantile(part["v"], PROBS), rtol=1e-9)


def test_whole_column(skewed):
    pdf, df = skewed
    np.testing.assert_allclose(quantile_values(df, "v", PROBS), np.quantile(pdf["v"], PROBS), rtol=1e-9)


def test_constant_column_and_missing_group_key(spark):
    df = spark.createDataFrame([(None, 2.0)] * 30 + [("a", 2.0)] * 5, "g string, v double")
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", [0.0, 0.5, 1.0], ["g"]).collect()}
    assert got == {None: [2.0, 2.0, 2.0], "a": [2.0, 2.0, 2.0]}


def test_no_value_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(ValueError):
        quantile_values(df, "v", [0.5])


def test_nan_and_infinity_as_percentile_has_them(spark):
    """The same answers as the built-in aggregate, whatever the rows."""
    values = [float("-inf"), 1.0, 2.0, 2.0, 3.0, float("inf"), float("nan"), -0.0, 0.0]
    for part in (values, values[:6], values[1:5], values[6:], [float("nan")] * 3, values[5:6]):
        df = spark.createDataFrame([(v,) for v in part], "v double").repartition(3)
        array = F.array(*[F.lit(p) for p in PROBS])
        want = df.agg(F.percentile("v", array)).first()[0]
        np.testing.assert_allclose(exact_quantiles(df, "v", PROBS).first()["quantiles"], want, rtol=1e-12)


def test_rank_table(skewed):
    pdf, df = skewed
    got = ranks_of(placed_values(df, "v", ["g"]), "v", ["g"]).toPandas().set_index(["g", "v"])["_rank"]
    pdf = pdf.assign(rank=pdf.groupby("g")["v"].rank())
    want = pdf.drop_duplicates().set_index(["g", "v"])["rank"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_metrics_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    y = np.round(rng.normal(50, 10, 900), 1)
    pdf = pd.DataFrame({"k": ["a"] * 800 + ["b"] * 100, "y": y, "p": np.round(y + rng.normal(1, 5, 900), 1)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = metrics(df, "y", "p", ["k"]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert got.spearman_rho[k] == pytest.approx(part["y"].rank().corr(part["p"].rank()))
        q = np.quantile(part["y"], [0.25, 0.75])
        assert got.nrmse_iqr[k] == pytest.approx(got.rmse[k] / (q[1] - q[0]))
    assert metrics(df, "y", "p").first()["spearman_rho"] == pytest.approx(pdf["y"].rank().corr(pdf["p"].rank()))
    assert list(got.reset_index().columns) == ["k", *METRIC_NAMES]


def test_no_task_has_all_rows(spark):
    """Neither quantiles nor ranks deal rows to a single partition."""
    df = spark.range(5000).selectExpr("id % 1000 * 1.5 AS y", "id % 700 * 1.1 AS p")
    plan = metrics(df, "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 8 and "CartesianProduct" not in plan


def test_pairwise_correlation_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (400, 4)), columns=list("abcd"))
    pdf["c"] = pdf["a"] + pdf["c"]
    pdf["k"] = 4.1
    pdf.loc[::3, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    got = pairwise_correlation(spark.createDataFrame(pdf).repartition(7), list(pdf.columns)).toPandas()
    got = got.pivot(index="feature_a", columns="feature_b", values="corr").astype(float)
    want = pdf.corr().to_numpy(copy=True)
    want[4, :] = want[:, 4] = np.nan
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-7, atol=1e-9)


def test_pairwise_correlation_of_columns_never_present_together(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (None, 5.0)], "a double, b double")
    got = {(r[0], r[1]): r[2] for r in pairwise_correlation(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("a", "a")] == pytest.approx(1.0)


def test_hot_value_is_one_row(skewed):
    _, df = skewed
    placed = placed_values(df, "v", ["g"])
    assert placed.filter("g = 'hot' AND v = 5.0").count() == 1
    assert placed.agg(F.sum("_c")).first()[0] == 2012


def test_a_column_missing_from_the_first_rows_keeps_its_precision(spark):
    rows = [(float(i), None if i < 12_000 else 1e9 + i % 7) for i in range(12_500)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    got = {(r[0], r[1]): r[2] for r in pairwise_correlation(df, ["a", "b"]).collect()}
    late = np.array(rows[12_000:], float)
    assert got[("a", "b")] == pytest.approx(np.corrcoef(late.T)[0, 1], abs=1e-7)


def plain_quantile(x, p):
    x = np.sort(np.asarray(x, float))
    return float(np.quantile(x, p)) if not np.isnan(x[-1]) else None


@pytest.mark.parametrize("sketch, rows, limit", [(10_000, 900, 10**6), (200, 30_000, 10**6), (200, 30_000, 100), (100, 30_000, 3)])
def test_selected_quantiles(spark, monkeypatch, sketch, rows, limit):
    """With a coarse sketch brackets are narrow; with a low limit they are bracketed again."""
    from agropanel.functions import order_stats as O

    monkeypatch.setattr(O, "SKETCH", sketch)
    monkeypatch.setattr(O, "FEW", 2 * sketch)
    monkeypatch.setattr(O, "BRACKET_ROWS", limit)
    rng = np.random.default_rng(rows)
    x = np.concatenate([rng.normal(0, 100, rows // 3).round(3), np.full(rows // 3, 5.0), rng.integers(-3, 9, rows // 3).astype(float), [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "v double").repartition(6)
    probs = [0.0, 0.005, 0.01, 0.2, 0.5, 0.66, 0.9, 0.995, 1.0]
    np.testing.assert_allclose(O.quantile_values(df, "v", probs), np.quantile(x, probs), rtol=1e-12)
    for lo, hi in ((0.005, 0.995), (0.2, 0.8), (0.5, 0.5), (0.4, 0.1)):
        low = np.quantile(x, lo)
        assert O.trim_values(df, "v", lo, hi) == pytest.approx((low, np.quantile(x[x >= low], hi)), rel=1e-12)


def test_selected_quantiles_of_odd_columns(spark):
    from agropanel.functions import order_stats as O

    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),), (float("-inf"),)], "v double")
    got = O.quantile_values(odd, "v", [0.0, 1 / 3, 2 / 3, 1.0])
    assert got[:3] == [float("-inf"), 1.0, float("inf")] and np.isnan(got[3])
    assert O.quantile_values(odd.filter("v = 1"), "v", [0.3]) == [1.0]
    with pytest.raises(ValueError):
        O.quantile_values(odd.filter("v IS NULL"), "v", [0.5])
    with pytest.raises(ValueError):
        O.trim_values(odd.limit(0), "v", 0.1, 0.9)


def test_selection_shuffles_no_rows(spark):
    from agropanel.functions import order_stats as O

    df = spark.range(100_000).selectExpr("double(id * 7919 % 100003) AS v")
    group = "selection"
    spark.sparkContext.setJobGroup(group, "two scans")
    assert O.trim_values(df, "v", 0.1, 0.9)[0] == pytest.approx(np.quantile((np.arange(100_000) * 7919) % 100003, 0.1))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4


def test_ranked_rows_across_ranges(spark):
    """Values that fill several ranges, beside NULL keys, NaN and weights; no join of the rows by value."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 5 == 0 else f"k{i % 3}", float("nan") if i % 97 == 0 else (7.0 if i % 3 == 0 else float(rng.integers(0, 9))), float(i), int(rng.integers(1, 4))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE, t DOUBLE, w LONG").repartition(7)
    found = ranked(df, "v", "t", ["g"], "w")
    got = found.toPandas()
    assert len(got) == len(rows)
    want = pd.DataFrame(rows, columns=["g", "v", "t", "w"])
    want = want.loc[want.index.repeat(want.w)].assign(g=lambda d: d.g.fillna("-"), v=lambda d: d.v.fillna(np.inf))
    want["rank"] = want.groupby("g").v.rank()
    want = want.drop_duplicates("t").set_index("t")["rank"]
    assert np.allclose(got.set_index("t")["_rank"].sort_index(), want.sort_index())
    # Own places are gapless per group.
    for _, one in got.sort_values("_first").groupby("g", dropna=False):
        assert (one["_first"].to_numpy() == np.cumsum(one.w.to_numpy()) - one.w.to_numpy()).all() and (one.n == one.w.sum()).all()
    places = found.select("g", "v", F.col("w").alias("_c"), "_first", "n")
    q = quantiles_of(places, "v", [0.25, 0.75], ["g"]).toPandas().set_index(["g"])["quantiles"]
    flat = pd.DataFrame(rows, columns=["g", "v", "t", "w"])
    flat = flat.loc[flat.index.repeat(flat.w)].assign(v=lambda d: d.v.fillna(np.inf))
    assert np.allclose(q["k1"], flat[flat.g == "k1"].v.quantile([0.25, 0.75]))


def test_scores_join_no_rows_by_value(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("y"), (F.col("id") * 7 % 31).cast("double").alias("p"))
    plan = metrics(df, "y", "p", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("_range" in line for line in joins), joins
