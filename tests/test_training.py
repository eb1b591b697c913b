"""Scores, splits, trimming, sampling, sequences, models and the response search."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agropanel.functions.hashing import draw_order, spatial_fold
from agropanel.operators import metrics as E
from agropanel.operators import models as L
from agropanel.operators import recommend as R
from agropanel.operators import sampling as D
from agropanel.operators import sequences as S
from agropanel.operators import splits as P
from agropanel.plans.tabular_run import RunSettings, run

PAIRS = "y double, p double"


def test_metrics_of_known_pairs(frame):
    row = E.metrics(frame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], PAIRS), "y", "p").first()
    y, p = np.array([1.0, 2, 4]), np.array([2.0, 2, 3])
    assert row["n"] == 3 and row["rmse"] == pytest.approx(math.sqrt(2 / 3)) and row["mae"] == pytest.approx(2 / 3)
    assert row["r2"] == pytest.approx(1 - 2 / ((y - y.mean()) ** 2).sum()) and row["bias"] == pytest.approx(0.0)
    assert row["mape%"] == pytest.approx(100 * np.mean([1, 0, 0.25])) and row["acc@20%"] == pytest.approx(100 / 3)
    assert row["smape%"] == pytest.approx(100 * np.mean([2 / 3, 0, 2 / 7])) and row["acc@30%"] == pytest.approx(200 / 3)
    assert row["nrmse_iqr"] == pytest.approx(row["rmse"] / 1.5) and row["nrmse_mean"] == pytest.approx(row["rmse"] / (7 / 3))
    assert row["pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert row["spearman_rho"] == pytest.approx(pd.Series(y).rank().corr(pd.Series(p).rank()))
    assert row["explained_variance"] == pytest.approx(1 - np.var(y - p) / np.var(y))


def test_metrics_edges(frame):
    constant = E.metrics(frame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], PAIRS), "y", "p").first()
    assert constant["pearson_r"] == 0.0 and constant["spearman_rho"] is None
    zero = E.metrics(frame([(0.0, 1e-7), (0.0, 0.0)], PAIRS), "y", "p").first()
    assert zero["mape%"] == pytest.approx(5.0) and zero["acc@10%"] == pytest.approx(100.0)
    one = E.metrics(frame([(1.0, 2.0)], PAIRS), "y", "p").first()
    assert one["pearson_r"] == 0.0 and one["spearman_rho"] == 0.0 and one["n"] == 1
    assert E.metrics(frame([(None, 1.0)], PAIRS), "y", "p").isEmpty()


def test_perfect_prediction(frame):
    row = E.metrics(frame([(float(i), float(i)) for i in range(1, 9)], PAIRS), "y", "p").first()
    assert row["rmse"] == row["mape%"] == row["bias"] == 0.0 and row["acc@10%"] == 100.0
    assert row["r2"] == row["explained_variance"] == 1.0
    assert row["pearson_r"] == pytest.approx(1.0) and row["spearman_rho"] == pytest.approx(1.0)


def test_reports(frame):
    df = frame([(2000, 1.0, 2.0), (2000, 1.0, 4.0), (2001, 1.0, 1.0)], f"year int, {PAIRS}")
    got = {r["year"]: tuple(r)[1:] for r in E.residuals(df, "y", "p").collect()}
    assert got == {2000: (2.0, 2.0, pytest.approx(math.sqrt(2)), 2), 2001: (0.0, 0.0, None, 1)}
    assert [r["year"] for r in E.metrics_by_year(df, "y", "p").collect()] == [2001, 2000]
    pooled = np.percentile([1, 1, 1, 2, 4, 1], [1, 99])
    assert tuple(E.parity_range(df, "y", "p").first()) == pytest.approx(tuple(pooled))
    assert E.parity_bounds(df, "y", "p") == pytest.approx(tuple(pooled))


def test_best_run_needs_a_gain(frame):
    runs = frame([("a", 1, 5.0), ("b", 2, 4.0), ("c", 3, 4.0 - 5e-7), ("d", 4, 4.0 - 2e-6), ("e", 5, 4.5)], "run string, o int, rmse double")
    assert E.best_run(runs, "run", "o").first()["run"] == "d"
    assert E.best_run(runs.filter("o < 4"), "run", "o").first()["run"] == "b"


YEARS = [(p, y) for p in range(20) for y in range(1995, 2001)]


def test_threshold_split_may_overlap(frame):
    df = frame(YEARS, "pixel_id long, year int")
    train, val, test = P.temporal_split(df, 1998, 1998, 1999)
    assert (train.count(), val.count(), test.count()) == (80, 20, 40)
    bounded = P.temporal_split(df, 1998, 1998, 1999, test_year_max=1999, train_min_year=1996)
    assert (bounded.train.count(), bounded.test.count()) == (60, 20)
    tagged = P.tag_parts(df, P.threshold_rules(1998, 1998, 1999)).groupBy("split").count()
    assert {r[0]: r[1] for r in tagged.collect()} == {"train": 80, "val": 20, "test": 40}


def test_leaveout_covers_all(frame):
    df = frame(YEARS, "pixel_id long, year int")
    parts = P.temporal_leaveout(df, 1996, 1997)
    assert [p.count() for p in parts] == [80, 20, 20]
    assert P.labelled(parts).count() == df.count()


@pytest.mark.parametrize("fold", range(3))
def test_spatial_folds(frame, fold):
    df = frame(YEARS, "pixel_id long, year int")
    train, val, test = P.spatial_kfold(df, 3, fold)
    want = {p for p in range(20) if p * 2654435761 % 3 == fold}
    assert {r[0] for r in test.select("pixel_id").collect()} == want
    assert {r[0] for r in val.select("year").collect()} == {1997}
    assert train.count() + val.count() + test.count() == 120
    tagged = P.tag_parts(df, P.spatial_rules(df, 3, fold)).groupBy("split").count()
    assert {r[0]: r[1] for r in tagged.collect()} == {"train": train.count(), "val": val.count(), "test": test.count()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=30), st.integers(2, 9))
def test_fold_of_large_ids(spark, ids, k):
    df = spark.createDataFrame([(i,) for i in ids], "p long")
    got = [r[0] for r in df.select(spatial_fold(F.col("p"), k)).collect()]
    assert got == [i * 2654435761 % k for i in ids]
    order = [r[0] for r in df.select(draw_order(F.col("p"), seed=5)).collect()]
    assert all(0 <= o < 2147483647 for o in order)


def test_unknown_splits_are_refused(frame):
    df = frame(YEARS, "pixel_id long, year int")
    for kind, more in (("random", {}), ("temporal", {"strategy": "x"})):
        with pytest.raises(ValueError):
            P.split_panel(df, kind, **more)
    assert P.split_panel(df, "temporal", strategy="leaveout", val_year=1995, test_year=1996).val.count() == 20
    assert P.split_panel(df, "spatial", kfolds=2, fold_index=1).test.count() > 0


def test_folds(frame):
    folds = P.temporal_cv()
    assert len(folds) == 13 and folds[0] == P.Fold(2002, 2003) and folds[-1].name == "val2014_test2015"
    df = frame(YEARS, "pixel_id long, year int")
    got = {(r["fold"], r["split"]): r["rows"] for r in P.fold_sizes(df, P.temporal_cv(1995, 1996)).collect()}
    assert got[("val1995_test1996", "train")] == 80 and got[("val1996_test1997", "val")] == 20 and len(got) == 6


def test_trim_order(frame):
    ys = [-1000.0, *[float(i) for i in range(1, 31)], 5000.0]
    df = frame([(i, 1995 if i % 4 else 1996, y) for i, y in enumerate(ys)], "pixel_id long, year int, y double")
    split = P.Split(df, df.filter("year = 1996"), df.filter("year = 1996"))
    joint = P.quantile_trim(split, "y", 0.1, 0.9, sequential=False)
    lo, hi = np.quantile(ys, [0.1, 0.9])
    assert joint.train.count() == sum(lo <= y <= hi for y in ys)
    seq = P.quantile_trim(split, "y", 0.1, 0.9, sequential=True)
    left = [y for y in ys if y >= lo]
    assert seq.train.count() == sum(y <= np.quantile(left, 0.9) for y in left)
    assert seq.train.count() != joint.train.count()
    assert seq.val.count() == sum(lo <= y <= np.quantile(left, 0.9) for i, y in enumerate(ys) if i % 4 == 0)
    for nothing in ((0, 1), (None, None), (0.0, 1.0)):
        assert P.quantile_trim(split, "y", *nothing).train.count() == len(ys)


def qcut_keys(part, cap):
    q = pd.qcut(part["y"], 10, labels=False, duplicates="drop")
    per_bin = max(cap // (q.max() + 1), 1)
    return {b: min(per_bin, n) for b, n in q.value_counts().items()}, q


@pytest.mark.parametrize("cap", [40, 7])
def test_downsample_by_decile(spark, cap):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 1, 200), np.where(rng.random(100) < 0.9, 3.0, rng.normal(0, 1, 100)), rng.normal(0, 1, 6)])
    pdf = pd.DataFrame({"pixel_id": range(306), "year": [2000] * 200 + [2001] * 100 + [2002] * 6, "y": y})
    months = spark.createDataFrame(pdf).crossJoin(spark.range(3).withColumnRenamed("id", "month"))
    kept = D.downsample(months, "y", cap).toPandas()
    assert (kept.groupby(["pixel_id", "year"]).size() == 3).all()
    keys = kept.drop_duplicates("pixel_id")
    for year, part in pdf.groupby("year"):
        mine = keys[keys.year == year]
        if len(part) <= cap:
            assert len(mine) == len(part)
            continue
        sizes, q = qcut_keys(part, cap)
        assert q.loc[mine.pixel_id].value_counts().to_dict() == sizes
        assert len(mine) <= max(cap, 10)
    again = D.downsample(months.repartition(9), "y", cap).toPandas()
    assert set(again.pixel_id) == set(kept.pixel_id)


def test_downsample_random_and_constant(spark):
    df = spark.range(100).select(F.col("id").alias("pixel_id"), F.lit(2000).alias("year"), F.lit(1.0).alias("y"))
    assert D.downsample(df, "y", 30, "random").count() == 30
    assert D.downsample(df, "y", 30).count() == 30
    other = D.downsample(df, "y", 30, "random", seed=2)
    assert other.join(D.downsample(df, "y", 30, "random"), ["pixel_id"], "left_anti").count() > 0
    with pytest.raises(ValueError):
        D.downsample(df, "y", 30, "odd")


def months(frame, have):
    rows = [(p, y, m, float(m), float(y - 2000), float(p * 100 + y - 2000)) for p, y, ms in have for m in ms]
    return frame(rows[::-1], "pixel_id long, year int, month int, a double, fert_n double, y double")


def seqs(df, **kw):
    out = S.build_sequences(df, ["a"], ["fert_n"], "y", **kw).collect()
    return {(r["pixel_id"], r["year"]): r for r in out}


def test_sequences(frame):
    df = months(frame, [(1, 2001, range(1, 13)), (2, 2001, range(3, 13)), (3, 2001, range(1, 10)), (4, 2001, range(1, 9))])
    got = seqs(df, min_months=9)
    assert set(got) == {(1, 2001), (2, 2001), (3, 2001)}
    assert set(seqs(df, min_months=10)) == {(1, 2001), (2, 2001)}
    full, short = got[(1, 2001)], got[(2, 2001)]
    assert full["month_idx"] == list(range(12)) and full["x"][4] == [5.0, 1.0] and full["y"] == 101.0
    assert short["month_idx"] == [-1, -1, *range(2, 12)] and short["x"][:3] == [[0.0, 0.0], [0.0, 0.0], [3.0, 1.0]]
    assert len(seqs(df, seq_len=6)[(1, 2001)]["x"]) == 6 and seqs(df, seq_len=6)[(1, 2001)]["month_idx"] == list(range(6, 12))
    assert len(seqs(df, pad=False)[(2, 2001)]["x"]) == 10


def test_copies_of_a_month_do_not_lengthen_a_sequence(frame):
    df = months(frame, [(1, 2001, range(1, 13))])
    many = df.union(df).union(df)
    assert seqs(many)[(1, 2001)] == seqs(df, unique_months=True)[(1, 2001)]


def test_months_without_dynamics_are_not_valid(frame):
    df = months(frame, [(1, 2001, range(1, 13))]).withColumn("a", F.when(F.col("month") > 4, F.col("a")))
    assert seqs(df, min_months=9) == {}
    row = seqs(df, min_months=8)[(1, 2001)]
    assert row["x"][0] == [0.0, 1.0] and row["month_idx"][0] == 0


def test_history_needs_consecutive_years(frame):
    every = range(1, 13)
    df = months(frame, [(1, 2000, every), (1, 2001, every), (1, 2003, every), (2, 2003, every)])
    got = seqs(df, history_years=2, seq_len=24)
    assert set(got) == {(1, 2001)}
    assert got[(1, 2001)]["month_idx"] == [*range(12), *range(12)] and got[(1, 2001)]["x"][0] == [1.0, 0.0]
    assert got[(1, 2001)]["y"] == 101.0


def test_previous_year_and_target_years(frame):
    every = range(1, 13)
    df = months(frame, [(1, 2000, every), (1, 2001, every), (1, 2003, every)])
    got = seqs(df, add_prev_year_yield=True, target_years=[2001, 2003])
    assert set(got) == {(1, 2001), (1, 2003)}
    assert got[(1, 2001)]["x"][0] == [1.0, 1.0, 100.0] and got[(1, 2003)]["x"][0] == [1.0, 3.0, 0.0]


def test_split_sequences_use_earlier_parts_as_context(frame):
    every = range(1, 13)
    df = months(frame, [(1, y, every) for y in range(2000, 2005)])
    split = P.temporal_split(df, 2002, 2003, 2004)
    train, val, test = S.split_sequences(split, ["a"], ["fert_n"], "y", history_years=2, seq_len=24)
    years = lambda d: sorted(r["year"] for r in d.collect())
    assert (years(train), years(val), years(test)) == ([2001, 2002], [2003], [2004])
    overlapping = P.temporal_split(df, 2003, 2003, 2004)
    assert len(S.split_sequences(overlapping, ["a"], [], "y")[1].first()["x"]) == 12
    assert tuple(S.sequence_summary(train).first()) == (2, 24, 2, 0)


@pytest.fixture(scope="module")
def law(spark):
    """A linear law with a little noise, features on different scales."""
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(0, 1, (n, 3)) * [1, 20, 0.1] + [0, 50, 3]
    y = 10 + 2 * x[:, 0] - 0.1 * x[:, 1] + 30 * x[:, 2] + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame(x, columns=["a", "b", "fert_n"]).assign(y=y, pixel_id=np.arange(n), year=2000 + np.arange(n) % 5)
    return pdf, spark.createDataFrame(pdf).cache()


FEATURES = ["a", "b", "fert_n"]


def standardised(pdf):
    x = pdf[FEATURES].to_numpy().astype("float32").astype(float)
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("alpha", [0.0, 10.0, 500.0])
def test_ridge_is_the_usual_ridge(law, alpha):
    pdf, df = law
    x, y = standardised(pdf), pdf["y"].to_numpy()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (y - y.mean()))
    got = L.predict(L.fit("linear", df, FEATURES, "y", alpha=alpha), df).orderBy("pixel_id").toPandas()
    np.testing.assert_allclose(got["y_pred"], x @ w + y.mean(), rtol=1e-5)
    np.testing.assert_allclose(got["residual"], got["y_pred"] - y, atol=1e-9)


def elastic(x, y, alpha, ratio, rounds=2000):
    w, n = np.zeros(x.shape[1]), len(y)
    yc = y - y.mean()
    for _ in range(rounds):
        for j in range(len(w)):
            rho = x[:, j] @ (yc - x @ w + x[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
    return w


@pytest.mark.parametrize("alpha, ratio", [(0.15, 0.35), (1.0, 0.9), (0.5, 0.1)])
def test_elasticnet_is_the_usual_one(law, alpha, ratio):
    pdf, df = law
    x, y = standardised(pdf), pdf["y"].to_numpy()
    w = elastic(x, y, alpha, ratio)
    model = L.fit("elasticnet", df, FEATURES, "y", alpha=alpha, l1_ratio=ratio, tol=1e-9)
    got = L.predict(model, df).orderBy("pixel_id").toPandas()
    np.testing.assert_allclose(got["y_pred"], x @ w + y.mean(), rtol=1e-3)


@pytest.mark.parametrize("kind, params", [
    ("random_forest", {"n_estimators": 10, "max_depth": 6}), ("gbrt", {"n_estimators": 20, "learning_rate": 0.3}),
    ("xgboost", {"n_estimators": 5, "learning_rate": 0.3}),
])
def test_trees_learn(law, kind, params):
    pdf, df = law
    scores = E.metrics(L.predict(L.fit(kind, df, FEATURES, "y", **params), df), "y", "y_pred").first()
    assert scores["r2"] > 0.6


def test_boosting_stops_on_validation_rows(law):
    _, df = law
    train, val = df.filter("year < 2004"), df.filter("year = 2004")
    model = L.fit("gbrt", train, FEATURES, "y", val=val, n_estimators=60, learning_rate=1.0)
    assert model.pipeline.stages[-1].getNumTrees < 60
    with pytest.raises(ValueError):
        L.fit("linear", train, FEATURES, "y", val=val)


def test_log_model_and_saving(law, tmp_path, spark):
    _, df = law
    model = L.fit("linear", df, FEATURES, "y", log_transform=True, derive={"log1p_features": ["fert_"]})
    L.save_model(model, str(tmp_path / "m"))
    back = L.load_model(spark, str(tmp_path / "m"))
    assert (back.features, back.log_transform, back.derive) == (model.features, True, model.derive)
    both = L.score(back, L.score(model, df, "one"), "two")
    assert both.filter(F.abs(F.col("one") - F.col("two")) > 1e-9).isEmpty()
    assert E.metrics(both, "y", "one").first()["r2"] > 0.9
    with pytest.raises(ValueError):
        L.fit("svm", df, FEATURES, "y")
    with pytest.raises(ValueError):
        L.fit("linear", df, FEATURES, "y", alfa=3)
    with pytest.raises(ValueError):
        L.fit("linear", df.filter("a > 99"), FEATURES, "y")


def test_sweep(law):
    _, df = law
    out = L.sweep(df, FEATURES, "y", "linear", {"alpha": [0.1, 1e6]}, [P.Fold(2001, 2002), P.Fold(2002, 2003)]).collect()
    assert len(out) == 8
    best = {(r["fold"], r["split"]): r["params"] for r in sorted(out, key=lambda r: -r["rmse"])}
    assert set(best.values()) == {'{"alpha": 0.1}'}


def test_recommend_linear(law):
    _, df = law
    model = L.fit("linear", df, FEATURES, "y", alpha=1e-6)
    bounds = R.response_bounds(df, ["fert_n"])
    got = R.recommend(model, df.filter("year = 2000"), bounds).toPandas()
    assert len(got) == 80 and (got.pred_opt >= got.pred_base).all()
    hi = bounds["fert_n"][1]
    better = got[got.fert_n.notna()]
    np.testing.assert_allclose(better.fert_n, hi)
    # Only rows already above the highest level keep what they have.
    own = df.filter("year = 2000").toPandas().set_index("pixel_id").fert_n
    assert set(got[got.fert_n.isna()].pixel_id) == set(own[own >= hi].index)


def test_recommend_searches_the_product_of_two(spark):
    """y falls with the distance from (2, 6) on the grid; the search finds both by turns."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"fert_a": rng.uniform(0, 6, 600), "fert_b": rng.uniform(0, 12, 600)})
    pdf["y"] = 50 - (pdf.fert_a - 2) ** 2 - (pdf.fert_b - 6) ** 2
    df = spark.createDataFrame(pdf.assign(pixel_id=range(600), year=2000))
    model = L.fit("gbrt", df, ["fert_a", "fert_b"], "y", n_estimators=40, learning_rate=0.3)
    got = R.recommend(model, df.limit(20), {"fert_a": (0.0, 6.0), "fert_b": (0.0, 12.0)}).toPandas()
    assert (got.pred_opt > 45).all()
    assert got.fert_a.dropna().isin([2.0, 1.0, 3.0]).all() and got.fert_b.dropna().isin([4.0, 6.0, 8.0]).all()


def test_recommend_without_gain(law):
    _, df = law
    model = L.fit("linear", df, ["a", "b"], "y")
    got = R.recommend(model, df.limit(5), {"fert_n": (0.0, 1.0)}).toPandas()
    assert (got.pred_opt == got.pred_base).all() and got.fert_n.isna().all()
    with pytest.raises(ValueError):
        R.recommend(model, df, {"fert_unknown": (0.0, 1.0)})


def test_the_search_shuffles_nothing(law):
    _, df = law
    model = L.fit("linear", df, FEATURES, "y")
    tried = R._try_levels(lambda d, out: L.score(model, d, out), df.withColumns({"pred_opt": F.lit(0.0), "_best_fert_n": F.lit(None).cast("double")}), "fert_n", [0.0, 1.0])
    assert "Exchange" not in tried._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_levels(frame):
    assert R.candidates({"fert_a": (0.0, 3.0)}, 7)["fert_a"] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0]
    df = frame([(float(i), None if i % 2 else 1.0) for i in range(101)], "fert_a double, fert_b double")
    assert R.response_bounds(df, ["fert_a", "fert_b"]) == {"fert_a": (1.0, 99.0), "fert_b": (1.0, 1.0)}
    with pytest.raises(ValueError):
        R.candidates({}, 1)


def test_whole_run(spark, data, tmp_path):
    from agropanel.plans import views
    from agropanel.plans.tabular_run import ENHANCED, ENHANCED_DERIVED
    from agropanel.sources.sinks import aggregate_runs

    done = run(views.panel(spark, data), RunSettings(
        target=views.TARGET, kind="linear", split={"kind": "temporal", "train_max_year": 1998, "val_year": 1999, "test_year_min": 2000},
        annual=ENHANCED, derive=ENHANCED_DERIVED, log_transform=True, model={"alpha": 10.0},
    ))
    done.write(str(tmp_path), "wheat")
    assert {p.name for p in tmp_path.iterdir()} == {
        "preds_wheat_linear_test", "residuals_by_year_wheat_linear", "metrics_wheat_linear.json", "model_wheat_linear"}
    rows = spark.read.option("header", True).csv(str(tmp_path / "preds_wheat_linear_test"))
    assert rows.columns == ["pixel_id", "year", "yield_wheat", "y_pred", "residual"] and rows.count() == done.predictions().count()
    assert aggregate_runs(spark, str(tmp_path), "rmse")["mean"] == pytest.approx(done.metrics().first()["rmse"])
    assert {r["split"] for r in done.metrics_by_split().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        run(views.panel(spark, data).filter("year > 2100"), RunSettings(target=views.TARGET))
