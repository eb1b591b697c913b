"""Histogram boosting against a plain booster that looks at every row."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agropanel.operators import boosting as B
from agropanel.operators import metrics as E
from agropanel.operators import models as L

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(21)
    n = 600
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n).astype(float), "b": rng.normal(0, 1, n).round(1), "c": rng.integers(0, 4, n) * 2.5, "flat": 1.0})
    pdf["y"] = np.sin(pdf.a / 6) * 4 + pdf.b * (pdf.c > 3) + rng.normal(0, 0.2, n)
    return pdf.assign(part=np.arange(n) % 3), spark.createDataFrame(pdf.assign(part=np.arange(n) % 3)).repartition(2).cache()


def values():
    return F.array(*FEATURES)


def plain(x, y, s, cuts):
    """Trees as nested tuples ``(feature, threshold, gain, left, right)`` or leaf values; all sums over the rows themselves."""
    soft = lambda g: np.sign(g) * max(abs(g) - s.reg_alpha, 0)
    score = lambda g, h: soft(g) ** 2 / (h + s.reg_lambda)
    pred, out = np.full(len(y), y.mean()), []

    def best(rows, g):
        found = None
        for f, points in enumerate(cuts):
            for t in points:
                left = rows[x[rows, f] <= t]
                right = rows[x[rows, f] > t]
                if min(len(left), len(right)) < max(s.min_child_weight, 1):
                    continue
                gain = (score(g[left].sum(), len(left)) + score(g[right].sum(), len(right)) - score(g[rows].sum(), len(rows))) / 2 - s.gamma
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, float(t), left, right)
        return found

    for _ in range(s.n_estimators):
        g = pred - y
        leaves = [(np.arange(len(y)), 0, best(np.arange(len(y)), g) if s.max_depth else None, ())]
        nodes = {}
        while not s.num_leaves or len(leaves) < s.num_leaves:
            open_leaves = [leaf for leaf in leaves if leaf[2] and (s.max_depth <= 0 or leaf[1] < s.max_depth)]
            if not open_leaves:
                break
            leaf = max(open_leaves, key=lambda l: l[2][0])
            leaves = [other for other in leaves if other is not leaf]
            gain, f, t, left, right = leaf[2]
            nodes[leaf[3]] = (f, t, gain)
            leaves += [(rows, leaf[1] + 1, best(rows, g), (*leaf[3], side)) for side, rows in enumerate((left, right))]
        for rows, _, _, path in leaves:
            value = -soft(g[rows].sum()) / (len(rows) + s.reg_lambda) * s.learning_rate
            nodes[path] = value
            pred[rows] += value
        out.append(nodes)
    return out, pred


def paths(tree):
    out, open_nodes = {}, [(0, ())]
    while open_nodes:
        at, path = open_nodes.pop()
        if tree.feature[at] < 0:
            out[path] = tree.value[at]
        else:
            out[path] = (tree.feature[at], tree.threshold[at], tree.gain[at])
            open_nodes += [(tree.left[at], (*path, 0)), (tree.right[at], (*path, 1))]
    return out


@pytest.mark.parametrize("settings", [
    {"max_depth": 3}, {"max_depth": 2, "reg_alpha": 3.0, "reg_lambda": 5.0, "gamma": 0.5, "min_child_weight": 25.0},
    {"max_depth": -1, "num_leaves": 9, "reg_lambda": 0.0}, {"max_depth": 4, "num_leaves": 6, "min_child_weight": 10.0},
])
def test_trees_are_the_plain_ones(table, settings, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 2)
    pdf, df = table
    s = B.Settings(n_estimators=3, learning_rate=0.4, **settings)
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    cuts = B.cut_points(df, values(), 4)
    assert [len(c) for c in cuts] == [len(np.unique(x[:, i])) - 1 for i in range(4)]
    want, pred = plain(x, y, s, cuts)
    got = B.boost(df, values(), F.col("y"), 4, s)
    assert len(got.trees) == 3
    for one, other in zip(got.trees, want):
        one = paths(one)
        assert one.keys() == other.keys()
        for path, node in other.items():
            assert one[path] == pytest.approx(node, rel=1e-9, abs=1e-9)
    np.testing.assert_allclose(got.predict(x), pred, rtol=1e-9)
    if s.num_leaves:
        assert max(sum(f < 0 for f in t.feature) for t in got.trees) <= s.num_leaves


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(20_000).selectExpr("array(double(id), double(id % 5), double(0)) AS x")
    cuts = B.cut_points(df, F.col("x"), 3, 16)
    np.testing.assert_allclose(cuts[0], np.arange(1, 16) * 1250, atol=5)
    assert cuts[1].tolist() == [0, 1, 2, 3] and len(cuts[2]) == 0
    with pytest.raises(ValueError):
        B.cut_points(df, F.col("x"), 3, 300)


def test_samples_do_not_hang_on_the_layout(table):
    _, df = table
    s = B.Settings(n_estimators=2, subsample=0.6, colsample_bytree=0.5, max_depth=3)
    one, two = (B.boost(d, values(), F.col("y"), 4, s) for d in (df, df.repartition(3).orderBy("b")))
    assert [paths(t).keys() for t in one.trees] == [paths(t).keys() for t in two.trees]
    x = np.array([[3.0, 0.1, 2.5, 1.0], [30.0, -1.0, 7.5, 1.0]])
    np.testing.assert_allclose(one.predict(x), two.predict(x), rtol=1e-9)
    assert 0.5 < one.trees[0].rows[0] / 600 < 0.7 and len({f for t in one.trees for f in t.feature if f >= 0}) > 1


def test_boosting_stops_by_rows_held_out(table):
    pdf, df = table
    s = B.Settings(n_estimators=40, learning_rate=1.0, max_depth=3, reg_lambda=0.0, early_stopping_rounds=2)
    train, val = df.filter("part < 2"), df.filter("part = 2")
    stopped = B.boost(train, values(), F.col("y"), 4, s, val)
    x, y = pdf[pdf.part == 2][FEATURES].to_numpy(), pdf[pdf.part == 2]["y"].to_numpy()
    errors = [((B.Booster(stopped.base, stopped.trees[:i]).predict(x) - y) ** 2).mean() for i in range(len(stopped.trees) + 1)]
    assert 0 < len(stopped.trees) < 40 and int(np.argmin(errors)) == len(stopped.trees)


def test_a_leaf_wise_tree_takes_few_passes(table, monkeypatch):
    _, df = table
    asked = []
    plain_sums = B._sums
    monkeypatch.setattr(B, "_sums", lambda *a: (asked.append(a[2]), plain_sums(*a))[1])
    tree = B.boost(df, values(), F.col("y"), 4, B.Settings(n_estimators=1, max_depth=-1, num_leaves=24)).trees[0]
    assert sum(f < 0 for f in tree.feature) == 24 and len(asked) < 16


def test_edge_cases(spark, table):
    _, df = table
    with pytest.raises(ValueError):
        B.boost(df.limit(0), values(), F.col("y"), 4)
    one = B.boost(df.filter("y = y").limit(1), values(), F.col("y"), 4, B.Settings(n_estimators=3))
    assert one.trees == []
    hole = df.withColumn("y", F.when(F.col("part") > 0, F.col("y")))
    assert B.boost(hole, values(), F.col("y"), 4, B.Settings(n_estimators=1)).trees[0].rows[0] == 400


@pytest.mark.parametrize("kind, params", [
    ("xgboost", {"n_estimators": 5, "learning_rate": 0.6, "max_depth": 4}),
    ("gbdt", {"n_estimators": 5, "learning_rate": 0.6, "num_leaves": 8, "min_child_weight": 5.0}),
])
def test_models_of_histograms(spark, table, tmp_path, kind, params):
    _, df = table
    rows = df.withColumns({"pixel_id": F.monotonically_increasing_id(), "year": F.lit(2000), "b": F.when(F.col("b") != 0, F.col("b"))})
    model = L.fit(kind, rows, FEATURES, "y", **params)
    assert E.metrics(L.predict(model, rows), "y", "y_pred").first()["r2"] > 0.8
    L.save_model(model, str(tmp_path / kind))
    back = L.load_model(spark, str(tmp_path / kind))
    both = L.score(back, L.score(model, rows, "one"), "two")
    assert both.filter(F.abs(F.col("one") - F.col("two")) > 1e-12).isEmpty()
    with pytest.raises(ValueError):
        L.fit(kind, rows, FEATURES, "y", leaves=3)


def test_rows_are_not_written_after_the_last_round(table, monkeypatch):
    written = []
    plain_cut = B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda df: written.append(df) or plain_cut(df))
    monkeypatch.setattr(B, "REWRITE", 2)
    booster = B.boost(table[1], values(), F.col("y"), len(FEATURES), B.Settings(n_estimators=4, max_depth=2))
    assert len(booster.trees) == 4 and len(written) == 2  # the binned rows, and those after two rounds


def test_the_leafwise_query_does_all_rounds_and_leaves(spark, data, monkeypatch):
    import __spark_entry__ as entry

    asked, plain_boost = [], L.boost
    monkeypatch.setattr(L, "boost", lambda *a: (asked.append(a[4]), plain_boost(*a[:4], replace(a[4], n_estimators=1), *a[5:]))[1])
    assert entry.queries()["model_leafwise"](spark, data).count() == 3
    assert asked == [B.Settings(**L.DEFAULTS["gbdt"])] and (asked[0].n_estimators, asked[0].num_leaves) == (1200, 63)


@pytest.mark.parametrize("settings", [{"max_depth": -1, "num_leaves": 20, "min_child_weight": 5.0, "subsample": 0.8, "colsample_bytree": 0.6}, {"max_depth": 5}])
@pytest.mark.parametrize("near", [0, 30, 200])
def test_tasks_and_nodes_finished_by_them_change_no_tree(table, monkeypatch, settings, near):
    pdf, df = table
    s = B.Settings(n_estimators=5, learning_rate=0.3, **settings)
    want, passes, finished = B.boost(df, values(), F.col("y"), 4, s), [], []
    for name, value in (("TASK_BYTES", 300), ("BLOCK", 50), ("DIRECT", 2), ("REWRITE", 2), ("NEAR", near)):
        monkeypatch.setattr(B, name, value)
    plain_sums, plain_rows = B._sums, B._rows
    monkeypatch.setattr(B, "_sums", lambda *a: (passes.append(a[2]), plain_sums(*a))[1])
    monkeypatch.setattr(B, "_rows", lambda *a: (finished.append(a[1]), plain_rows(*a))[1])
    got = B.boost(df, values(), F.col("y"), 4, s)
    assert len(passes) >= 5 and (len(finished) >= 5) == (near > 0)
    for one, other in zip(got.trees, want.trees, strict=True):
        one, other = paths(one), paths(other)
        assert one.keys() == other.keys()
        for path, node in other.items():
            assert one[path] == pytest.approx(node, rel=1e-9, abs=1e-9)
