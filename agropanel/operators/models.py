"""Yield models on the annual table, by the usual single-node definitions.

Linear models are solved from sufficient statistics of one pass (``linear.py``); forests
and first-order boosting are Spark ML estimators; regularised and leaf-wise boosting are
grown from distributed histograms (``boosting.py``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.functions.targets import exp_target, log_target
from agropanel.operators import linear
from agropanel.operators.annual import feature_array, feature_terms, feature_vector, quoted
from agropanel.operators.boosting import Booster, Settings, boost
from agropanel.operators.metrics import METRIC_NAMES, metrics
from agropanel.operators.moments import moments
from agropanel.operators.splits import Fold, labelled, quantile_trim, temporal_leaveout
from agropanel.runtime import checkpoint_folder

LINEAR_KINDS = ("linear", "elasticnet")
HISTOGRAM_KINDS = ("xgboost", "gbdt")
BOOSTED_KINDS = ("gbrt", *HISTOGRAM_KINDS)
KINDS = (*LINEAR_KINDS, "random_forest", *BOOSTED_KINDS)

# Settings used where a run gives none.
DEFAULTS = {
    "linear": {"alpha": 1.0, "fit_intercept": True},
    "elasticnet": {"alpha": 1.0, "l1_ratio": 0.5, "fit_intercept": True, "max_iter": 2000, "tol": 1e-4},
    "random_forest": {"n_estimators": 500, "max_depth": 30, "min_samples_leaf": 3, "random_state": 1337},
    "gbrt": {"n_estimators": 800, "learning_rate": 0.05, "max_depth": 3, "subsample": 0.9, "random_state": 1337},
    "xgboost": {
        "n_estimators": 800, "learning_rate": 0.05, "max_depth": 6, "subsample": 0.8, "colsample_bytree": 0.8,
        "reg_lambda": 1.0, "reg_alpha": 0.0, "gamma": 0.0, "min_child_weight": 1.0, "max_bins": 256, "random_state": 1337,
    },
    "gbdt": {
        "n_estimators": 1200, "learning_rate": 0.03, "num_leaves": 63, "max_depth": -1, "subsample": 0.8, "colsample_bytree": 0.8,
        "reg_lambda": 0.0, "reg_alpha": 0.0, "gamma": 0.0, "min_child_weight": 20.0, "max_bins": 256, "random_state": 1337,
    },
}


@dataclass(frozen=True)
class YieldModel:
    """A fitted model with all that a later prediction needs.

    Linear kinds have an intercept and weights of the raw features, histogram kinds
    their trees, others a pipeline.
    """

    pipeline: PipelineModel | None
    kind: str
    features: list[str]
    target: str
    log_transform: bool = False
    log_offset: float = 1.0
    derive: dict = field(default_factory=dict)
    weights: list[float] | None = None
    intercept: float = 0.0
    booster: Booster | None = None


def _estimator(kind: str, p: Mapping):
    common = {"featuresCol": "_x", "labelCol": "_label", "predictionCol": "_z"}
    if kind == "random_forest":
        return RandomForestRegressor(
            **common, numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]), featureSubsetStrategy="all",
            seed=int(p["random_state"]), cacheNodeIds=True, checkpointInterval=10,
        )
    return GBTRegressor(
        **common, maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]), maxDepth=int(p["max_depth"]),
        subsamplingRate=float(p["subsample"]), seed=int(p["random_state"]), checkpointInterval=10,
    )


def fit(
    kind: str,
    train: DataFrame,
    features: Sequence[str],
    target: str,
    log_transform: bool = False,
    log_offset: float = 1.0,
    derive: Mapping | None = None,
    val: DataFrame | None = None,
    **params,
) -> YieldModel:
    """Fit one of ``KINDS`` on annual rows; ``derive`` are the settings of ``derive_features``.

    With ``val`` the boosted kinds stop once its error no longer falls.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(KINDS)}")
    unknown = sorted(params.keys() - DEFAULTS[kind].keys())
    if unknown:
        raise ValueError(f"{kind!r} has no setting {', '.join(unknown)}; known: {', '.join(DEFAULTS[kind])}")
    settings = {**DEFAULTS[kind], **params}
    derive = dict(derive or {})
    features = list(features)
    checkpoint_folder(train.sparkSession)
    label = transformed(target, log_transform, log_offset)
    if val is not None and kind not in BOOSTED_KINDS:
        raise ValueError(f"{kind!r} takes no validation rows")
    if kind in LINEAR_KINDS:
        found = moments(*label_last(train, features, label, derive), [])
        if not found:
            raise ValueError("no training row left")
        problem = linear.Problem.of(found[()])
        weights, intercept = problem.raw(solve_linear(kind, problem, settings), settings["fit_intercept"])
        return YieldModel(None, kind, features, target, log_transform, log_offset, derive, weights.tolist(), intercept)
    if kind in HISTOGRAM_KINDS:
        trees = boost(train, feature_array(train.columns, features, derive), label, len(features), Settings(**settings), val)
        return YieldModel(None, kind, features, target, log_transform, log_offset, derive, booster=trees)
    columns = [label.alias("_label"), feature_vector(train.columns, features, derive).alias("_x")]
    ready = train.select(*columns)
    if ready.isEmpty():
        raise ValueError("no training row left")
    estimator = _estimator(kind, settings)
    if val is not None:
        held_out = val.select(*columns, F.lit(True).alias("_held_out"))
        ready = ready.withColumn("_held_out", F.lit(False)).unionByName(held_out)
        estimator = estimator.setParams(validationIndicatorCol="_held_out", validationTol=1e-6)
    return YieldModel(Pipeline(stages=[estimator]).fit(ready), kind, features, target, log_transform, log_offset, derive)


def transformed(target: str, log_transform: bool, log_offset: float) -> Column:
    label = F.col(target).cast("double")
    return log_target(label, log_offset) if log_transform else label


def label_last(rows: DataFrame, features: Sequence[str], label: Column, derive: Mapping) -> tuple[DataFrame, Column]:
    """The rows that have a label, and their features with the label at the end."""
    return rows.filter(label.isNotNull()), F.array_append(feature_array(rows.columns, features, derive), label)


def solve_linear(kind: str, problem: linear.Problem, p: Mapping, start=None):
    """Standardised weights of one setting."""
    if kind == "linear":
        return linear.ridge(problem, float(p["alpha"]))
    return linear.elastic_net(
        problem, float(p["alpha"]), float(p["l1_ratio"]), start, int(p["max_iter"]), float(p["tol"]), bool(p["fit_intercept"])
    )


def score(
    model: YieldModel,
    df: DataFrame,
    out: str = "y_pred",
    columns: Sequence[str] | None = None,
    place: Callable[[str], str] = quoted,
) -> DataFrame:
    """Add the prediction in target units, leaving the columns of ``df`` as they are.

    ``columns`` and ``place`` name the raw annual columns and where they are, if not at the top.
    """
    if model.weights is not None:
        terms = feature_terms(columns or df.columns, model.features, model.derive, place)
        total = " + ".join([f"{model.intercept!r}D", *[f"({w!r}D * {t})" for w, t in zip(model.weights, terms) if w]])
        z = df.withColumn("_z", F.expr(total))
    elif model.booster is not None:
        z = df.withColumn("_z", model.booster.column(feature_array(columns or df.columns, model.features, model.derive, place)))
    else:
        vector = feature_vector(columns or df.columns, model.features, model.derive, place)
        z = model.pipeline.transform(df.withColumn("_x", vector))
    pred = exp_target(F.col("_z"), model.log_offset) if model.log_transform else F.col("_z")
    return z.select(*df.columns, pred.alias(out))


def predict(model: YieldModel, df: DataFrame) -> DataFrame:
    """Prediction and residual (prediction minus truth)."""
    return score(model, df).withColumn("residual", F.col("y_pred") - F.col(model.target).cast("double"))


def save_model(model: YieldModel, path: str) -> None:
    """Settings, weights or trees among them, and the pipeline where there is one."""
    meta = _settings(model)
    if model.pipeline is not None:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def _settings(model: YieldModel) -> dict:
    return {
        "kind": model.kind, "features": model.features, "target": model.target,
        "log_transform": model.log_transform, "log_offset": model.log_offset, "derive": model.derive,
        "weights": model.weights, "intercept": model.intercept, "booster": model.booster and model.booster.to_dict(),
    }


def load_model(spark: SparkSession, path: str) -> YieldModel:
    meta = json.loads(spark.read.text(f"{path}/settings").first()[0])
    meta["booster"] = Booster.of_dict(meta["booster"]) if meta.get("booster") else None
    # Linear and histogram models are in their settings; older files have a pipeline for them.
    inside = meta.get("weights") is not None or meta["booster"] is not None
    return YieldModel(None if inside else PipelineModel.load(f"{path}/pipeline"), **meta)


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed settings."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sweep(
    annual: DataFrame,
    features: Sequence[str],
    target: str,
    kind: str,
    grid: Mapping[str, Sequence],
    folds: Sequence[Fold],
    parallel: int = 4,
    trim: tuple[float | None, float | None] = (None, None),
    **settings,
) -> DataFrame:
    """Validation and test scores of every combination of settings and folds, trimmed as ``quantile_trim`` does.

    Linear kinds are solved together from one pass, see ``sweeps.py``. Fits of the
    others are distributed jobs of their own; a few run side by side so that the
    cluster stays busy. ``annual`` should be written or cached beforehand.
    """
    if kind in LINEAR_KINDS:
        from agropanel.operators.sweeps import linear_sweep

        return linear_sweep(annual, features, target, kind, grid, folds, trim, **settings)
    spark = annual.sparkSession

    def run(fold: Fold, params: dict) -> list[tuple]:
        split = quantile_trim(temporal_leaveout(annual, fold.val_year, fold.test_year), target, *trim)
        model = fit(kind, split.train, features, target, **settings, **params)
        scores = metrics(predict(model, labelled(split, ("val", "test"))), target, "y_pred", ["split"])
        return [
            (fold.name, json.dumps(params, sort_keys=True), row["split"], *[row[m] for m in METRIC_NAMES])
            for row in scores.collect()
        ]

    jobs = list(itertools.product(folds, parameter_grid(grid)))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = [r for rows in pool.map(lambda job: run(*job), jobs) for r in rows]
    scores = ", ".join(f"`{m}` {'BIGINT' if m == 'n' else 'DOUBLE'}" for m in METRIC_NAMES)
    return spark.createDataFrame(done, f"fold STRING, params STRING, split STRING, {scores}")
