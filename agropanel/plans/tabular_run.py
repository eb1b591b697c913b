"""Clean, aggregate, split, trim, fit, score and write: one tabular run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.operators.annual import aggregate_yearly, drop_missing_target, model_features
from agropanel.operators.clean import Roles, clean, feature_set, project
from agropanel.operators.metrics import metrics, metrics_by_year, parity_range, residuals
from agropanel.operators.models import YieldModel, fit, predict, save_model
from agropanel.operators.splits import Split, labelled, quantile_trim, split_panel
from agropanel.runtime import cut_lineage
from agropanel.sources.sinks import metrics_document, prediction_columns, write_csv, write_metrics
from agropanel.vocabulary import PIXEL_YEAR

# The enhanced preprocessing shared by the tabular models.
ENHANCED = {
    "aggregate_to_year": "mean_sum",
    "sum_features": ["chirps_precip"],
    "sum_keywords": ["precip"],
    "include_prev_year_yield": True,
    "seasonal_quartiles": True,
    "extra_stats": ["std", "min", "max"],
    "lag_years": 1,
}
ENHANCED_DERIVED = {"add_fertilizer_interactions": True, "log1p_features": ["fert_", "chirps_precip"]}


@dataclass(frozen=True)
class RunSettings:
    """What one run does; the defaults are the common dataset settings."""

    target: str
    kind: str = "elasticnet"
    features: str = "all"
    split: Mapping = field(default_factory=lambda: {
        "kind": "temporal", "train_max_year": 2012, "val_year": 2013, "test_year_min": 2014,
    })
    min_yield: float | None = 1e-6
    any_fertilizer: bool = False
    trim: tuple[float | None, float | None] = (0.005, 0.995)
    annual: Mapping = field(default_factory=dict)
    derive: Mapping = field(default_factory=dict)
    static_cols: Sequence[str] = ()
    log_transform: bool = False
    log_offset: float = 1.0
    model: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    """``scored`` is a written table: split, ids, target, y_pred, residual."""

    model: YieldModel
    annual: DataFrame
    split: Split
    scored: DataFrame

    def predictions(self, part: str = "test") -> DataFrame:
        return self.scored.filter(F.col("split") == part).drop("split")

    def metrics(self, part: str = "test") -> DataFrame:
        return metrics(self.predictions(part), self.model.target, "y_pred")

    def metrics_by_split(self) -> DataFrame:
        return metrics(self.scored, self.model.target, "y_pred", ["split"])

    def metrics_by_year(self) -> DataFrame:
        return metrics_by_year(self.predictions(), self.model.target, "y_pred")

    def residuals_by_year(self) -> DataFrame:
        return residuals(self.predictions(), self.model.target, "y_pred")

    def parity(self) -> DataFrame:
        return parity_range(self.predictions(), self.model.target, "y_pred")

    def write(self, path: str, crop: str) -> None:
        """Predictions as CSV, scores as JSON, residuals as CSV and the model."""
        label = f"{crop}_{self.model.kind}"
        columns = prediction_columns(self.model.target, PIXEL_YEAR)
        write_csv(self.predictions().select(*columns), f"{path}/preds_{label}_test")
        write_csv(self.residuals_by_year(), f"{path}/residuals_by_year_{label}")
        document = metrics_document(
            self.metrics(), self.metrics_by_year(), self.metrics_by_split(), config_name=label
        )
        write_metrics(document, f"{path}/metrics_{label}.json")
        save_model(self.model, f"{path}/model_{label}")


def annual_table(panel: DataFrame, settings: RunSettings) -> DataFrame:
    """Cleaned panel to the annual table, features still in raw units."""
    roles: Roles = feature_set(settings.features, panel.columns)
    static = list(dict.fromkeys([*roles.static, *settings.static_cols]))
    slim = project(panel, Roles(roles.dynamic, roles.yearly, static), settings.target)
    kept = clean(slim, settings.target, roles.yearly, True, settings.min_yield, settings.any_fertilizer)
    table = aggregate_yearly(
        kept, roles.dynamic, roles.yearly, settings.target, static_cols=static, **settings.annual
    )
    return drop_missing_target(table, settings.target)


def run(panel: DataFrame, settings: RunSettings) -> Run:
    """The annual table is written once; split, thresholds and fit read it from there.

    So are the predictions: every score and report reads them, none predicts again.
    """
    annual = cut_lineage(annual_table(panel, settings))
    if annual.isEmpty():
        raise ValueError("the annual table is empty: check cleaning and aggregation settings")
    split = split_panel(annual, **settings.split)
    split = quantile_trim(split, settings.target, *settings.trim)
    features = model_features(annual.columns, settings.target, settings.derive)
    model = fit(
        settings.kind, split.train, features, settings.target, settings.log_transform, settings.log_offset,
        settings.derive, **settings.model,
    )
    scored = predict(model, labelled(split)).select("split", *prediction_columns(settings.target, PIXEL_YEAR))
    return Run(model, annual, split, cut_lineage(scored))
