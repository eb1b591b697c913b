"""From a panel to the monthly sequences of a run: clean, split, trim, thin, standardise, build."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from agropanel.operators.clean import Roles, clean, feature_set, project
from agropanel.operators.normalise import normalise
from agropanel.operators.sampling import downsample
from agropanel.operators.sequences import split_sequences
from agropanel.operators.splits import Split, labelled, quantile_trim, split_panel
from agropanel.runtime import cut_lineage


@dataclass(frozen=True)
class SequenceSettings:
    """What one run does; the defaults are the common dataset settings."""

    target: str
    features: str = "all"
    dynamic: Sequence[str] | None = None
    split: Mapping = field(default_factory=lambda: {
        "kind": "temporal", "train_max_year": 2012, "val_year": 2013, "test_year_min": 2014,
    })
    min_yield: float | None = 1e-6
    any_fertilizer: bool = False
    trim: tuple[float | None, float | None] = (0.005, 0.995)
    per_year_max: int | None = None
    stratify: str = "yield_decile"
    normalisation: str = "zscore_global"
    static_cols: Sequence[str] = ()
    sequences: Mapping = field(default_factory=dict)


def run_sequences(panel: DataFrame, settings: SequenceSettings) -> Split:
    """Sequences of train, validation and test.

    Both trim thresholds, the thinning and the z-scores come from training rows only;
    the statistics are those of the rows that thinning left. The cleaned panel and
    the thinned training rows are written once.
    """
    roles = feature_set(settings.features, panel.columns)
    dynamic = list(settings.dynamic or roles.dynamic)
    static = list(dict.fromkeys([*roles.static, *settings.static_cols]))
    slim = project(panel, Roles(dynamic, roles.yearly, static), settings.target)
    kept = cut_lineage(clean(slim, settings.target, roles.yearly, True, settings.min_yield, settings.any_fertilizer))
    split = quantile_trim(split_panel(kept, **settings.split), settings.target, *settings.trim, sequential=False)
    train = split.train
    if settings.per_year_max:
        train = cut_lineage(downsample(train, settings.target, settings.per_year_max, settings.stratify))
    parts = [normalise(part, train, dynamic, settings.normalisation) for part in (train, split.val, split.test)]
    built = split_sequences(Split(*parts), dynamic, roles.yearly, settings.target, static_cols=static, **settings.sequences)
    return Split(*built)


def write_sequences(parts: Split, path: str) -> None:
    """The samples of all parts in one table, a folder per part."""
    labelled(parts).write.mode("overwrite").partitionBy("split").parquet(path)
