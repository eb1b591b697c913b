"""The annual table: one row per pixel and year."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.vocabulary import PIXEL_YEAR

MODES = ("mean", "mean_sum")
EXTRA_STATS = {"std": F.stddev_pop, "min": F.min, "max": F.max}


def year_before(years: int = 1):
    """Window that holds exactly the row ``years`` earlier of the same pixel, or nothing.

    A range over the year value does not step over missing years as ``lag`` would.
    """
    return Window.partitionBy("pixel_id").orderBy("year").rangeBetween(-years, -years)


def is_summed(column: str, mode: str, sum_features: Sequence[str], sum_keywords: Sequence[str]) -> bool:
    return mode == "mean_sum" and (column in set(sum_features) or any(k in column for k in sum_keywords))


def aggregate_yearly(
    df: DataFrame,
    dynamic: Sequence[str],
    yearly: Sequence[str],
    target: str,
    aggregate_to_year: str = "mean",
    sum_features: Sequence[str] = (),
    sum_keywords: Sequence[str] = ("precip",),
    static_cols: Sequence[str] = (),
    seasonal_quartiles: bool = True,
    extra_stats: Sequence[str] = (),
    include_prev_year_yield: bool = True,
    lag_years: int = 0,
) -> DataFrame:
    """Monthly rows to pixel-years, with raw (not yet derived) feature columns.

    Column names: ``c`` (mean or sum), ``c_q1`` to ``c_q4`` (mean per calendar
    quarter), ``c_std`` and so on, ``c_lag1`` and so on, ``prev_<target>``. Yearly,
    static and target columns are constant within a pixel-year.
    """
    if aggregate_to_year not in MODES:
        raise ValueError(f"unknown aggregation {aggregate_to_year!r}; known: {', '.join(MODES)}")
    unknown = set(extra_stats) - set(EXTRA_STATS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    static = [c for c in dict.fromkeys(static_cols) if c in df.columns]
    aggs: list[Column] = []
    for c in dynamic:
        summed = is_summed(c, aggregate_to_year, sum_features, sum_keywords)
        aggs.append((F.sum(c) if summed else F.avg(c)).alias(c))
        if seasonal_quartiles:
            quarter = F.ceil(F.col("month") / 3)
            aggs += [F.avg(F.when(quarter == q, F.col(c))).alias(f"{c}_q{q}") for q in range(1, 5)]
        aggs += [EXTRA_STATS[s](c).alias(f"{c}_{s}") for s in extra_stats]
    aggs += [F.max(c).alias(c) for c in [*yearly, *static, target]]
    table = df.groupBy(*PIXEL_YEAR).agg(*aggs)

    earlier = {}
    if include_prev_year_yield:
        earlier[f"prev_{target}"] = F.max(target).over(year_before(1))
    for i in range(1, lag_years + 1):
        for c in dynamic:
            earlier[f"{c}_lag{i}"] = F.max(c).over(year_before(i))
    return table.withColumns(earlier) if earlier else table


def quoted(column: str) -> str:
    return f"`{column}`"


def derived_columns(
    columns: Sequence[str],
    add_fertilizer_interactions: bool = False,
    log1p_features: Sequence[str] = (),
    place: Callable[[str], str] = quoted,
) -> dict[str, str]:
    """New and changed columns as SQL expressions over the raw ones.

    Products of every two fertilizers, then log(1 + c), negative values as 0, for
    columns that start with a listed prefix. Kept as expressions so that a changed
    fertilizer level flows through them. ``place`` tells where a raw column is found.
    """
    derived: dict[str, str] = {}
    if add_fertilizer_interactions:
        ferts = [c for c in columns if c.startswith("fert_")]
        derived = {f"{a}_x_{b}": f"{place(a)} * {place(b)}" for i, a in enumerate(ferts) for b in ferts[i + 1:]}
    for c in [*columns, *derived]:
        if any(c.startswith(p) for p in log1p_features):
            value = derived.get(c, place(c))
            derived[c] = f"log1p(if({value} < 0, 0, {value}))"
    return derived


def derive_features(
    df: DataFrame, add_fertilizer_interactions: bool = False, log1p_features: Sequence[str] = ()
) -> DataFrame:
    derived = derived_columns(df.columns, add_fertilizer_interactions, log1p_features)
    return df.withColumns({c: F.expr(e) for c, e in derived.items()}) if derived else df


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def feature_columns(columns: Sequence[str], target: str, ids: Sequence[str] = PIXEL_YEAR) -> list[str]:
    """All but the target and the ids; none left is an error."""
    cols = [c for c in columns if c != target and c not in set(ids)]
    if not cols:
        raise ValueError("no feature column left")
    return cols


def model_features(columns: Sequence[str], target: str, derive: Mapping) -> list[str]:
    """Feature names of an annual table once its derived columns are added."""
    return feature_columns(list(dict.fromkeys([*columns, *derived_columns(columns, **derive)])), target)


def feature_terms(
    columns: Sequence[str], features: Sequence[str], derive: Mapping, place: Callable[[str], str] = quoted
) -> list[str]:
    """SQL of each feature of a row: float precision, 0 where missing."""
    derived = derived_columns(columns, **derive, place=place)
    return [f"double(float(coalesce({derived.get(c) or place(c)}, 0)))" for c in features]


def feature_array(
    columns: Sequence[str], features: Sequence[str], derive: Mapping, place: Callable[[str], str] = quoted
) -> Column:
    return F.expr(f"array({', '.join(feature_terms(columns, features, derive, place))})")


def feature_vector(
    columns: Sequence[str], features: Sequence[str], derive: Mapping, place: Callable[[str], str] = quoted
) -> Column:
    """Features of a row as one vector: float precision, 0 where missing."""
    return array_to_vector(feature_array(columns, features, derive, place))
