"""Train / validation / test splits and quantile trimming of the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions.hashing import spatial_fold
from agropanel.functions.order_stats import quantile_values, trim_values


class Split(NamedTuple):
    train: DataFrame
    val: DataFrame
    test: DataFrame


def labelled(split: Split, parts: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of the parts under each other, named in ``split``; a row in two parts appears twice."""
    named = [getattr(split, part).withColumn("split", F.lit(part)) for part in parts]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out


def threshold_rules(
    train_max_year: int,
    val_year: int,
    test_year_min: int,
    test_year_max: int | None = None,
    train_min_year: int | None = None,
) -> dict[str, Column]:
    year = F.col("year")
    train, test = year <= train_max_year, year >= test_year_min
    if train_min_year is not None:
        train = train & (year >= train_min_year)
    if test_year_max is not None:
        test = test & (year <= test_year_max)
    return {"train": train, "val": year == val_year, "test": test}


def leaveout_rules(val_year: int, test_year: int) -> dict[str, Column]:
    year = F.col("year")
    return {
        "train": ~year.isin(val_year, test_year),
        "val": year == val_year,
        "test": year == test_year,
    }


def _apply(df: DataFrame, rules: Mapping[str, Column]) -> Split:
    return Split(*[df.filter(rules[name]) for name in ("train", "val", "test")])


def temporal_split(df: DataFrame, train_max_year: int, val_year: int, test_year_min: int, **bounds: int | None) -> Split:
    """Three independent year filters: a row may fall in more than one part."""
    return _apply(df, threshold_rules(train_max_year, val_year, test_year_min, **bounds))


def temporal_leaveout(df: DataFrame, val_year: int, test_year: int) -> Split:
    """One year for validation, one for the test, all others for training."""
    return _apply(df, leaveout_rules(val_year, test_year))


def _spatial_parts(df: DataFrame, kfolds: int, fold_index: int) -> tuple[Column, Column]:
    held_out = spatial_fold(F.col("pixel_id"), kfolds) == fold_index
    # The distinct years are a calendar, so their median is one short aggregate.
    years = df.filter(~held_out).select("year").distinct()
    val_year = years.agg(F.floor(F.median("year")).cast("int")).scalar()
    return held_out, F.col("year") == val_year


def spatial_kfold(df: DataFrame, kfolds: int = 5, fold_index: int = 0) -> Split:
    """Pixels of one fold are the test; of the rest, the median year validates."""
    held_out, middle = _spatial_parts(df, kfolds, fold_index)
    return Split(df.filter(~held_out & ~middle), df.filter(~held_out & middle), df.filter(held_out))


def tag_parts(df: DataFrame, rules: Mapping[str, Column], name: str = "split") -> DataFrame:
    """One row per part a row belongs to, from a single pass over ``df``."""
    labels = F.array(*[F.when(rule, F.lit(part)) for part, rule in rules.items()])
    return df.withColumn(name, F.explode(F.array_compact(labels)))


def spatial_rules(df: DataFrame, kfolds: int = 5, fold_index: int = 0) -> dict[str, Column]:
    held_out, middle = _spatial_parts(df, kfolds, fold_index)
    return {"train": ~held_out & ~middle, "val": ~held_out & middle, "test": held_out}


def split_panel(df: DataFrame, kind: str, **settings) -> Split:
    """``temporal`` (strategy ``threshold`` or ``leaveout``) or ``spatial``; other names are refused."""
    if kind == "spatial":
        return spatial_kfold(df, **settings)
    if kind != "temporal":
        raise ValueError(f"unknown split type {kind!r}")
    strategy = settings.pop("strategy", "threshold")
    if strategy == "leaveout":
        return temporal_leaveout(df, **settings)
    if strategy != "threshold":
        raise ValueError(f"unknown temporal strategy {strategy!r}")
    return temporal_split(df, **settings)


@dataclass(frozen=True)
class Fold:
    val_year: int
    test_year: int

    @property
    def name(self) -> str:
        return f"val{self.val_year}_test{self.test_year}"


def temporal_cv(first_val: int = 2002, last_val: int = 2014) -> list[Fold]:
    """Each year validates once, the year after it is the test."""
    return [Fold(y, y + 1) for y in range(first_val, last_val + 1)]


def fold_sizes(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """Rows per fold and part. Years are counted once; folds only regroup those counts."""
    per_year = df.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    plan = F.array(*[
        F.struct(F.lit(f.name).alias("fold"), F.lit(f.val_year).alias("v"), F.lit(f.test_year).alias("t")) for f in folds
    ])
    part = (
        F.when(F.col("year") == F.col("f.v"), "val").when(F.col("year") == F.col("f.t"), "test").otherwise("train")
    )
    return (
        per_year.withColumn("f", F.explode(plan))
        .groupBy(F.col("f.fold").alias("fold"), part.alias("split"))
        .agg(F.sum("n").alias("rows"))
    )


def quantile_trim(
    split: Split,
    target: str,
    lo: float | None,
    hi: float | None,
    sequential: bool = True,
) -> Split:
    """Drop rows outside training quantiles from every part.

    ``sequential`` takes the upper threshold from the training rows that are left
    after the lower one; otherwise both come from the untrimmed training rows.
    The thresholds are numbers, so the filters can reach the scan.
    """
    use_lo, use_hi = bool(lo) and lo > 0, bool(hi) and hi < 1
    y = F.col(target)
    if not sequential and use_lo and use_hi:
        low, high = quantile_values(split.train, target, [lo, hi])
        return Split(*[part.filter((y >= low) & (y <= high)) for part in split])
    if use_lo and use_hi:
        low, high = trim_values(split.train, target, lo, hi)
        return Split(*[part.filter((y >= low) & (y <= high)) for part in split])
    if use_lo:
        low = quantile_values(split.train, target, [lo])[0]
        return Split(*[part.filter(y >= low) for part in split])
    if use_hi:
        high = quantile_values(split.train, target, [hi])[0]
        return Split(*[part.filter(y <= high) for part in split])
    return split
