"""Regression scores of a prediction table, overall or per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions.order_stats import exact_quantiles, null_safe_join, quantile_values, quantiles_of, ranked
from agropanel.runtime import cut_lineage

# Names and order of the scores.
METRIC_NAMES = [
    "rmse", "mae", "r2", "mape%", "smape%", "bias", "nrmse_mean", "nrmse_iqr", "pearson_r",
    "spearman_rho", "explained_variance", "acc@10%", "acc@20%", "acc@30%", "n",
]


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL where a side is constant (``corr`` would raise)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _scores(y: Column, p: Column) -> dict[str, Column]:
    """All scores that one mergeable aggregate can give."""
    e = p - y
    share = F.abs(e) / F.greatest(F.abs(y), F.lit(1e-6))
    count = F.count(F.lit(1))
    rmse = F.sqrt(F.avg(e * e))

    def within(pct: int) -> Column:
        return F.avg((share * 100 <= pct).cast("double")) * 100

    flat = (count < 2) | (F.stddev_pop(y) < 1e-12) | (F.stddev_pop(p) < 1e-12)
    return {
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "r2": 1 - F.sum(e * e) / F.greatest(F.var_pop(y) * count, F.lit(1e-12)),
        "mape%": F.avg(share) * 100,
        "smape%": F.avg(2 * F.abs(e) / F.greatest(F.abs(y) + F.abs(p), F.lit(1e-6))) * 100,
        "bias": F.avg(e),
        "nrmse_mean": F.try_divide(rmse, F.avg(y) + 1e-8),
        "pearson_r": F.when(flat, 0.0).otherwise(correlation(y, p)),
        "explained_variance": 1 - F.var_pop(y - p) / F.greatest(F.var_pop(y), F.lit(1e-12)),
        "acc@10%": within(10),
        "acc@20%": within(20),
        "acc@30%": within(30),
        "n": count,
    }


def _by_iqr(rmse: Column, quartiles: Column) -> Column:
    return rmse / F.greatest(quartiles[1] - quartiles[0], F.lit(1e-8))


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One row of scores per key; a key without any pair gives no row.

    Equal pairs are counted and written once. The pairs are dealt to ranges of the
    truth, then, with their rank in it, to ranges of the prediction, see ``ranked`` in
    ``functions/order_stats.py``: no task holds a group, and no rank is joined by value.
    """
    by = list(by)
    pairs = df.select(
        *by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")
    ).filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    # A key that is no literal: joins on a literal would lose their condition.
    keyed = pairs if by else pairs.withColumn("_all", F.hash("_y").bitwiseAND(F.lit(0)))
    keys = by or ["_all"]
    base = keyed.groupBy(*keys).agg(*[c.alias(name) for name, c in _scores(F.col("_y"), F.col("_p")).items()])
    rows = cut_lineage(keyed.groupBy(*keys, "_y", "_p").agg(F.count(F.lit(1)).alias("_w")))
    of_y = ranked(rows, "_y", "_p", keys, "_w")
    places = of_y.select(*keys, "_y", F.col("_w").alias("_c"), "_first", "n")
    quartiles = quantiles_of(places, "_y", [0.25, 0.75], keys).select(*keys, "quantiles")
    of_p = ranked(of_y.select(*rows.columns, F.col("_rank").alias("_ry")), "_p", "_y", keys, "_w")
    spearman = _spearman(of_p.withColumnRenamed("_rank", "_rp"), keys)
    out = null_safe_join(null_safe_join(base, quartiles, keys, "left"), spearman, keys, "left")
    out = out.withColumn("nrmse_iqr", _by_iqr(F.col("rmse"), F.col("quantiles")))
    return out.select(*by, *[F.col(f"`{m}`") for m in METRIC_NAMES])


def _spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank correlation per key of weighted pairs with both their ranks."""
    # Ranks of n rows always average (n + 1) / 2, so plain sums of products are enough.
    ry, rp, w = F.col("_ry"), F.col("_rp"), F.col("_w")
    n = F.sum(w)
    centre = n * ((n + 1) / 2) * ((n + 1) / 2)
    rho = F.try_divide(
        F.sum(w * ry * rp) - centre, F.sqrt(F.sum(w * ry * ry) - centre) * F.sqrt(F.sum(w * rp * rp) - centre)
    )
    flat = (F.min("_y") == F.max("_y")) | (F.min("_p") == F.max("_p"))
    return rows.groupBy(*keys).agg(F.when(n < 2, 0.0).when(flat, F.lit(None)).otherwise(rho).alias("spearman_rho"))


def metrics_by_year(df: DataFrame, y: str, p: str, year: str = "year") -> DataFrame:
    """Scores per year, best first."""
    return metrics(df, y, p, [year]).orderBy("rmse", year)


def residuals(df: DataFrame, y: str, p: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """Mean, median, sample deviation and count of prediction minus truth per key."""
    rows = df.select(*by, (F.col(p).cast("double") - F.col(y).cast("double")).alias("res"))
    rows = rows.filter(F.col("res").isNotNull())
    moments = rows.groupBy(*by).agg(
        F.avg("res").alias("mean"),
        F.when(F.count("res") > 1, F.stddev_samp("res")).alias("std"),
        F.count("res").alias("count"),
    )
    middle = exact_quantiles(rows, "res", [0.5], by).select(*by, F.col("quantiles")[0].alias("median"))
    return null_safe_join(moments, middle, by, "inner").select(*by, "mean", "median", "std", "count")


def parity_range(df: DataFrame, y: str, p: str) -> DataFrame:
    """1st and 99th percentile of truth and prediction pooled."""
    pooled = df.select(F.explode(F.array(F.col(y).cast("double"), F.col(p).cast("double"))).alias("value"))
    pooled = pooled.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    low, high = F.col("quantiles")[0], F.col("quantiles")[1]
    return exact_quantiles(pooled, "value", [0.01, 0.99]).select(low.alias("lo"), high.alias("hi"))


def parity_bounds(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    pooled = df.select(F.explode(F.array(F.col(y).cast("double"), F.col(p).cast("double"))).alias("value"))
    low, high = quantile_values(pooled, "value", [0.01, 0.99])
    return low, high


def best_run(runs: DataFrame, run: str, order: str, score: str = "rmse", gain: float = 1e-6) -> DataFrame:
    """The run kept when runs are looked at in order and one replaces the best
    so far only by a gain above ``gain``.

    ``runs`` holds one row per round or sweep job, never data rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s"), F.col(run).alias("r"))))
    first = F.struct(F.lit(float("inf")).alias("s"), F.lit(None).cast(runs.schema[run].dataType).alias("r"))
    better = lambda best, new: F.when(
        new["s"] < best["s"] - gain, F.struct(new["s"].cast("double").alias("s"), new["r"].alias("r"))
    ).otherwise(best)
    kept = runs.agg(F.aggregate(ordered, first, better).alias("b"))
    return kept.select(F.col("b.r").alias(run), F.col("b.s").alias(score))
