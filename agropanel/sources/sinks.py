"""Written panels, predictions, scores and models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.operators.metrics import METRIC_NAMES
from agropanel.runtime import remove_folder, replace_folder


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Snappy parquet, one folder per year; a panel without rows is an error. Returns the rows written.

    The panel is written to a sibling folder and counted there first, so an empty or
    failed one leaves what was at ``path`` as it was; a plain overwrite then puts the
    new folder in the old one's place. The rebalance hint lets adaptive execution
    split large years over many files and put small ones together. With
    ``mode="overwrite"`` and the session set to dynamic partition overwrite, only the
    written years are replaced.
    """
    spark = df.sparkSession
    draft = f"{path.rstrip('/')}-draft-{uuid.uuid4().hex}"
    try:
        df.hint("rebalance", "year").write.option("compression", "snappy").partitionBy("year").parquet(draft)
        written = spark.read.schema(df.schema).parquet(draft)
        rows = written.count()  # from the file footers
        if not rows:
            raise ValueError("the panel has no rows: check mask, sources, year range and missing-data rule")
        if mode == "overwrite" and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static":
            replace_folder(spark, draft, path)
        else:
            written.hint("rebalance", "year").write.mode(mode).option("compression", "snappy").partitionBy("year").parquet(path)
    finally:
        remove_folder(spark, draft)
    return rows


def write_layers(df: DataFrame, root: str, mode: str = "append") -> None:
    """Layer cells in single precision, one folder per dataset, year and month."""
    df = df.withColumn("value", F.col("value").cast("float"))
    df.hint("rebalance", "dataset", "year", "month").write.mode(mode).partitionBy("dataset", "year", "month").parquet(root)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _scores(prefix: str = "") -> Column:
    names = [f"{prefix}.`{m}`" if prefix else f"`{m}`" for m in METRIC_NAMES]
    return F.struct(*[F.col(n).alias(m) for n, m in zip(names, METRIC_NAMES)])


def metrics_document(
    overall: DataFrame,
    per_year: DataFrame,
    parts: DataFrame | None = None,
    **labels: str,
) -> DataFrame:
    """One row, one JSON text: overall scores, scores per year, per split, and labels.

    ``per_year`` has one row per calendar year, ``parts`` one per split.
    """
    years = per_year.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), _scores().alias("s")))))
    ).scalar()
    doc = {"overall": overall.agg(F.first(_scores())).scalar(), "per_year": years}
    if parts is not None:
        for part in ("val", "train"):
            doc[f"{part}_metrics"] = parts.filter(F.col("split") == part).agg(F.first(_scores())).scalar()
    doc.update({k: F.lit(v) for k, v in labels.items()})
    one = overall.sparkSession.range(1).select(*[c.alias(k) for k, c in doc.items()])
    return one.select(F.to_json(F.struct("*")).alias("value"))


def write_metrics(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the one-row document of ``metrics_document`` below ``path`` (named ``metrics_*.json``)."""
    document.coalesce(1).write.mode(mode).text(path)


def collect_runs(spark: SparkSession, root: str, metric: str = "acc@20%") -> DataFrame:
    """``path, value`` of one overall score in every ``metrics_*.json`` below ``root``.

    Files that are no JSON or lack the score are passed over.
    """
    text = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("path"))
        .filter(F.col("path").rlike(r"/metrics_[^/]*\.json(/|$)"))
    )
    score = F.get_json_object("value", f"$.overall['{metric}']")
    return text.select("path", score.try_cast("double").alias("value")).filter(
        F.col("value").isNotNull()
    )


def aggregate_runs(spark: SparkSession, root: str, metric: str = "acc@20%") -> dict[str, float]:
    """Number and mean of one overall score over all runs; none found is an error."""
    row = collect_runs(spark, root, metric).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).first()
    if not row["n"]:
        raise ValueError(f"no {metric!r} in any metrics file below {root}")
    return {"metric": metric, "n": row["n"], "mean": row["mean"]}


def prediction_columns(target: str, ids: Sequence[str]) -> list[str]:
    return [*ids, target, "y_pred", "residual"]
