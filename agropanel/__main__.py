"""Command line: layers, mask, panel, diagnostics, sequences, training, recommendations, run scores.

    spark-submit --py-files ... agropanel build --crop wheat --layers ... --out ...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from agropanel.operators import diagnostics as Q
from agropanel.operators.grid import GridSpec, grid_spec, land_mask
from agropanel.operators.models import DEFAULTS, KINDS, load_model
from agropanel.operators.recommend import recommend, response_bounds
from agropanel.plans.layer_export import monthly_layers
from agropanel.plans.panel_build import build_panel
from agropanel.plans.sequence_run import SequenceSettings, run_sequences, write_sequences
from agropanel.plans.tabular_run import ENHANCED, ENHANCED_DERIVED, RunSettings, annual_table, run
from agropanel.sources.sinks import aggregate_runs, write_csv, write_layers, write_panel
from agropanel.sources.tables import read_layers, read_panel
from agropanel.vocabulary import FEATURE_SETS, target_column


def _grid(text: str) -> GridSpec:
    west, north, xres, yres, width, height = text.split(",")
    return GridSpec(float(west), float(north), float(xres), float(yres), int(width), int(height))


def _pair(text: str) -> tuple[float, float]:
    low, high = map(float, text.split(","))
    return low, high


def _box(text: str) -> tuple[float, ...]:
    west, south, east, north = map(float, text.split(","))
    return west, south, east, north


def _settings(a: argparse.Namespace) -> RunSettings:
    split = {
        "threshold": {"kind": "temporal", "train_max_year": a.train_max_year, "val_year": a.val_year, "test_year_min": a.test_year_min},
        "leaveout": {"kind": "temporal", "strategy": "leaveout", "val_year": a.val_year, "test_year": a.test_year_min},
        "spatial": {"kind": "spatial"},
    }[a.split]
    return RunSettings(
        target=target_column(a.crop), kind=a.model, features=a.featureset, split=split, annual=ENHANCED,
        derive=ENHANCED_DERIVED, log_transform=a.log, model=json.loads(a.params), trim=a.trim,
    )


def layers(spark: SparkSession, a: argparse.Namespace) -> None:
    grid = a.grid or grid_spec(spark.read.parquet(a.grid_from))
    existing = spark.read.parquet(a.existing) if a.existing else None
    if a.overwrite:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    made = monthly_layers(
        spark.read.parquet(a.obs), grid, a.start_year, a.end_year, a.datasets, existing, a.overwrite, a.resampling,
        a.box, spark.read.parquet(a.area) if a.area else None, a.country,
    )
    write_layers(made, a.out, "overwrite" if a.overwrite else "append")


def mask(spark: SparkSession, a: argparse.Namespace) -> None:
    land_mask(spark.read.parquet(a.water), a.threshold).write.mode("overwrite").parquet(a.out)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    grid = a.grid or grid_spec(spark.read.parquet(a.grid_from))
    in_range = F.col("year").between(a.start_year, a.end_year)
    panel = build_panel(
        read_layers(spark, a.layers, a.start_year, a.end_year, a.datasets),
        spark.read.parquet(a.yields).filter(in_range),
        spark.read.parquet(a.fertilizers).filter(in_range),
        grid, a.crop,
        spark.read.parquet(a.mask) if a.mask else None,
        spark.read.parquet(a.static) if a.static else None,
    )
    print(f"{write_panel(panel, a.out):,} rows in {a.out}")


def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    panel, target = read_panel(spark, a.panel), target_column(a.crop)
    for report in (
        Q.q13_crop_summary({a.crop: (panel, target)}), Q.q02_sequence_lengths(panel), Q.q03_year_coverage(panel),
        Q.q06_month_presence(panel), Q.q07_missing(panel), Q.q10_target_stats(panel, target), Q.q19_sentinels(spark.read.parquet(a.panel)),
    ):
        report.show(100, truncate=False)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    done = run(read_panel(spark, a.panel), _settings(a))
    done.metrics_by_split().show(truncate=False)
    done.write(a.out, a.crop)


def sequences(spark: SparkSession, a: argparse.Namespace) -> None:
    split = _settings(a).split
    settings = SequenceSettings(
        target_column(a.crop), a.featureset, split=split, trim=a.trim, per_year_max=a.per_year_max, stratify=a.stratify, normalisation=a.normalisation,
        sequences={"seq_len": a.seq_len, "history_years": a.history_years},
    )
    write_sequences(run_sequences(read_panel(spark, a.panel), settings), a.out)


def suggest(spark: SparkSession, a: argparse.Namespace) -> None:
    panel = read_panel(spark, a.panel)
    model = load_model(spark, a.trained)
    table = annual_table(panel, _settings(a)).filter(F.col("year") == a.test_year_min)
    write_csv(recommend(model, table, response_bounds(panel, Q.fert_columns(panel))), a.out)


def scores(spark: SparkSession, a: argparse.Namespace) -> None:
    found = aggregate_runs(spark, a.runs, a.metric)
    print(f"metric={found['metric']}  n={found['n']}  mean={found['mean']:.4f}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="agropanel", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(required=True)

    def command(fn, *paths: str, crop: bool = True, years: bool = False, grid: bool = False, model: bool = False):
        c = commands.add_parser(fn.__name__)
        c.set_defaults(run=fn)
        for path in paths:
            c.add_argument(f"--{path}", required=True)
        if crop:
            c.add_argument("--crop", required=True)
        if years:
            c.add_argument("--start_year", type=int, default=2002)
            c.add_argument("--end_year", type=int, default=2019)
            c.add_argument("--datasets", default="", help="comma-separated layer keys")
        if grid:
            c.add_argument("--grid", type=_grid, help="west,north,xres,yres,width,height")
            c.add_argument("--grid_from", help="table with lon and lat to read the grid from")
        if model:
            c.add_argument("--model", choices=KINDS, default="elasticnet")
            c.add_argument("--featureset", choices=list(FEATURE_SETS), default="all")
            c.add_argument("--params", default="{}", help=f"JSON, defaults {DEFAULTS['elasticnet']}")
            c.add_argument("--log", action="store_true")
            c.add_argument("--split", choices=("threshold", "leaveout", "spatial"), default="threshold")
            c.add_argument("--trim", type=_pair, default=(0.005, 0.995), help="low,high quantile of the training target")
            c.add_argument("--train_max_year", type=int, default=2012)
            c.add_argument("--val_year", type=int, default=2013)
            c.add_argument("--test_year_min", type=int, default=2014)
        return c

    c = command(layers, "obs", "out", crop=False, years=True, grid=True)
    c.add_argument("--existing")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--resampling", default="average")
    c.add_argument("--box", type=_box, help="west,south,east,north")
    c.add_argument("--area", help="table of pixel_id and country on the target grid")
    c.add_argument("--country")
    c = command(mask, "water", "out", crop=False)
    c.add_argument("--threshold", type=float, default=50)
    c = command(build, "layers", "yields", "fertilizers", "out", years=True, grid=True)
    c.add_argument("--mask")
    c.add_argument("--static")
    command(diagnose, "panel")
    command(train, "panel", "out", model=True)
    c = command(sequences, "panel", "out", model=True)
    c.add_argument("--per_year_max", type=int)
    c.add_argument("--stratify", default="yield_decile")
    c.add_argument("--normalisation", default="zscore_global")
    c.add_argument("--seq_len", type=int, default=12)
    c.add_argument("--history_years", type=int, default=1)
    command(suggest, "panel", "trained", "out", model=True)
    c = command(scores, "runs", crop=False)
    c.add_argument("--metric", default="acc@20%")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("agropanel").getOrCreate(), a)


if __name__ == "__main__":
    main()
