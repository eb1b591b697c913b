"""Every registered query: a name and a function of (session, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.functions.climate import convert_units, null_sentinels
from agropanel.functions.targets import exp_target, log_target
from agropanel.operators import annual as A
from agropanel.operators import assemble as J
from agropanel.operators import clean as C
from agropanel.operators import composite as M
from agropanel.operators import diagnostics as Q
from agropanel.operators import grid as G
from agropanel.operators import metrics as E
from agropanel.operators import models as L
from agropanel.operators import normalise as N
from agropanel.operators import recommend as R
from agropanel.operators import sampling as D
from agropanel.operators import sequences as S
from agropanel.operators import splits as P
from agropanel.operators.linear import Problem
from agropanel.operators.moments import moments
from agropanel.plans import views as V
from agropanel.plans.layer_export import monthly_layers
from agropanel.plans.panel_build import build_panel
from agropanel.plans.sequence_run import SequenceSettings, run_sequences
from agropanel.plans.tabular_run import ENHANCED, ENHANCED_DERIVED, RunSettings, annual_table, run
from agropanel.runtime import checkpoint_folder, cut_lineage
from agropanel.sources import inventory as I
from agropanel.sources import names as names_
from agropanel.sources import sinks
from agropanel.sources import tables
from agropanel.vocabulary import DATASETS, DYNAMIC_FEATURES, PANEL_KEYS, PIXEL_YEAR

Query = Callable[[SparkSession, str], DataFrame]

# The split used over the supplied years 1995 to 2001.
SPLIT = {"train_max_year": 1998, "val_year": 1999, "test_year_min": 2000}
YEARS = (1995, 2001)
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating columns rounded, so that the order of a sum does not show.

    The nudge, far below the kept digits, makes exact halves fall the same way.
    """
    nudge = F.lit(3.0 * 10 ** -(digits + 3))
    return df.select(*[
        F.round(F.col(f"`{f.name}`").cast("double") + nudge, digits).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _over_panel(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(fn(V.panel(spark, folder)))


def _over_preds(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: rounded(fn(V.preds(spark, folder)))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------


def panel_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark, "panel")
    schema = tables.panel_schema("wheat", V.FERTS)
    sinks.write_panel(tables.conform(V.panel(spark, folder), schema), path)
    back = tables.conform(tables.read_panel(spark, path), schema)
    return rounded(
        back.groupBy("year").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col("chirps_precip").cast("double")).alias("precip"),
            F.count("modis_ndvi").alias("ndvi"), F.count(V.TARGET).alias("yields"),
        )
    )


def layers_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    root = _scratch(spark, "layers")
    sinks.write_layers(V.layers(spark, folder), root)
    back = tables.read_layers(spark, root, *YEARS, "chirps_precip, modis_ndvi")
    return rounded(
        back.groupBy("dataset", "year", "month").agg(F.count("value").alias("cells"), F.sum("value").alias("total"))
    )


def panel_sql(spark: SparkSession, folder: str) -> DataFrame:
    tables.register_panel(V.panel(spark, folder), "agropanel_panel")
    return spark.sql(
        "SELECT year, month, count(*) AS row_count, count(modis_ndvi) AS with_ndvi "
        "FROM agropanel_panel GROUP BY year, month"
    )


def parse_names(spark: SparkSession, folder: str) -> DataFrame:
    return names_.parse_names(V.source_names(spark, folder))


def yearly_static_groups(spark: SparkSession, folder: str) -> DataFrame:
    yearly, static = names_.split_yearly_static(V.source_names(spark, folder), "wheat")
    counted = lambda df, kind: df.groupBy("feature").agg(F.count(F.lit(1)).alias("sources")).withColumn("kind", F.lit(kind))
    return counted(yearly, "yearly").unionByName(counted(static, "static"))


def layers_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The months that written layers have, from the listing of their files."""
    root = _scratch(spark, "layers")
    sinks.write_layers(V.layers(spark, folder), root)
    path = tables.list_sources(spark, root, "*.parquet").select("path")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    found = path.select(part("dataset").alias("dataset"), part("year").cast("int").alias("year"), part("month").alias("month")).distinct()
    return found.groupBy("dataset", "year").agg(F.count(F.lit(1)).alias("months"))


def predictions_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction pairs written as CSV and read back."""
    path = _scratch(spark, "preds")
    sinks.write_csv(V.preds(spark, folder), path)
    back = spark.read.csv(path, header=True, schema="year INT, y DOUBLE, p DOUBLE")
    return rounded(back.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("y"), F.sum("p").alias("p")), 2)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return I.source_inventory(V.inventory(spark, folder), ["A", "N", "R"], *YEARS)


def pending(spark: SparkSession, folder: str) -> DataFrame:
    return I.pending(I.month_spine(spark, ["A", "N", "R"], *YEARS), V.inventory(spark, folder))


def pending_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Every month is to be done again, whatever exists."""
    return I.pending(I.month_spine(spark, ["A", "N", "R"], *YEARS), V.inventory(spark, folder), overwrite=True)


def picked_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The source that each of some crops takes."""
    found = V.source_names(spark, folder)
    return spark.createDataFrame([(crop, names_.pick_source(found, crop)) for crop in ("wheat", "zone", "maize")], "crop STRING, name STRING")


def metrics_files(spark: SparkSession, folder: str) -> DataFrame:
    """Scores written as JSON, read back as runs: one run per overall document."""
    preds = V.preds(spark, folder)
    root = _scratch(spark, "runs")
    document = sinks.metrics_document(
        E.metrics(preds, "y", "p"), E.metrics_by_year(preds, "y", "p"), config_name="wheat_check"
    )
    sinks.write_metrics(document, f"{root}/run/metrics_wheat_check.json")
    return rounded(sinks.collect_runs(spark, root, "acc@20%").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


# --- grid --------------------------------------------------------------------


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return V.fine_cells(spark, folder).select(
        (F.col("col") + 0.5).alias("lon"), (-F.col("row") - 0.5).alias("lat"), "value"
    )


def grid_spec(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.grid_frame(_points(spark, folder)))


def pixel_id(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    return rounded(G.with_pixel_id(points, G.grid_spec(points)).select("pixel_id", "row", "col", "value"))


def _regrid(method: str, step: float) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        fine = V.fine_grid(spark, folder)
        return rounded(G.regrid(V.fine_cells(spark, folder), fine, V.coarse_grid(fine, step), method))

    return query


def fill_3x3(spark: SparkSession, folder: str) -> DataFrame:
    cells = V.panel(spark, folder).select("year", "month", "pixel_id", F.col("modis_ndvi").alias("value"))
    filled = G.fill_3x3(cells, V.panel_grid(spark, folder), ["year", "month"], 2)
    return rounded(filled.filter(F.col("value").isNotNull()))


def land_mask(spark: SparkSession, folder: str) -> DataFrame:
    return G.land_mask(V.water(spark, folder))


def mask_semi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.apply_mask(V.panel(spark, folder), V.mask(spark, folder)).select(*PANEL_KEYS, "chirps_precip"))


def clip_aoi(spark: SparkSession, folder: str) -> DataFrame:
    inside = G.clip_aoi(V.panel(spark, folder), V.countries(spark, folder), "NATION_1")
    return rounded(inside.select(*PANEL_KEYS, "chirps_precip"))


def yield_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item is a slice of its supplier's year; the last one counts."""
    series = V.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("pixel_id"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").alias("value"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("slice"),
    )
    return rounded(G.yield_by_year(series, 1996, 2000, slice_col="slice"))


def yield_static(spark: SparkSession, folder: str) -> DataFrame:
    series = V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("pixel_id"), F.col("s_acctbal").alias("value"))
    return rounded(G.yield_by_year(series, 1996, 2000, time=None))


# --- compositing and units ---------------------------------------------------


def _composite(agg: str) -> Query:
    return lambda spark, folder: rounded(M.composite(V.obs(spark, folder), ["cell"], agg))


def composite_daily(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.composite(V.obs_daily(spark, folder), ["cell"], "mean"))


def composite_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity as daily precipitation, discount as temperature, price as vegetation: a sum, a mean and a median."""
    lineitem = V.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("chirps_precip"), (F.col("l_discount") + 273.15).alias("era5_temp2m"),
        F.col("l_extendedprice").alias("modis_ndvi"),
    )
    long = lineitem.unpivot(["cell", "ts"], ["chirps_precip", "era5_temp2m", "modis_ndvi"], "dataset", "value")
    return rounded(M.composite_datasets(long, ["cell"], {**DATASETS, "modis_ndvi": replace(DATASETS["modis_ndvi"], agg="median")}))


def _layers_of_lineitem(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Daily amounts and two temperatures per supplier cell to monthly layers on a grid twice as coarse."""
    grid = V.panel_grid(spark, folder)
    key = F.col("l_suppkey")
    kelvin = F.col("l_quantity") + 273.15
    obs = V.table(spark, folder, "lineitem").select(
        (grid.col_of(key) + 0.5).alias("lon"), (-grid.row_of(key) - 0.5).alias("lat"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("chirps_precip"), kelvin.alias("era5_temp2m"),
        (kelvin - F.col("l_discount") * 10).alias("era5_dewpoint2m"),
    ).unpivot(["lon", "lat", "ts"], ["chirps_precip", "era5_temp2m", "era5_dewpoint2m"], "dataset", "value")
    target = G.GridSpec(0.0, 0.0, 2.0, 2.0, 5, -(-grid.height // 2))
    return rounded(monthly_layers(obs, target, *YEARS, "chirps_precip,era5_temp2m,era5_vpd", **options))


def layer_export(spark: SparkSession, folder: str) -> DataFrame:
    return _layers_of_lineitem(spark, folder)


def layer_export_country(spark: SparkSession, folder: str) -> DataFrame:
    """The same layers for the pixels of one country."""
    return _layers_of_lineitem(spark, folder, area=V.countries(spark, folder), country="NATION_1")


def layer_export_box(spark: SparkSession, folder: str) -> DataFrame:
    """The same layers from the observations within a box, whose grid is that of the box."""
    return _layers_of_lineitem(spark, folder, box=(2.0, -6.0, 6.0, 0.0))


def vpd_month(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.vpd(V.temps(spark, folder), ["cell"]))


def units(spark: SparkSession, folder: str) -> DataFrame:
    converted = convert_units(V.layers(spark, folder))
    return rounded(converted.groupBy("dataset").agg(F.count("value").alias("cells"), F.avg("value").alias("mean")))


def sentinels(spark: SparkSession, folder: str) -> DataFrame:
    """No discount and no tax stand in for the two numeric markers, in a float column."""
    marked = V.table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_discount") == 0, -9999.0).when(F.col("l_tax") == 0, 1e20)
        .otherwise(F.col("l_quantity")).cast("float").alias("value"),
    )
    clean = null_sentinels(marked)
    return rounded(clean.groupBy("l_returnflag").agg(
        F.count("value").alias("present"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.sum(F.col("value").cast("double")).alias("total"),
    ))


# --- assembly ----------------------------------------------------------------


def panel_spine(spark: SparkSession, folder: str) -> DataFrame:
    return J.panel_spine(G.kept_pixels(V.mask(spark, folder)), V.layers(spark, folder))


def panel_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = J.widen(V.layers(spark, folder))
    return rounded(J.with_static(J.with_yearly(wide, V.yearly(spark, folder)), V.static_attr(spark, folder)))


def panel_built(spark: SparkSession, folder: str) -> DataFrame:
    yearly = V.yearly(spark, folder)
    built = build_panel(
        V.layers(spark, folder), yearly.select(*PIXEL_YEAR, V.TARGET), yearly.select(*PIXEL_YEAR, *V.FERTS),
        V.panel_grid(spark, folder), "wheat", V.mask(spark, folder), V.static_attr(spark, folder),
    )
    return rounded(built)


def keep_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly rows of the pixel-years that have a yield and all fertilizers."""
    keys = J.rule_a(V.yearly(spark, folder), V.TARGET)
    return rounded(J.keep_keys(V.panel(spark, folder), keys).select(*PANEL_KEYS, "chirps_precip"))


# --- cleaning, splits, sampling ----------------------------------------------


def _some_unfertilised(panel: DataFrame) -> DataFrame:
    """The panel with zero or missing fertilizer in some pixel-years, in one kind or both."""
    kind, other = (F.col("pixel_id") + 2 * F.col("year")) % 5, (F.col("pixel_id") + F.col("year")) % 3
    return panel.withColumns({
        "fert_n": F.when(kind == 0, 0.0).when(kind == 1, None).otherwise(F.col("fert_n")),
        "fert_p": F.when(other == 0, 0.0).when(other == 1, None).otherwise(F.col("fert_p")),
    })


def _tagged(rules_of: Callable[[DataFrame], dict]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        panel = V.panel(spark, folder).select(*PANEL_KEYS, V.TARGET)
        return rounded(P.tag_parts(panel, rules_of(panel)).select("split", *PANEL_KEYS, V.TARGET))

    return query


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    panel = C.clean(V.panel(spark, folder), V.TARGET)
    return P.tag_parts(panel, P.threshold_rules(**SPLIT)).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("year").alias("years")
    )


def temporal_cv(spark: SparkSession, folder: str) -> DataFrame:
    return P.fold_sizes(V.panel(spark, folder), P.temporal_cv(YEARS[0], YEARS[1] - 1))


def _trim(sequential: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        panel = cut_lineage(V.panel(spark, folder).select(*PANEL_KEYS, V.TARGET))
        split = P.temporal_split(C.clean(panel, V.TARGET), **SPLIT)
        split = P.quantile_trim(split, V.TARGET, 0.2, 0.8, sequential)
        return rounded(P.labelled(split))

    return query


def _downsample(stratify: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        panel = V.panel(spark, folder).select(*PANEL_KEYS, V.TARGET)
        kept = D.downsample(C.clean(panel, V.TARGET), V.TARGET, 40, stratify)
        return rounded(kept)

    return query


# --- annual tables -----------------------------------------------------------


def _annual(**settings) -> Query:
    plain = {"seasonal_quartiles": False, "include_prev_year_yield": False}

    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = A.aggregate_yearly(V.panel(spark, folder), DYNAMIC_FEATURES, V.FERTS, V.TARGET, **{**plain, **settings})
        return rounded(A.drop_missing_target(table, V.TARGET))

    return query


def annual_static(spark: SparkSession, folder: str) -> DataFrame:
    panel = J.with_static(V.panel(spark, folder), V.static_attr(spark, folder))
    table = A.aggregate_yearly(
        panel, [], [], V.TARGET, static_cols=["static_zone", "static_zone"],
        seasonal_quartiles=False, include_prev_year_yield=False,
    )
    return rounded(A.drop_missing_target(table, V.TARGET))


def _derived(**settings) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = A.aggregate_yearly(
            V.panel(spark, folder), ["chirps_precip"], V.FERTS, V.TARGET,
            seasonal_quartiles=False, include_prev_year_yield=False,
        )
        return rounded(A.drop_missing_target(A.derive_features(table, **settings), V.TARGET))

    return query


# --- normalisation, sequences ------------------------------------------------


def _zscore(scheme: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        panel = V.panel(spark, folder).select(*PANEL_KEYS, *DYNAMIC_FEATURES)
        train = P.temporal_split(panel, **SPLIT).train
        return rounded(N.normalise(panel, train, DYNAMIC_FEATURES, scheme))

    return query


def target_transform(spark: SparkSession, folder: str) -> DataFrame:
    table = V.yearly(spark, folder).filter(F.col(V.TARGET).isNotNull())
    z = table.withColumn("z", log_target(F.col(V.TARGET)))
    return rounded(z.select(*PIXEL_YEAR, "z", exp_target(F.col("z")).alias("back")), 4)


SEQUENCE_FEATURES = ["chirps_precip", "modis_ndvi"]


def _sequences(extra: list[str] | None = None, **settings) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        panel = C.clean(V.panel(spark, folder), V.TARGET)
        seq = S.build_sequences(
            panel, SEQUENCE_FEATURES, ["fert_n"], V.TARGET, unique_months=True, **settings
        )
        return rounded(S.steps_of(seq, [*SEQUENCE_FEATURES, "fert_n", *(extra or [])]))

    return query


def sequences_static(spark: SparkSession, folder: str) -> DataFrame:
    panel = J.with_static(V.panel(spark, folder), V.static_attr(spark, folder))
    seq = S.build_sequences(panel, SEQUENCE_FEATURES, [], V.TARGET, ["static_zone"], unique_months=True)
    return rounded(seq.select(*PIXEL_YEAR, F.size("x").alias("steps"), F.col("static")[0].alias("static_zone")))


def sequence_context(spark: SparkSession, folder: str) -> DataFrame:
    """Two-year test samples whose first year comes from the training or validation part."""
    panel = V.panel(spark, folder).select(*PANEL_KEYS, *SEQUENCE_FEATURES, V.TARGET)
    split = P.temporal_split(cut_lineage(C.clean(panel, V.TARGET)), **SPLIT)
    parts = S.split_sequences(split, SEQUENCE_FEATURES, [], V.TARGET, history_years=2, seq_len=24)
    return P.labelled(P.Split(*parts)).groupBy("split", "year").agg(F.count(F.lit(1)).alias("samples"))


def sequence_summary(spark: SparkSession, folder: str) -> DataFrame:
    panel = V.panel(spark, folder)
    return S.sequence_summary(S.build_sequences(panel, DYNAMIC_FEATURES, V.FERTS, V.TARGET, add_prev_year_yield=True))


def sequence_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sequence preparation, one row per sample with the sums of its standardised steps."""
    settings = SequenceSettings(
        V.TARGET, "weather_only", ["chirps_precip", "era5_temp2m"], {"kind": "temporal", **SPLIT}, 0.0,
        trim=(0.05, 0.95), sequences={"unique_months": True},
    )
    total = lambda i: F.aggregate("x", F.lit(0.0), lambda a, f: a + f[i].cast("double"))
    rows = P.labelled(run_sequences(V.panel(spark, folder), settings))
    return rounded(rows.select(
        "split", *PIXEL_YEAR, F.size("x").alias("steps"), F.size(F.filter("month_idx", lambda m: m >= 0)).alias("months"),
        F.col("y").cast("double").alias("y"), total(0).alias("precip"), total(1).alias("temp"),
    ), 2)


# --- models ------------------------------------------------------------------


def _settings(kind: str, model: dict, log: bool = True) -> RunSettings:
    return RunSettings(
        target=V.TARGET, kind=kind, split={"kind": "temporal", **SPLIT},
        annual=ENHANCED, derive=ENHANCED_DERIVED, log_transform=log, model=model,
    )


def _model(kind: str, **model) -> Query:
    """Scores per split of one model on the enhanced annual table."""
    return lambda spark, folder: rounded(run(V.panel(spark, folder), _settings(kind, model)).metrics_by_split(), 4)


def _model_facts(kind: str, beats_mean: bool = True, in_range: bool = False, **model) -> Query:
    """What must hold of a model's predictions whatever it learnt: rows per split, the residual's definition,
    a training error below that of the mean, and (forests) no prediction outside the training targets."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        scored = run(V.panel(spark, folder), _settings(kind, model)).scored
        y, p = F.col(V.TARGET).cast("double"), F.col("y_pred")
        of = scored.filter("split = 'train'").agg(F.struct(F.min(y).alias("low"), F.max(y).alias("high"), F.stddev_pop(y).alias("dev"))).scalar()
        train = F.col("split") == "train"
        return scored.withColumn("_of", of).groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"),
            F.every(F.abs(F.col("residual") - (p - y)) < 1e-6).alias("residual_is_error"),
            F.when(F.first(train) & F.lit(beats_mean), F.sqrt(F.avg((p - y) * (p - y))) < F.first("_of.dev")).alias("beats_mean"),
            F.when(F.lit(in_range), F.every(p.between(F.col("_of.low") - 1e-6, F.col("_of.high") + 1e-6))).alias("in_range"),
        )

    return query


def _near(column: str) -> Callable:
    return lambda v: F.abs(v - F.col(column)) < 1e-9


def recommend_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every recommendation: never worse, a level of the grid, and a level only where it gains."""
    panel = V.panel(spark, folder)
    done = run(panel, _settings("linear", {"alpha": 10.0}))
    bounds = R.response_bounds(panel, V.FERTS)
    found = R.recommend(done.model, done.annual.filter(F.col("year") == SPLIT["test_year_min"]), bounds)
    levels = R.candidates(bounds)
    on_grid = [F.col(c).isNull() | F.exists(F.array(*[F.lit(v) for v in levels[c]]), _near(c)) for c in V.FERTS]
    chosen = F.coalesce(*V.FERTS).isNotNull()
    return found.select(
        *PIXEL_YEAR, (F.col("pred_opt") >= F.col("pred_base")).alias("not_worse"),
        (on_grid[0] & on_grid[1]).alias("on_grid"), (chosen == (F.col("pred_opt") > F.col("pred_base"))).alias("level_iff_gain"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    done = run(V.panel(spark, folder), _settings("linear", {"alpha": 10.0}))
    return rounded(done.predictions().select(*sinks.prediction_columns(V.TARGET, PIXEL_YEAR)), 4)


def response_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(R.response_bounds_frame(V.panel(spark, folder), V.FERTS))


def response_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The seven levels of each fertilizer between its bounds."""
    bounds = R.response_bounds_frame(V.panel(spark, folder), V.FERTS)
    step = (F.col("hi") - F.col("lo")) / 6
    levels = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.col("lo") + step * i)
    return rounded(bounds.select("feature", F.posexplode(levels).alias("level", "value")))


def recommend(spark: SparkSession, folder: str) -> DataFrame:
    """All pixel-years of the first test year, untrimmed, as the command does it."""
    panel = V.panel(spark, folder)
    done = run(panel, _settings("linear", {"alpha": 10.0}))
    rows = done.annual.filter(F.col("year") == SPLIT["test_year_min"])
    return rounded(R.recommend(done.model, rows, R.response_bounds(panel, V.FERTS)), 4)


def sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The whole grid of elastic nets over the folds, from one pass."""
    settings = _settings("elasticnet", {})
    table = cut_lineage(annual_table(V.panel(spark, folder), settings))
    features = A.model_features(table.columns, V.TARGET, settings.derive)
    grid = {"alpha": [0.002, 0.005, 0.01, 0.05, 0.3], "l1_ratio": [0.1, 0.35, 0.6, 0.9]}
    scores = L.sweep(
        table, features, V.TARGET, "elasticnet", grid, P.temporal_cv(1996, 2000), trim=settings.trim,
        log_transform=True, derive=settings.derive, max_iter=8000, tol=1e-6,
    )
    return rounded(scores, 4)


def _few(spark: SparkSession, folder: str, dynamic: list[str]) -> DataFrame:
    """The annual table of a few features, for models that plain SQL can solve."""
    table = A.aggregate_yearly(V.panel(spark, folder), dynamic, ["fert_n"], V.TARGET, seasonal_quartiles=False, include_prev_year_yield=False)
    return cut_lineage(A.drop_missing_target(table, V.TARGET))


def sweep_ridge(spark: SparkSession, folder: str) -> DataFrame:
    grid = {"alpha": [1.0, 50.0, 2000.0]}
    scores = L.sweep(_few(spark, folder, ["chirps_precip"]), ["chirps_precip", "fert_n"], V.TARGET, "linear", grid, P.temporal_cv(1996, 1999), trim=(0.05, 0.95))
    return rounded(scores.select("fold", "params", "split", "rmse", "mae", "r2", "bias", "n"), 4)


def predictions_ridge(spark: SparkSession, folder: str) -> DataFrame:
    split = P.temporal_split(_few(spark, folder, ["chirps_precip"]), **SPLIT)
    model = L.fit("linear", split.train, ["chirps_precip", "fert_n"], V.TARGET, log_transform=True, alpha=10.0)
    return rounded(L.predict(model, split.test).select(*PIXEL_YEAR, V.TARGET, "y_pred", "residual"), 4)


def model_saved(spark: SparkSession, folder: str) -> DataFrame:
    """The predictions of a model that was written and read again."""
    split = P.temporal_split(_few(spark, folder, ["chirps_precip"]), **SPLIT)
    path = _scratch(spark, "model")
    L.save_model(L.fit("linear", split.train, ["chirps_precip", "fert_n"], V.TARGET, log_transform=True, alpha=10.0), path)
    return rounded(L.predict(L.load_model(spark, path), split.test).select(*PIXEL_YEAR, V.TARGET, "y_pred", "residual"), 4)


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """What the models see of every pixel-year, one row per feature."""
    table = A.aggregate_yearly(V.panel(spark, folder), ["chirps_precip", "modis_ndvi"], V.FERTS, V.TARGET, seasonal_quartiles=False, include_prev_year_yield=False)
    table = A.drop_missing_target(table, V.TARGET)
    features = A.model_features(table.columns, V.TARGET, ENHANCED_DERIVED)
    rows = table.select(*PIXEL_YEAR, A.feature_array(table.columns, features, ENHANCED_DERIVED).alias("x"))
    named = F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), "x")).alias("feature", "value")
    return rounded(rows.select(*PIXEL_YEAR, named), 4)


def elasticnet_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the raw features and the intercept of one elastic net."""
    features = ["chirps_precip", "era5_temp2m", "modis_lst_day", "fert_n"]
    table = _few(spark, folder, features[:3]).filter(F.col("year") <= SPLIT["train_max_year"])
    model = L.fit("elasticnet", table, features, V.TARGET, log_transform=True, alpha=0.004, l1_ratio=0.5, max_iter=20_000, tol=1e-15)
    named = [*zip(features, model.weights), ("intercept", model.intercept)]
    return rounded(spark.createDataFrame(named, "feature STRING, weight DOUBLE"), 7)


def boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of two trees of depth two on features of few values, with the gain of every split."""
    table = _few(spark, folder, ["chirps_precip"]).filter(F.col("year") <= SPLIT["train_max_year"])
    steps = {"chirps_step": F.floor(F.col("chirps_precip") / 12).cast("double"), "fert_step": F.floor(F.col("fert_n") * 2).cast("double")}
    model = L.fit("xgboost", table.withColumns(steps), list(steps), V.TARGET, log_transform=True, n_estimators=2, max_depth=2, learning_rate=0.5, subsample=1.0, colsample_bytree=1.0)
    rows = []
    for number, tree in enumerate(model.booster.trees):
        path = {0: ""}
        for at in sorted(range(len(tree.feature))):  # a node comes before its children
            leaf = tree.feature[at] < 0
            rows.append((number, path[at], *((None, None, None, tree.rows[at], tree.value[at]) if leaf else (list(steps)[tree.feature[at]], tree.threshold[at], tree.gain[at], tree.rows[at], None))))
            if not leaf:
                path[tree.left[at]], path[tree.right[at]] = path[at] + "L", path[at] + "R"
    schema = "tree INT, node STRING, feature STRING, threshold DOUBLE, gain DOUBLE, rows DOUBLE, value DOUBLE"
    return rounded(spark.createDataFrame(rows, schema), 7)


def elasticnet_optimality(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the fitted elastic net meets its optimality conditions on the training rows, and has weights at all.

    The slope of every feature is taken from the rows' own residuals: it equals the L1
    penalty's where there is a weight and is no larger elsewhere.
    """
    alpha, ratio = 0.005, 0.35
    done = run(V.panel(spark, folder), _settings("elasticnet", {"alpha": alpha, "l1_ratio": ratio, "max_iter": 8000, "tol": 1e-12}))
    model, train = done.model, done.split.train
    z = log_target(F.col("y_pred"), model.log_offset)
    residual = log_target(F.col(V.TARGET).cast("double"), model.log_offset) - z
    rows, values = L.label_last(L.score(model, train), model.features, residual, model.derive)
    problem = Problem.of(moments(rows, values, [])[()])
    weights = np.array(model.weights) * problem.deviation
    slope = problem.cross - alpha * (1 - ratio) * weights
    off = np.abs(slope - alpha * ratio * np.sign(weights))
    optimal = bool((off[weights != 0] < 1e-6).all() and (np.abs(slope[weights == 0]) <= alpha * ratio + 1e-6).all())
    return train.agg(F.count(F.lit(1)).alias("rows"), F.lit(optimal).alias("optimal"), F.lit(int((weights != 0).sum()) >= 3).alias("several_weights"))


def best_run(spark: SparkSession, folder: str) -> DataFrame:
    """Years as rounds of a run, scored by their error."""
    rounds = E.metrics(V.preds(spark, folder), "y", "p", ["year"]).withColumn("run", F.concat(F.lit("round_"), F.col("year")))
    return rounded(E.best_run(rounds, "run", "year"))


def _maize(panel: DataFrame) -> DataFrame:
    """A second crop: grown in later years only, with yields of its own."""
    return panel.filter(F.col("year") >= 1997).select(*PANEL_KEYS, (F.col(V.TARGET) / 4 + F.col("month")).alias("yield_maize"))


def metrics_by_split(spark: SparkSession, folder: str) -> DataFrame:
    tagged = P.tag_parts(V.preds(spark, folder), P.threshold_rules(**SPLIT))
    return rounded(E.metrics(tagged, "y", "p", ["split"]))


def _projected(name: str) -> Query:
    return _over_panel(lambda p: C.project(p, C.feature_set(name, p.columns), V.TARGET))


QUERIES: dict[str, Query] = {
    # diagnostics
    "q01_overview": _over_panel(Q.q01_overview),
    "q02_sequence_lengths": _over_panel(Q.q02_sequence_lengths),
    "q03_year_coverage": _over_panel(Q.q03_year_coverage),
    "q04_source_coverage": lambda s, d: Q.q04_source_coverage(V.yearly(s, d), V.TARGET, V.FERTS, V.mask(s, d)),
    "q04_month_coverage": lambda s, d: Q.q04_month_coverage(
        V.yearly(s, d), V.TARGET, V.FERTS, V.mask(s, d), V.layers(s, d)
    ),
    "q05_month_counts": _over_panel(Q.q05_month_counts),
    "q05_month_pivot": _over_panel(Q.q05_month_pivot),
    "q06_month_presence": _over_panel(Q.q06_month_presence),
    "q07_missing": _over_panel(Q.q07_missing),
    "q08_month_means": _over_panel(lambda p: Q.q08_month_means(p, V.TARGET)),
    "q09_missing_by_month": _over_panel(Q.q09_missing_by_month),
    "q10_target_stats": _over_panel(lambda p: Q.q10_target_stats(p, V.TARGET)),
    "q11_first_key": _over_panel(Q.q11_first_key),
    "q12_columns": _over_panel(Q.q12_columns),
    "q13_crop_summary": _over_panel(lambda p: Q.q13_crop_summary({"wheat": (p, V.TARGET), "maize": (_maize(p), "yield_maize")})),
    "q14_seasonality": _over_panel(Q.q14_seasonality),
    "q15_histogram_yield": _over_panel(lambda p: Q.q15_histogram(p, V.TARGET, 40)),
    "q15_histogram_fert_n": _over_panel(lambda p: Q.q15_histogram(p, "fert_n", 50)),
    "q15_histogram_fert_p": _over_panel(lambda p: Q.q15_histogram(p, "fert_p", 50)),
    "q16_example_sequence": _over_panel(lambda p: Q.q16_example_sequence(p, V.TARGET)),
    "q17_narrative": _over_panel(Q.q17_narrative),
    "q18_missing_cells": _over_panel(Q.q18_missing_cells),
    "q19_sentinels": _over_panel(Q.q19_sentinels),
    "q20_calendar": _over_panel(Q.q20_calendar),
    "q21_rows_per_pixel": _over_panel(Q.q21_rows_per_pixel),
    "q22_sample": _over_panel(lambda p: Q.q22_sample(p, 5000, 0)),
    "q23_correlation": _over_panel(Q.q23_correlation),
    # scores
    "metrics_overall": _over_preds(lambda p: E.metrics(p, "y", "p")),
    "metrics_by_year": _over_preds(lambda p: E.metrics_by_year(p, "y", "p")),
    "metrics_by_split": metrics_by_split,
    "residuals_by_year": _over_preds(lambda p: E.residuals(p, "y", "p")),
    "parity_range": _over_preds(lambda p: E.parity_range(p, "y", "p")),
    "best_run": best_run,
    "metrics_files": metrics_files,
    # sources and sinks
    "panel_sql": panel_sql,
    "panel_roundtrip": panel_roundtrip,
    "layers_roundtrip": layers_roundtrip,
    "layers_listed": layers_listed,
    "predictions_csv": predictions_csv,
    "parse_names": parse_names,
    "yearly_static_groups": yearly_static_groups,
    "inventory": inventory,
    "pending": pending,
    # grid
    "grid_spec": grid_spec,
    "pixel_id": pixel_id,
    "regrid_average": _regrid("average", 5.0),
    "regrid_average_uneven": _regrid("average", 2.5),
    "regrid_nearest": _regrid("nearest", 5.0),
    "regrid_bilinear": _regrid("bilinear", 4.0),
    "fill_3x3": fill_3x3,
    "land_mask": land_mask,
    "mask_semi": mask_semi,
    "clip_aoi": clip_aoi,
    "yield_by_year": yield_by_year,
    "yield_static": yield_static,
    # compositing
    "composite_sum": _composite("sum"),
    "composite_mean": _composite("mean"),
    "composite_median": _composite("median"),
    "composite_daily": composite_daily,
    "composite_datasets": composite_datasets,
    "vpd_month": vpd_month,
    "layer_export": layer_export,
    "layer_export_country": layer_export_country,
    "layer_export_box": layer_export_box,
    "units": units,
    "sentinels": sentinels,
    # assembly
    "panel_spine": panel_spine,
    "panel_wide": panel_wide,
    "panel_built": panel_built,
    "rule_a": _over_panel(lambda p: J.rule_a(p, V.TARGET)),
    "rule_a_report": _over_panel(lambda p: J.rule_a_report(p, V.TARGET)),
    "keep_keys": keep_keys,
    "history_window": _over_panel(lambda p: J.history_window(p, 2000, 2).select(*PANEL_KEYS, "chirps_precip")),
    "sequence_of": _over_panel(lambda p: J.sequence_of(p, 1, 1998)),
    # cleaning
    "project_weather": _projected("weather_only"),
    "project_all": _projected("all"),
    "project_vegetation": _projected("veg_lst_only"),
    "project_no_fertilizer": _projected("no_fertilizer"),
    "project_fertilizer": _projected("fertilizer_only"),
    "clean_basic": _over_panel(lambda p: C.clean(p, V.TARGET, V.FERTS, True, 40_000).select(*PANEL_KEYS, V.TARGET)),
    "clean_report": _over_panel(lambda p: C.clean_report(p, V.TARGET, V.FERTS, True, 40_000, True)),
    "require_fert": _over_panel(lambda p: C.clean(_some_unfertilised(p), V.TARGET, V.FERTS, False, 0.0, True).select(*PANEL_KEYS, *V.FERTS)),
    # splits and sampling
    "split_threshold": _tagged(lambda p: P.threshold_rules(1999, 1999, 2000)),
    "split_leaveout": _tagged(lambda p: P.leaveout_rules(1997, 1998)),
    "split_spatial": _tagged(P.spatial_rules),
    "split_sizes": split_sizes,
    "temporal_cv": temporal_cv,
    "trim_sequential": _trim(True),
    "trim_joint": _trim(False),
    "downsample_decile": _downsample("yield_decile"),
    "downsample_random": _downsample("random"),
    # annual tables
    "annual_mean": _annual(),
    "annual_mean_sum": _annual(aggregate_to_year="mean_sum"),
    "annual_quarters": _annual(seasonal_quartiles=True),
    "annual_extra": _annual(extra_stats=["std", "min", "max"]),
    "annual_lag": _annual(lag_years=2),
    "annual_prev_target": _annual(include_prev_year_yield=True),
    "annual_static": annual_static,
    "annual_interactions": _derived(add_fertilizer_interactions=True),
    "annual_log1p": _derived(log1p_features=["fert_", "chirps_precip"]),
    # normalisation
    "zscore_global": _zscore("zscore_global"),
    "zscore_month": _zscore("zscore_by_month"),
    "log_target": target_transform,
    # sequences
    "sequences": _sequences(min_months=11, pad=False),
    "sequences_padded": _sequences(min_months=9),
    "sequences_history2": _sequences(history_years=2, seq_len=24),
    "sequences_prev_year": _sequences(["prev"], add_prev_year_yield=True),
    "sequences_static": sequences_static,
    "sequence_context": sequence_context,
    "sequence_summary": sequence_summary,
    "sequence_run": sequence_run,
    # models
    "model_ridge": _model("linear", alpha=10.0),
    "model_elasticnet": _model("elasticnet", alpha=0.005, l1_ratio=0.35, max_iter=8000, tol=5e-5),
    "model_forest": _model("random_forest", n_estimators=20, max_depth=8),
    "model_gbt": _model("gbrt", n_estimators=20),
    "model_boosted_deep": _model("xgboost", n_estimators=10),
    "model_leafwise": _model("gbdt"),
    "model_ridge_facts": _model_facts("linear", alpha=10.0),
    "model_elasticnet_facts": _model_facts("elasticnet", alpha=0.005, l1_ratio=0.35, max_iter=8000, tol=5e-5),
    "elasticnet_weights": elasticnet_weights,
    "elasticnet_optimality": elasticnet_optimality,
    "sweep_ridge": sweep_ridge,
    "predictions_ridge": predictions_ridge,
    "model_saved": model_saved,
    "feature_matrix": feature_matrix,
    "pending_overwrite": pending_overwrite,
    "picked_sources": picked_sources,
    "model_forest_facts": _model_facts("random_forest", in_range=True, n_estimators=20, max_depth=8),
    "model_gbt_facts": _model_facts("gbrt", n_estimators=20),
    "model_boosted_deep_facts": _model_facts("xgboost", n_estimators=10),
    "model_leafwise_facts": _model_facts("gbdt", n_estimators=10, num_leaves=31, min_child_weight=2.0),
    "boosted_trees": boosted_trees,
    "recommend_facts": recommend_facts,
    "predictions": predictions,
    "response_bounds": response_bounds,
    "response_levels": response_levels,
    "recommend": recommend,
    "sweep": sweep,
}
