"""Monthly sequences: one row per pixel and year with its months as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.operators.annual import year_before
from agropanel.vocabulary import PANEL_KEYS, PIXEL_YEAR

STEP = "array<float>"


def one_row_per_month(df: DataFrame) -> DataFrame:
    """Copies of a (pixel, year, month) become one row, the largest value per column.

    Partial aggregation removes the copies before anything is shuffled, which
    bounds every sequence by twelve months.
    """
    return df.groupBy(*PANEL_KEYS).agg(*[F.max(c).alias(c) for c in df.columns if c not in PANEL_KEYS])


def build_sequences(
    df: DataFrame,
    dynamic: Sequence[str],
    yearly: Sequence[str],
    target: str,
    static_cols: Sequence[str] = (),
    seq_len: int = 12,
    min_months: int = 9,
    history_years: int = 1,
    add_prev_year_yield: bool = False,
    target_years: Sequence[int] | None = None,
    pad: bool = True,
    unique_months: bool = False,
) -> DataFrame:
    """``pixel_id, year, month_idx, x, static, y``.

    A step of ``x`` is the dynamic features, then the yearly ones, then (if asked)
    the target of the year before; missing numbers are 0. A month is valid when
    it has a dynamic value; years with fewer than ``min_months`` valid months are
    dropped. ``month_idx`` counts from 0 (January). ``history_years`` joins that many
    consecutive years, a gap drops the sample. Sequences are padded at the front (month -1, zeros) or cut at the
    front to ``seq_len``. ``target_years`` limits the samples after earlier years
    have served as context.

    ``unique_months`` says that the panel key is known to be unique.
    """
    dynamic, yearly, static = list(dynamic), list(yearly), list(static_cols)
    slim = df.select(*dict.fromkeys([*PANEL_KEYS, *dynamic, *yearly, *static, target]))
    if not unique_months:
        slim = one_row_per_month(slim)

    def number(c: str | Column) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("float")

    valid = F.lit(False) if dynamic else F.lit(True)
    for c in dynamic:
        valid = valid | F.col(c).isNotNull()
    step = F.array(*[number(c) for c in [*dynamic, *yearly]]).cast(STEP)
    months = F.sort_array(F.collect_list(F.struct(F.col("month").cast("int").alias("m"), step.alias("f"))))
    seq = (
        slim.groupBy(*PIXEL_YEAR)
        .agg(
            months.alias("_s"),
            F.count_if(valid).alias("n_valid"),
            F.max(target).cast("float").alias("y"),
            *[F.max(c).alias(f"_st_{i}") for i, c in enumerate(static)],
        )
        .select(
            *PIXEL_YEAR,
            F.transform("_s", lambda s: s["m"] - 1).alias("month_idx"),
            F.transform("_s", lambda s: s["f"]).alias("x"),
            F.array(*[number(f"_st_{i}") for i in range(len(static))]).cast(STEP).alias("static"),
            "y",
            "n_valid",
        )
    )
    width = len(dynamic) + len(yearly)
    if add_prev_year_yield:
        width += 1
        seq = seq.withColumn("_prev", F.first("y").over(year_before(1)))
        last = F.array(number("_prev")).cast(STEP)
        seq = seq.withColumn("x", F.transform("x", lambda f: F.concat(f, last))).drop("_prev")
    seq = seq.filter(F.col("n_valid") >= min_months)
    if history_years > 1:
        seq = _with_history(seq, history_years)
    if target_years is not None:
        seq = seq.filter(F.col("year").isin(*target_years))
    if pad:
        seq = pad_sequences(seq, seq_len, width)
    return seq.drop("n_valid")


def _with_history(seq: DataFrame, history_years: int) -> DataFrame:
    """Prepend the sequences of the years before; a missing year leaves a NULL and drops the row."""
    before = range(history_years - 1, 0, -1)
    past = {}
    for i in before:
        past[f"_x{i}"] = F.first("x").over(year_before(i))
        past[f"_m{i}"] = F.first("month_idx").over(year_before(i))
    joined = seq.withColumns(past)
    return (
        joined.filter(_all_present([f"_m{i}" for i in before]))
        .withColumns(
            {
                "x": F.concat(*[F.col(f"_x{i}") for i in before], F.col("x")),
                "month_idx": F.concat(*[F.col(f"_m{i}") for i in before], F.col("month_idx")),
            }
        )
        .drop(*past)
    )


def _all_present(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def pad_sequences(seq: DataFrame, seq_len: int, width: int) -> DataFrame:
    """Exactly ``seq_len`` steps: the last ones, with empty steps in front where there are fewer."""
    have = F.size("x")
    lack = F.greatest(F.lit(seq_len) - have, F.lit(0))
    start = F.greatest(have - seq_len, F.lit(0)) + 1
    empty = F.array_repeat(F.lit(0.0), width).cast(STEP)
    return seq.withColumns(
        {
            "x": F.concat(F.array_repeat(empty, lack), F.slice("x", start, F.lit(seq_len))),
            "month_idx": F.concat(F.array_repeat(F.lit(-1), lack), F.slice("month_idx", start, F.lit(seq_len))),
        }
    )


def split_sequences(split, dynamic, yearly, target, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences of train, validation and test, where earlier parts give context to later ones."""
    train, val, test = split

    def years(part: DataFrame) -> list[int]:
        return [r["year"] for r in part.select("year").distinct().collect()]

    def build(df: DataFrame, wanted: list[int] | None) -> DataFrame:
        return build_sequences(df, dynamic, yearly, target, target_years=wanted, **settings)

    val_years, test_years = years(val), years(test)
    with_val = train.unionByName(val) if val_years else val
    with_test = train.unionByName(val).unionByName(test) if test_years else test
    return (
        build(train, None),
        build(with_val, val_years or None),
        build(with_test, test_years or None),
    )


def sequence_summary(seq: DataFrame) -> DataFrame:
    """Number of samples, steps, features per step and static features."""
    return seq.agg(
        F.count(F.lit(1)).alias("samples"),
        F.max(F.size("x")).alias("steps"),
        F.max(F.size(F.col("x")[0])).alias("features"),
        F.max(F.size("static")).alias("static_features"),
    )


def steps_of(seq: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per step, the features as columns."""
    return seq.select(
        *PIXEL_YEAR, "y", "month_idx", F.posexplode("x").alias("step", "f")
    ).select(
        *PIXEL_YEAR, "step", F.col("month_idx")[F.col("step")].alias("month_idx"), "y",
        *[F.col("f")[i].alias(n) for i, n in enumerate(names)],
    )
