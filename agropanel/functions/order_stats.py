"""Exact quantiles and average ranks that no single task has to hold.

A few quantiles of a whole column come from two scans and no shuffle of rows, see
``selected``: a sketch with a known rank error brackets them, the second scan counts what
lies below and collects the distinct values of the narrow brackets.

Ranks, and quantiles of many groups, have one way for every size. Distinct values are counted per group, so a value
that fills a third of the table is one row. The counts are dealt to ascending
ranges of (group, value) and written once; Spark samples the bounds of the ranges.
Sums of the counts per range give the place of a range's first row, a running sum
within the range the place of each value, and quantiles and ranks are read off the
same written table. NaN comes after all numbers, as ``percentile`` orders it.

Where every row needs its own rank, ``ranked`` deals the rows themselves to the ranges, so no
rank is joined back by value. A range may end inside a value: what lies in other ranges is
added from a table of one row per range and group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.runtime import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches NULL keys, keeping the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def placed_values(rows: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """``by, value, _c, _first, n``: each distinct value, its rows, the place of the first of them, the group's rows.

    ``rows`` has present values only; ``weight`` is a column that says how many rows a row stands for.
    """
    by = list(by)
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*by, value).agg(many.alias("_c"))
    # The number of the range is read once and written, so all that follows sees the same ranges.
    ranged = cut_lineage(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_rows"))
    before, whole = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by)
    offsets = sums.select(*by, "_range", (F.sum("_rows").over(before) - F.col("_rows")).alias("_below"), F.sum("_rows").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    ordered = ranged.withColumn("_upto", F.sum("_c").over(inside))
    placed = null_safe_join(ordered, offsets, [*by, "_range"], "inner")
    return placed.select(*by, value, "_c", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_first"), "n")


def _differs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Where two columns differ; NULL equals NULL and NaN equals NaN."""
    out = pc.fill_null(pc.not_equal(left, right), pa.scalar(False)).to_numpy(zero_copy_only=False)
    out = out | (left.is_null().to_numpy(zero_copy_only=False) != right.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_floating(left.type):
        out &= ~pc.fill_null(pc.and_(pc.is_nan(left), pc.is_nan(right)), False).to_numpy(zero_copy_only=False)
    return out


def _running(by: list[str], value: str, weight: str) -> Callable:
    """Places within a sorted partition; the rows of one value are held until the next one begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, base = None, [], 0

        def closed() -> pa.RecordBatch:
            nonlocal base
            batch = pa.concat_batches([b for b, _, _ in held])
            new_key, new_value = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            w, index = batch.column(weight).to_numpy(), np.arange(len(batch))
            pos = np.cumsum(w) - w
            start = np.maximum.accumulate(np.where(new_key, index, -1))
            pos = np.where(start >= 0, pos - pos[start], pos + base)
            of_value = np.cumsum(new_value) - 1
            first = np.flatnonzero(new_value)
            low, many = pos[first][of_value], np.add.reduceat(w, first)[of_value]
            base = int(pos[-1] + w[-1])
            added = [pa.array(a.astype(np.int64)) for a in (pos, low, many)]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_pos", "_low", "_c"])

        for batch in batches:
            if not len(batch):
                continue
            new_key = np.zeros(len(batch), bool)
            for name in (*by, value):
                column = batch.column(name)
                before = column[:1] if last is None else last.column(name)
                changed = _differs(column, pa.concat_arrays([before, column[:-1]]))
                if name == value:
                    new_value = new_key | changed
                else:
                    new_key |= changed
            if last is None:
                new_key[0] = new_value[0] = True
            last = batch.slice(len(batch) - 1)
            opened = np.flatnonzero(new_value)
            cut = int(opened[-1]) if len(opened) else 0
            if cut:
                held.append((batch.slice(0, cut), new_key[:cut], new_value[:cut]))
            if held and len(opened):
                yield closed()
                held = []
            held.append((batch.slice(cut), new_key[cut:], new_value[cut:]))
        if held:
            yield closed()

    return run


def ranked(rows: DataFrame, value: str, tie: str, by: Sequence[str], weight: str) -> DataFrame:
    """The rows with ``_rank`` (average over equal values), ``_first`` (their own place) and ``n`` (the group's weight).

    ``by, value, tie`` name a row, so a value that many rows share is dealt to as many
    ranges as it fills. One shuffle and one written table.
    """
    by = list(by)
    dealt = rows.repartitionByRange(*by, value, tie).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*by, value)
    added = [T.StructField(c, T.LongType()) for c in ("_pos", "_low", "_c")]
    placed = cut_lineage(dealt.mapInArrow(_running(by, value, weight), T.StructType([*dealt.schema.fields, *added])))
    edge = lambda v, c: F.struct(F.col(v).alias("v"), F.col(c).alias("c"))
    sums = placed.groupBy(*by, "_range").agg(
        F.sum(weight).alias("_rows"), F.min(value).alias("_v0"), F.max(value).alias("_v1"),
        F.min_by("_c", value).alias("_c0"), F.max_by("_c", value).alias("_c1"),
    )
    before, whole = Window.partitionBy(*by).orderBy("_range"), Window.partitionBy(*by)
    sums = sums.withColumns({"_below": F.sum("_rows").over(before) - F.col("_rows"), "n": F.sum("_rows").over(whole)})
    # A value of several ranges is the first or last one of each; the first may have begun before.
    both = F.when(F.col("_v0") == F.col("_v1"), F.array(edge("_v0", "_c0"))).otherwise(F.array(edge("_v0", "_c0"), edge("_v1", "_c1")))
    edges = sums.withColumn("_e", F.explode(both)).withColumns({"_v": F.col("_e.v"), "_k": F.col("_e.c")})
    same = Window.partitionBy(*by, "_v")
    edges = edges.withColumns({"_earlier": F.sum("_k").over(same.orderBy("_range")) - F.col("_k"), "_all_k": F.sum("_k").over(same)})
    offsets = cut_lineage(edges.groupBy(*by, "_range", "_below", "n", "_v0", "_v1").agg(
        F.min_by("_earlier", "_v").alias("_earlier"), F.min_by("_all_k", "_v").alias("_k0"), F.max_by("_all_k", "_v").alias("_k1")
    ))
    out = null_safe_join(placed, offsets, [*by, "_range"], "inner")
    v = F.col(value)
    low = F.col("_below") + F.col("_low") - F.when(v == F.col("_v0"), F.col("_earlier")).otherwise(0)
    many = F.when(v == F.col("_v0"), F.col("_k0")).when(v == F.col("_v1"), F.col("_k1")).otherwise(F.col("_c"))
    return out.select(*rows.columns, (low + (many + 1) / 2).alias("_rank"), (F.col("_below") + F.col("_pos")).alias("_first"), "n")


def quantiles_of(placed: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``by, n, quantiles`` of ``placed_values``, with linear interpolation between neighbours."""
    by = list(by)

    def wanted(i: int, p: float) -> list[Column]:
        at = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(at)
        return [
            F.struct(F.lit(i).alias("i"), low.cast("long").alias("place"), (1 - (at - low)).alias("w")),
            F.struct(F.lit(i).alias("i"), (low + 1).cast("long").alias("place"), (at - low).alias("w")),
        ]

    # Plain comparisons leave the few values that hold a place; only those are unfolded. A neighbour
    # without weight is left out: infinity times nothing would be NaN.
    held = lambda s: (s["w"] > 0) & (s["place"] >= F.col("_first")) & (s["place"] < F.col("_first") + F.col("_c"))
    all_wanted = [s for i, p in enumerate(probs) for s in wanted(i, p)]
    some = placed.filter(reduce(or_, [held(s) for s in all_wanted]))
    hits = some.select(*by, "n", F.col(value).alias("_v"), "_first", "_c", F.explode(F.array(*all_wanted)).alias("_s")).filter(held(F.col("_s")))
    # One value on both sides of the place is that value itself, without a sum.
    parts = hits.groupBy(*by, "n", F.col("_s.i").alias("_i"), "_v").agg(F.sum("_s.w").alias("_w"))
    term = F.when(F.col("_w") > 1 - 1e-12, F.col("_v")).otherwise(F.col("_v") * F.col("_w"))
    return parts.groupBy(*by).agg(
        F.first("n").alias("n"), F.array(*[F.sum(F.when(F.col("_i") == i, term)) for i in range(len(probs))]).alias("quantiles")
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a present value: ``by`` columns, ``n`` (present values), ``quantiles`` (array)."""
    by = list(by)
    if not by:
        found = selected(_present(df, value), "_q", [(p, p) for p in probs])
        rows = [(found.n, [found.quantile(p) for p in probs])] if found.n else []
        return df.sparkSession.createDataFrame(rows, "n LONG, quantiles ARRAY<DOUBLE>")
    rows = df.select(*by, F.col(value).cast("double").alias("_q")).filter(F.col("_q").isNotNull())
    return quantiles_of(placed_values(rows, "_q", by), "_q", probs, by)


#: A sketch's ranks are right to one in ``SKETCH`` of the rows; brackets reach four times as far.
SKETCH = 10_000
#: So few rows are one bracket: a wider one would not be a row wider than the error.
FEW = 2 * SKETCH
#: More rows than these in a bracket are bracketed again before they are collected.
BRACKET_ROWS = 1_000_000


class Selected(NamedTuple):
    """The distinct values of some brackets in order, and the place of the first row of each; ``n`` rows in all."""

    n: int
    values: np.ndarray
    first: np.ndarray

    def at(self, place: int) -> float:
        """The value at a place that lies in a bracket."""
        return float(self.values[np.searchsorted(self.first, place, "right") - 1])

    def quantile(self, p: float, start: int = 0) -> float:
        """With linear interpolation, over the places from ``start`` on."""
        place = (self.n - start - 1) * p
        low = math.floor(place)
        share, one = place - low, self.at(start + low)
        two = self.at(start + low + 1) if share > 0 else one
        # One value on both sides is that value itself, and a neighbour without weight is left out.
        return one if one == two or share < 1e-12 else one * (1 - share) + two * share

    def below(self, value: float) -> int:
        """How many rows lie below a value that is in a bracket."""
        return int(self.first[np.searchsorted(self.values, value, "left")])


def selected(rows: DataFrame, value: str, spans: Sequence[tuple[float, float]]) -> Selected:
    """What is needed to read any place between the shares of rows that ``spans`` name.

    ``rows[value]`` is a double without NULL. One scan sketches the column; the sketch is
    mergeable and a value it gives for a share is off by at most ``1 / SKETCH`` of the
    rows, so brackets a little wider hold every place wanted. A second scan counts the
    rows beside the brackets and, per distinct value, in them. A bracket of too many rows
    is counted only, and treated the same way again. NaN comes last.
    """
    v, reach = F.col(value), 4 / SKETCH
    number = F.when(~F.isnan(v), v)
    probs = [min(max(p, 0.0), 1.0) for low, high in spans for p in (low - reach, high + reach)]
    head = rows.agg(
        F.count(v).alias("n"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.percentile_approx(number, probs, SKETCH).alias("q"),
    ).first()
    n, numbers = head["n"], head["numbers"]
    brackets: list[list[float]] = []
    if numbers:
        edge = reach + 2 / numbers
        pairs = [(head["low"] if p <= edge else a, head["high"] if q >= 1 - edge else b) for p, q, a, b in zip(probs[::2], probs[1::2], head["q"][::2], head["q"][1::2])]
        pairs = pairs if numbers > FEW else [(head["low"], head["high"])]
        for a, b in sorted(pairs):
            if brackets and a <= brackets[-1][1]:
                brackets[-1][1] = max(b, brackets[-1][1])
            else:
                brackets.append([a, b])
    region = sum([(v > b).cast("int") + (v >= a).cast("int") for a, b in brackets], F.lit(0))  # odd inside a bracket
    wide = numbers > FEW and sum(q - p for p, q in zip(probs[::2], probs[1::2])) * numbers > BRACKET_ROWS
    grouped = rows.filter(~F.isnan(v)).groupBy(region.alias("region"), F.when((region % 2 == 1) & ~F.lit(wide), v).alias("v"))
    table = grouped.agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by([("region", "ascending"), ("v", "ascending")])
    found = zip(*[table[c].to_pylist() for c in ("region", "v", "c")])
    values, first, place = [], [], 0
    for at, one, count in found:
        if at % 2 and wide:
            a, b = brackets[at // 2]
            share = lambda p: min(max((p * (n - 1) - place) / max(count - 1, 1), 0.0), 1.0)  # noqa: B023, E731
            inner = [(share(p), share(q)) for p, q in spans if (q + reach) * n >= place and (p - reach) * n <= place + count]
            held = rows.filter(v.between(a, b))
            # A bracket of nearly all rows would not get narrower: its distinct values are counted as they are.
            inside = selected(held, value, inner) if count < 0.9 * n else _counted(held, value)
            values += inside.values.tolist()
            first += (inside.first + place).tolist()
        elif at % 2:
            values.append(one)
            first.append(place)
        place += count
    if n > numbers:
        values.append(math.nan)
        first.append(numbers)
    return Selected(n, np.array(values, float), np.array(first, np.int64))


def _counted(rows: DataFrame, value: str) -> Selected:
    table = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by(value)
    counts = table["c"].to_numpy()
    return Selected(int(counts.sum()), table[value].to_numpy(), np.cumsum(counts) - counts)


def _present(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).cast("double").alias("_q")).filter(F.col("_q").isNotNull())


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of a whole column as plain numbers (NULL values are left out)."""
    found = selected(_present(df, value), "_q", [(p, p) for p in probs])
    if not found.n:
        raise ValueError(f"no present value in {value!r}")
    return [found.quantile(p) for p in probs]


def trim_values(df: DataFrame, value: str, lo: float, hi: float) -> tuple[float, float]:
    """The ``lo`` quantile of a column, and the ``hi`` quantile of what that leaves, from the same two scans.

    At most a share ``lo`` of the rows is left out, so the second one lies between the
    ``hi`` quantile of all rows and that of all but ``lo``.
    """
    found = selected(_present(df, value), "_q", [(lo, lo), (hi, lo + (1 - lo) * hi)])
    if not found.n:
        raise ValueError(f"no present value in {value!r}")
    low = found.quantile(lo)
    inside = found.values[np.searchsorted(found.values, low, "left")]
    return low, found.quantile(hi, found.below(inside))


def ranks_of(placed: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by``, ``value`` and its average rank (ties share it) of ``placed_values``."""
    return placed.select(*by, value, (F.col("_first") + (F.col("_c") + 1) / 2).alias("_rank"))


def trim_bounds(
    rows: DataFrame, value: str, lo: float | None, hi: float | None, by: Sequence[str], sequential: bool = True, weight: str | None = None
) -> DataFrame:
    """``by, low, high``: quantiles of a group's values; NULL for a bound that is not asked for.

    ``sequential`` takes the upper one from the values that the lower one leaves. Both
    come from one placed table: what is left starts at the place of its first value.
    """
    by = list(by)
    placed = placed_values(rows, value, by, weight)
    none = F.lit(None).cast("double")
    out = placed.groupBy(*by).agg(F.first("n").alias("n")).drop("n").withColumns({"low": none, "high": none})
    if lo is not None:
        low = quantiles_of(placed, value, [lo], by).select(*by, F.col("quantiles")[0].alias("low"))
        out = null_safe_join(out.drop("low"), low, by, "left")
        if sequential:
            left = null_safe_join(placed, low, by, "inner").filter(F.col(value) >= F.col("low"))
            start = F.min("_first").over(Window.partitionBy(*by))
            placed = left.withColumn("_start", start).select(
                *by, value, "_c", (F.col("_first") - F.col("_start")).alias("_first"), (F.col("n") - F.col("_start")).alias("n")
            )
    if hi is not None:
        high = quantiles_of(placed, value, [hi], by).select(*by, F.col("quantiles")[0].alias("high"))
        out = null_safe_join(out.drop("high"), high, by, "left")
    return out.select(*by, "low", "high")
