"""Text quality by a generalised additive model with pairwise interactions.

Every text becomes a few counts and shares; each is cut into at most ``bins`` bins.
Cyclic boosting visits one feature after another, fits a tree of a few leaves to
the gradient over that feature's bins and adds a small step to its lookup table;
then the pairs with the greatest gain get tables of their own. A score is a sum of
table entries, looked up by bin.

Features come from the text alone. The fit uses at most about ``max_rows`` labelled
rows, picked by a hash of ``doc_id``; scores are for every row. A null text counts
as empty; empty texts and texts without words are scored like any other. Labels
without a document, null labels and rows without ``doc_id`` are left out of the
fit; without any labels of both kinds every score is the share of ones (0.5 where
there are none). Only the two named columns are read by ``scores``; ``keep_good``
returns all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .tables import SMALL_BATCHES, settings
from .text_hash import batch_words, shingles, text_bytes

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeats_in_a_row", "top_word", "repeated_triples", "upper_letters",
    "digits", "symbols", "sentence_marks", "lines_per_word", "bars_per_word", "repeated_lines",
)
_KIND = np.full(256, 1, np.uint8)
for _kind, _chars in enumerate((
    b"", b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?!'\"()-", b"#$%&*+/<=>@[]\\^_`{}~", b"|",
)):
    _KIND[list(_chars)] = _kind
_KIND[0x80:0xC0] = 0  # the second bytes of a character


def text_features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for row, data in enumerate(text_bytes(column)):
        kinds = np.bincount(_KIND[data], minlength=8)
        letters, chars = max(1, kinds[1] + kinds[2]), max(1, len(data))
        lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
        out[row, 6:9] = kinds[2] / letters, kinds[3] / chars, kinds[6] / chars
        out[row, 9] = kinds[5]
        out[row, 10:13] = len(lines), kinds[7], 1 - len(set(lines)) / len(lines) if lines else 0.0
        out[row, 1] = kinds[1] + kinds[2] + kinds[3]
    for row, words in batch_words(column):
        n = len(words)
        if n:
            times = np.unique(words, return_counts=True)[1]
            triples = shingles(words, 3)
            out[row, 0] = np.log1p(n)
            out[row, 2:6] = len(times) / n, (words[1:] == words[:-1]).sum() / n, times.max() / n, 1 - len(triples) / max(1, n - 2)
        out[row, [1, 9, 10, 11]] /= max(1, n)
    return out


@dataclass
class Gam:
    """Cut points per feature, a table per feature and per pair."""

    cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], "right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The step of each bin: greedy cuts of the bins into ``leaves`` runs, a Newton step in each."""
    runs = [(0, len(gradient))]
    g, w = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(runs):
            at = np.arange(a + 1, b)
            if len(at):
                gain = np.where((w[at] - w[a] >= least) & (w[b] - w[at] >= least), value(a, at) + value(at, b) - value(a, b), -1.0)
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = runs[best[1]]
        runs[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.empty(len(gradient))
    for a, b in runs:
        step[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return step


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table along both axes: its gain and the step of each cell."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    value = lambda a, b: a**2 / (b + 1.0)
    parts = []
    for x in (g, w):
        top, left, all_ = x[:-1, -1:], x[-1:, :-1], x[-1, -1]
        parts.append((x[:-1, :-1], top - x[:-1, :-1], left - x[:-1, :-1], all_ - top - left + x[:-1, :-1]))
    gain = sum(value(a, b) for a, b in zip(*parts)) - value(g[-1, -1], w[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.empty(gradient.shape)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        step[rows, cols] = gradient[rows, cols].sum() / (weight[rows, cols].sum() + 1.0)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, leaves: int = 3, rate: float = 0.15) -> Gam:
    """Cyclic boosting of the tables on rows ``x`` with labels ``y`` in 0 and 1."""
    points = lambda n: [np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) for k in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
    model = Gam(points(bins), pair_cuts=points(pair_bins))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    if len(y) == 0 or y.min() == y.max():
        model.base = float(np.log(share / (1 - share)))
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    place = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)
    slope = lambda: 1 / (1 + np.exp(-total))
    least = max(1.0, 0.0005 * len(y))
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = slope()
            step = rate * _tree(np.bincount(place[k], y - p, len(table)), np.bincount(place[k], p * (1 - p), len(table)), leaves, min(least, 1.0))
            table += step
            total += step[place[k]]
    coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.pair_cuts)]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    p = slope()
    wide = [k for k, c in enumerate(model.pair_cuts) if len(c)]
    gains = sorted(((_quadrants(cells(a, b, y - p), cells(a, b, p * (1 - p)))[0], (a, b)) for i, a in enumerate(wide) for b in wide[i + 1 :]), reverse=True)
    model.pairs = [pair for _, pair in gains[:pairs]]
    model.pair_tables = [np.zeros(cells(a, b, y).shape) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            p = slope()
            step = rate * _quadrants(cells(a, b, y - p), cells(a, b, p * (1 - p)))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the features of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            ends = np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with settings(docs.sparkSession, SMALL_BATCHES):
        return cut_lineage(rows.mapInArrow(run, "doc_id long, x array<float>"))


def held_out(doc_id) -> F.col:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """``doc_id, y`` of the labels to learn from: all, or about ``max_rows`` picked by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        "doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known.count()))) < max_rows)


def train(table: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 60_000) -> Gam:
    """The model of the labelled rows of ``features(...)``, from about ``max_rows`` of them at most."""
    rows = table.join(labelled(labels, label_col, max_rows), "doc_id").orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 60_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    table = features(docs, id_col, text_col)
    model = train(table, labels, max_rows=max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, max_rows: int = 60_000) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns.

    Features are taken of the rows to learn from, then of each row as it is scored.
    """
    # About max_rows ids at most, whatever the table.
    wanted = F.broadcast(labelled(labels, "quality", max_rows).select(F.col("doc_id").alias("_wanted")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(features(own.join(wanted, F.col("doc_id") == F.col("_wanted"), "left_semi")), labels, max_rows=max_rows)
    return docs.mapInArrow(_filter(model, docs.columns.index(text_col), least), docs.schema)


def _filter(model: Gam, text_at: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(model.score(text_features(part.column(text_at))) >= least))

    return run
