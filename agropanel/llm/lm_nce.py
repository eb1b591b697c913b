"""A log-bilinear model of text, trained in numpy by noise-contrastive estimation.

Words fall into ``classes`` classes: the most frequent training words and the end
mark have a class each, the others go by a hash of their last two bytes. The model
predicts a class from the classes of the two words before it: the context vector is
the sum of two position matrices applied to their vectors, a class's score the
product with its output vector plus a bias. Within a class words follow their
smoothed training counts. Both parts add up to one, so scores are log10
probabilities of whole texts.

All training tokens count: words are counted by Spark, and so are the triples of
classes, at most ``classes ** 3`` rows whatever the corpus, which are what the
training needs. It runs on the driver in passes over the contexts; noise comes from
the class frequencies, and its expectation is taken over all classes in place of a
few samples. For scoring, batched matrix products over all contexts and a
log-softmax give a table of normalised log-probabilities.

Words with a share above ``1 / FREQUENT`` are at most that many and are looked up in
a broadcast table; all others are summed per document and joined by word.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, then one end mark. A
null text counts as empty and has the end mark only. Rows with a null ``doc_id`` are
held out. Rows that repeat a ``doc_id`` are scored each. Only the two named columns
are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .text_hash import text_bytes

FREQUENT = 1 << 18
HELD_WORDS = 400_000
END = b""  # no word is empty


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(True))


def words(data: np.ndarray) -> list[bytes]:
    return [*data.tobytes().lower().split(), END]


def tail_class(word: bytes, bins: int) -> int:
    """The class of a word without one of its own: by its last two bytes, punctuation left out."""
    core = word.rstrip(b".,;:!?\"')") or word
    return (core[-1] * 131 + (core[-2] if len(core) > 1 else 7) * 17 + 3) % bins


@dataclass
class Classes:
    """Classes 0 to ``len(own) - 1`` are words, the next ``bins`` hold the others; the last is the start of a text."""

    own: dict[bytes, int]
    bins: int

    @property
    def size(self) -> int:
        return len(self.own) + self.bins

    def lookup(self) -> "ClassOf":
        return ClassOf(self)


class ClassOf(dict):
    def __init__(self, classes: Classes):
        super().__init__(classes.own)
        self.own, self.bins = classes.own, classes.bins

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
            self.update(self.own)
        self[word] = found = len(self.own) + tail_class(word, self.bins)
        return found


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` of all texts; each task adds up what it reads, at most ``HELD_WORDS`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for data in text_bytes(batch.column(0)):
                counts.update(words(data))
                if len(counts) > HELD_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def triple_counts(texts: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of (class two before, class before, class), an array of ``(size + 1) ** 2 * size`` at most."""
    size, start = classes.size, classes.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.lookup()
        held: list[int] = []

        def flush() -> pa.RecordBatch:
            c = np.array(held, np.int64)
            held.clear()
            code = (c[:-2] * (size + 1) + c[1:-1]) * (size + 1) + c[2:]
            code, n = np.unique(code[c[2:] < start], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for data in text_bytes(batch.column(0)):
                held.append(start)
                held.append(start)
                held.extend(map(of.__getitem__, words(data)))
                if len(held) > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    rows = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size + 1) ** 3, np.float32)
    out[np.asarray(rows.column("code").combine_chunks())] = np.asarray(rows.column("n").combine_chunks())
    return out.reshape((size + 1) ** 2, size + 1)[:, :size]


@dataclass
class LogBilinear:
    """Vectors ``r`` of context classes, position matrices ``c``, output vectors ``q`` and biases ``b``."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def contexts(self) -> np.ndarray:
        """The vector of each pair of classes, in the order of ``triple_counts``."""
        far, near = self.r @ self.c[0], self.r @ self.c[1]
        return (far[:, None, :] + near[None, :, :]).reshape(-1, self.q.shape[1])

    def log_probabilities(self) -> np.ndarray:
        """log10 P(class | two classes before): batched products, normalised over classes."""
        context, out = self.contexts(), []
        for at in range(0, len(context), 4096):
            s = context[at : at + 4096] @ self.q.T + self.b
            s -= s.max(1, keepdims=True)
            out.append((s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10))
        return np.concatenate(out).astype(np.float32)


def train(counts: np.ndarray, *, width: int = 24, rounds: int = 60, noise: float = 20.0, rate: float = 0.05, seed: int = 3) -> LogBilinear:
    """Noise-contrastive estimation on the counted triples, by Adam."""
    size = counts.shape[1]
    rng = np.random.default_rng(seed)
    total = max(1.0, float(counts.sum(dtype=np.float64)))
    frequency = (counts.sum(0, dtype=np.float64) + 0.5) / (total + 0.5 * size)
    seen = np.flatnonzero(counts.any(1))
    model = LogBilinear(
        rng.normal(0, 0.1, (size + 1, width)), np.stack([np.eye(width), np.eye(width)]) * 0.5, rng.normal(0, 0.1, (size, width)), np.log(frequency),
    )
    shift = np.log(noise * frequency)
    first, second = {}, {}
    for step in range(1, rounds + 1):
        gr, gc, gq, gb = (np.zeros_like(x) for x in (model.r, model.c, model.q, model.b))
        context = model.contexts()
        for at in range(0, len(seen), 8192):
            rows = seen[at : at + 8192]
            n = counts[rows].astype(np.float64)
            v = context[rows]
            s = v @ model.q.T + model.b - shift
            p = 1 / (1 + np.exp(-s))
            # data: 1 - p for each true class; noise: -p for each expected noise class
            d = (n * (1 - p) - noise * n.sum(1, keepdims=True) * frequency * p) / total
            gq += d.T @ v
            gb += d.sum(0)
            dv = d @ model.q
            far, near = np.divmod(rows, size + 1)
            for k, place in enumerate((far, near)):
                gc[k] += model.r[place].T @ dv
                back = dv @ model.c[k].T
                order = np.argsort(place, kind="stable")
                at_place, begins = np.unique(place[order], return_index=True)
                gr[at_place] += np.add.reduceat(back[order], begins)
        for name, g in (("r", gr), ("c", gc), ("q", gq), ("b", gb)):
            first[name] = 0.9 * first.get(name, 0.0) + 0.1 * g
            second[name] = 0.99 * second.get(name, 0.0) + 0.01 * g * g
            m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.99**step)
            setattr(model, name, getattr(model, name) + rate * m / (np.sqrt(v) + 1e-8))
    return model


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", own_words: int = 96, bins: int = 64, **training,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train_texts = rows.where(~held_out(F.col("doc_id"))).select("text")
    vocabulary = cut_lineage(word_counts(train_texts))
    n, v = (x or 0 for x in vocabulary.agg(F.sum("c"), F.count("c")).first())
    frequent = {bytes(r["word"]): r["c"] for r in vocabulary.where(F.col("c") > n / FREQUENT).toLocalIterator()}  # fewer than FREQUENT words
    top = sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:own_words]
    names = [END, *[w for w, _ in top if w != END]]
    classes = Classes({w: k for k, w in enumerate(names)}, bins)
    counts = triple_counts(train_texts, classes)
    table = train(counts, **training).log_probabilities()
    # Within a class: (c + 0.5) over the class's sum; unseen words share one further place in each bin.
    sums = counts.sum(0, dtype=np.float64)
    places = _places(vocabulary, classes)
    inside = -np.log10(sums + 0.5 * places)
    base = -np.log10(n + 0.5 * (v + 1))
    shared = spark.sparkContext.broadcast((classes, table, inside, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table, inside, frequent = shared.value
        of, start = classes.lookup(), classes.size
        logs = {w: float(np.log10(c + 0.5)) for w, c in frequent.items()}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                whole, rare = [], []
                for row, data in enumerate(text_bytes(part.column(2))):
                    tokens = words(data)
                    c = np.array([start, start, *map(of.__getitem__, tokens)], np.int64)
                    by_class = table[c[:-2] * (start + 1) + c[1:-1], c[2:]].sum(dtype=np.float64) + inside[c[2:]].sum()
                    known = [logs[t] for t in tokens if t in logs]
                    whole.append((len(tokens), len(known), sum(known), by_class))
                    rare += [(row, w, k) for w, k in Counter(t for t in tokens if t not in logs).items()]
                uid = part.column(0)
                row_of = np.array([r for r, _, _ in rare], np.int64)
                nulls = lambda kind, k: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([uid, uid.take(pa.array(row_of))]), pa.concat_arrays([part.column(1), nulls(pa.int64(), len(rare))]),
                        pa.concat_arrays([nulls(pa.binary(), len(part)), pa.array([w for _, w, _ in rare], pa.binary())]),
                        pa.concat_arrays([pa.array([x[0] for x in whole], pa.int64()), pa.array([k for _, _, k in rare], pa.int64())]),
                        *(pa.concat_arrays([pa.array([x[k] for x in whole], kind), nulls(kind, len(rare))]) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))),
                    ],
                    names=["uid", "doc_id", "word", "n", "known", "log_counts", "by_class"],
                )

    parts = cut_lineage(
        rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
        .mapInArrow(run, "uid long, doc_id long, word binary, n long, known long, log_counts double, by_class double")
    )
    rare_words = vocabulary.where(F.col("c") <= n / FREQUENT)
    rare = (
        parts.where("word is not null").select("uid", "word", "n").join(rare_words, "word", "left")
        .groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"))
    )
    whole = parts.where("word is null").join(rare, "uid", "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs + F.col("n") * F.lit(float(base))).alias("base_score"), (logs + F.col("by_class")).alias("score"),
    )


def _places(vocabulary: DataFrame, classes: Classes) -> np.ndarray:
    """How many words each class has, and one more in each bin for the unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = np.unique([_class(classes, w) for w in batch.column(0).to_pylist()] or [0], return_counts=True)
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["class", "n"])

    out = np.zeros(classes.size)
    for row in vocabulary.select("word").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] = row["n"]
    out[len(classes.own) :] += 1
    out[: len(classes.own)] = 1
    return out


def _class(classes: Classes, word: bytes) -> int:
    own = classes.own.get(word)
    return len(classes.own) + tail_class(word, classes.bins) if own is None else own
