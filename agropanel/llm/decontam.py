"""Benchmark passages in training text: BM25 over an inverted index of test items, with block-max bounds.

Test items are indexed by word (letters and digits, lower case). Every training
passage is a query: windows of twice an item's length, moved by that length, so any
stretch as long as the item lies whole in some window; items are indexed by length,
in powers of two, each with its own windows. An item's score is a share of what its
own text would score, so one threshold holds for all. Retrieval skips as block-max
WAND does: a window is left where the sum of its words' largest weights is below the
threshold, then block by block by the largest weights in the block, and only what
remains is scored item by item. No window that reaches the threshold is skipped.

What is retrieved is verified: an item's last sentence is its answer, the rest its
question (one sentence: question only). The pair stands where the window holds
``question`` of the question's word 4-grams and ``answer`` of the answer's, or
``whole`` of all of the item's.

The index is broadcast. How many items hold a word, the number of items and their mean
length are taken once over all items by Spark. Different item texts are then dealt to
shards of about ``index_bytes`` (one text, if that is longer), each built with those
counts and scanned over all documents: scores do not depend on the shards, to the bit.
Null, empty or wordless texts and items match nothing; rows without ``doc_id`` are
searched, and their pairs have a null id. Repeated rows give one pair, with the best
window. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .text_hash import batch_words, shingles

INDEX_BYTES = 32 << 20
WORDS_AT_ONCE = 200_000
BLOCK_ITEMS = 16
GRAM = 4
K1, B = 1.2, 0.75


def plain(column: pa.Array) -> pa.Array:
    """Lower case, with one space for whatever is neither letter nor digit."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), r"[^\p{L}\p{N}]+", " ")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line is the answer where there is more than one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Postings:
    """For each word of the vocabulary, places (items or blocks) and weights, one word after another."""

    ends: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, size: int, words: np.ndarray, place: np.ndarray, weight: np.ndarray) -> "Postings":
        order = np.lexsort((place, words))
        return cls(np.searchsorted(words[order], np.arange(size + 1)), place[order], weight[order])

    def lists(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of ``words``: for each the number of the word in the list, and its number here."""
        begin, many = self.ends[words], self.ends[words + 1] - self.ends[words]
        owner = np.repeat(np.arange(len(words)), many)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begin[owner]


@dataclass
class Level:
    """Items of one length class: weights as shares of each item's own score."""

    width: int
    items: np.ndarray
    top: np.ndarray
    blocks: Postings
    postings: Postings


@dataclass
class Index:
    words: np.ndarray
    levels: list[Level]
    parts: list[list[tuple[np.ndarray, int]]]


def _words(texts: list[str]) -> list[np.ndarray]:
    found = [np.zeros(0, np.uint64)] * len(texts)
    for row, w in batch_words(plain(pa.array(texts, pa.string()))):
        found[row] = w
    return found


@dataclass
class Counts:
    """Of all items: how many there are, their mean length, and how many hold each of ``words`` (sorted hashes)."""

    items: int
    mean: float
    words: np.ndarray
    held: np.ndarray

    def idf(self, vocabulary: np.ndarray) -> np.ndarray:
        held = self.held[np.searchsorted(self.words, vocabulary)]
        return np.log(1 + (self.items - held + 0.5) / (held + 0.5))


def build(texts: list[str], counts: Counts) -> Index:
    """The index of items given as texts, with the counts of all; item numbers are places in the list."""
    words = _words(texts)
    vocabulary = np.unique(np.concatenate(words or [np.zeros(0, np.uint64)]))
    lengths = np.array([len(w) for w in words], int)
    idf, mean = counts.idf(vocabulary), counts.mean
    levels = []
    classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for c in np.unique(classes[lengths > 0]):
        items = np.flatnonzero((classes == c) & (lengths > 0))
        rows, cols, values = [], [], []
        for n, i in enumerate(items):
            terms, tf = np.unique(words[i], return_counts=True)
            k = np.searchsorted(vocabulary, terms)
            w = idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
            rows.append(k)
            cols.append(np.full(len(k), n))
            values.append(w / w.sum())
        rows, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        top = np.zeros(len(vocabulary))
        np.maximum.at(top, rows, values)
        pair, place = np.unique(np.stack([rows, cols // BLOCK_ITEMS]), axis=1, return_inverse=True)
        highest = np.zeros(pair.shape[1])
        np.maximum.at(highest, place.reshape(-1), values)
        levels.append(Level(1 << int(c), items, top, Postings.of(len(vocabulary), *pair, highest), Postings.of(len(vocabulary), rows, cols, values)))
    parts = []
    for text, w in zip(texts, words):
        parts.append([(shingles(x, GRAM), min(GRAM, len(x))) for x in (*_words(list(split_item(text))), w)])
    return Index(vocabulary, levels, parts)


def _share(part: np.ndarray, width: int, grams: dict[int, np.ndarray]) -> float:
    """The share of a part's 4-grams in the window; a shorter part is one gram; no part is there."""
    return float(np.isin(part, grams[width]).mean()) if width else 1.0


def retrieve(index: Index, texts: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """``(text, item, score, words of the window)`` of every window and item that reach the threshold.

    A window is two stretches of ``width`` words, one after the other; a text that
    is shorter is one window. Sums count each word of a window once: those of the
    first stretch, and of the second what the first does not have.
    """
    lengths = np.array([len(w) for w in texts], int)
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    if not len(index.words) or not len(flat):
        return
    least, size = threshold - 1e-9, len(index.words)
    at = np.searchsorted(index.words, flat)
    at[at == size] = 0
    known = np.flatnonzero(index.words[at] == flat)
    text_at = np.repeat(np.arange(len(texts)), lengths)
    begins = np.cumsum(lengths) - lengths
    terms, owner = at[known], text_at[known]
    inside = known - begins[owner]
    for level in index.levels:
        many = np.maximum(1, -(-lengths // level.width))
        first = np.cumsum(many) - many  # a text's first stretch
        opens = np.zeros(int(many.sum()) + 1, bool)
        opens[first] = True
        # The last of several stretches opens no window of its own, nor does what lies behind all.
        closed = np.append((first + many - 1)[many > 1], len(opens) - 1)

        def both(own: np.ndarray, second: np.ndarray) -> np.ndarray:
            """Windows' sums from those of their two stretches."""
            total = own + np.append(np.where(opens, 0.0, second)[1:], 0.0)
            total[closed] = 0
            return total

        # First with repeated words, which needs no sort, then without.
        stretch = first[owner] + inside // level.width
        rough = np.bincount(stretch, level.top[terms], len(opens))
        near = both(rough, rough) >= least
        near[1:] |= near[:-1] & ~opens[1:]
        near = near[stretch]
        key = np.unique(stretch[near] * size + terms[near])
        if not len(key):
            continue
        stretch, word = np.divmod(key, size)
        before = np.searchsorted(key, key - size)
        new = opens[stretch] | (key[np.minimum(before, len(key) - 1)] != key - size)
        bound = both(np.bincount(stretch, level.top[word], len(opens)), np.bincount(stretch[new], level.top[word[new]], len(opens)))
        windows = np.flatnonzero(bound >= least)
        if not len(windows):
            continue
        number = np.full(len(opens), -1)
        number[windows] = np.arange(len(windows))
        follows = new & ~opens[stretch]
        window = np.concatenate([number[stretch], np.where(follows, number[stretch - 1], -1)])
        term = np.concatenate([word, word])[window >= 0]
        window = window[window >= 0]

        blocks = -(-len(level.items) // BLOCK_ITEMS)
        owner_of, entry = level.blocks.lists(term)
        cell, place = np.unique(window[owner_of] * blocks + level.blocks.place[entry], return_inverse=True)
        open_cells = cell[np.bincount(place, level.blocks.weight[entry], len(cell)) >= least]
        keep = np.isin(window, open_cells // blocks)
        window, term = window[keep], term[keep]
        if not len(term):
            continue
        owner_of, entry = level.postings.lists(term)
        item = level.postings.place[entry]
        keep = np.isin(window[owner_of] * blocks + item // BLOCK_ITEMS, open_cells)
        cell, place = np.unique(window[owner_of][keep] * len(level.items) + item[keep], return_inverse=True)
        score = np.bincount(place, level.postings.weight[entry][keep], len(cell))
        for c, s in zip(cell[score >= least], score[score >= least]):
            w, n = divmod(int(c), len(level.items))
            text = int(np.searchsorted(first, windows[w], "right")) - 1
            begin = (windows[w] - first[text]) * level.width
            yield text, int(level.items[n]), float(s), texts[text][begin : begin + 2 * level.width]


def verified(index: Index, texts: list[np.ndarray], threshold: float, question: float, answer: float, whole: float) -> list[tuple[int, int, float, float, float]]:
    """``(text, item, score, question share, answer share)`` of each verified pair, with its best window."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for text, item, score, window in retrieve(index, texts, threshold):
        grams = {k: shingles(window, k) for k in {size for _, size in index.parts[item] if size}}
        shares = [_share(part, size, grams) for part, size in index.parts[item]]
        if (shares[0] >= question and shares[1] >= answer) or shares[2] >= whole:
            best[text, item] = max(best.get((text, item), (-1.0, 0.0, 0.0)), (score, shares[0], shares[1]))
    return [(*pair, *found) for pair, found in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = 0.5, question: float = 0.6, answer: float = 0.5, whole_share: float = 0.8, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``doc_id, item_id, score, question_share, answer_share`` of every verified pair."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    # Equal texts are one entry of the index, however many items have it.
    texts = items.groupBy("text").agg(F.count(F.lit(1)).alias("items"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // index_bytes))
    texts = cut_lineage(texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")))
    words = cut_lineage(texts.select("shard", "items", "text").mapInArrow(_item_words, "shard int, word long, items long, length long"))
    whole = words.where("word is null").agg(F.sum("items").alias("items"), F.sum(F.col("items") * F.col("length")).alias("length")).first()
    per_word = words.where("word is not null").groupBy("word").agg(F.sum("items").alias("held"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for shard in range(shards):
        own = words.where(F.col("word").isNotNull() & (F.col("shard") == shard)).select("word").distinct().join(per_word, "word").toArrow()
        hashes = own["word"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        counts = Counts(whole["items"] or 0, max(1.0, whole["length"] / whole["items"]) if whole["items"] else 1.0, hashes[order], own["held"].to_numpy()[order])
        held = texts.where(F.col("shard") == shard).select("text").toArrow()["text"].to_pylist()
        held.sort()
        index = spark.sparkContext.broadcast(build(held, counts))
        pairs = rows.mapInArrow(_scan(index, threshold, question, answer, whole_share), "doc_id long, place int, score double, question_share double, answer_share double")
        # Few bytes per entry: the texts' hashes; a shard's texts have one place each.
        places = spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(held)], "place int, digest string")
        pairs = pairs.join(F.broadcast(places), "place").drop("place")
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("doc_id", "digest").agg(F.max(F.struct("score", "question_share", "answer_share")).alias("best"))
    named = items.select("item_id", F.sha2("text", 256).alias("digest")).distinct()
    pairs = best.join(named, "digest").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return pairs.select("doc_id", "item_id", "best.*")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text, and a row without word that has its length."""
    for batch in batches:
        items, shards = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        found = _words(batch.column(2).to_pylist())
        different = [np.unique(w) for w in found]
        row = np.repeat(np.arange(len(batch)), [len(w) for w in different])
        flat = np.concatenate([*different, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards[row]), pa.array(flat), pa.array(items[row]), pa.nulls(len(row), pa.int64())], names=["shard", "word", "items", "length"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards), pa.nulls(len(batch), pa.int64()), pa.array(items), pa.array([len(w) for w in found], pa.int64())], names=["shard", "word", "items", "length"]
        )


def _scan(index, threshold: float, question: float, answer: float, whole: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            held, rows, size = [], [], 0
            for row, words in (*batch_words(plain(batch.column(1))), (None, np.zeros(0, np.uint64))):
                if held and (row is None or size + len(words) > WORDS_AT_ONCE):
                    found = verified(index.value, held, threshold, question, answer, whole)
                    out += [(ids[rows[text]], *x) for text, *x in found]
                    held, rows, size = [], [], 0
                held.append(words)
                rows.append(row)
                size += len(words)
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "place", "score", "question_share", "answer_share"])

    return run
