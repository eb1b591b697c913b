"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

A byte-level BPE (A) encodes space + text, a piece model with byte fallback (B) the
text, to which it adds the space itself. Tokens are laid out by their bytes. Per batch
and keyed by document, ``merge_asof`` finds for each token start the token of the other
side that covers it; the union of both directions is the overlaps (links). Offsets at
which tokens of both sides end cut a document into groups.

How many documents hold an id pair linked is counted over the whole table. Documents
are worked on in blocks of about ``BLOCK_BYTES`` of text; a block writes its distinct
pairs once, with the number of its documents that hold each, and a document refers to
them by their place in the block. Counts therefore meet by pair in one aggregation over
blocks, go back to the blocks, and no row per document and pair is ever shuffled. The
highest count of each A id, one row per id of the vocabulary, is what is broadcast.

Texts are cut before each space that follows a letter, digit or ASCII mark. No token of
either side reaches across such a place: A's pattern ends a pre-token there, and no
piece of B has a space after another character (checked when the model is loaded; else
texts stay whole). So each word is encoded once while it is in a bounded cache. A block's
memory is bounded by ``BLOCK_BYTES`` or its one longer text.

A null or empty text, and one whose tokens' bytes are not space + text on either side
(B turns U+2581 into a space), has no tokens: zeros and an empty ``groups_sha256``.
Every row is a document, repeated ones too; a null ``doc_id`` stays null. Only the two
named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .tables import SMALL_BATCHES, settings

BLOCK_BYTES = 6 << 20
#: Texts aligned together; bounds the frames of one ``merge_asof``.
BATCH_BYTES = 1 << 20
CACHE_WORDS = 1_000_000
#: Characters of new words that go through a tokenizer as one text.
CHUNK = 1 << 15
ROWS_OUT = 1000
#: A document's number in its block and a pair share one 64-bit key.
PAIR_BITS = 43
#: A space after a letter, digit or ASCII mark, not at the end.
_CUT = re.compile(r"(?<=[!-~]|[^\W_]) (?=.)", re.DOTALL)

TABLE = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "slots array<int>, times array<int>, slot int, pair long, held int"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """A tokenizer's function from texts to id arrays, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list], table: list[bytes]):
        self.encode, self.table = encode, table
        self.lengths = np.array([len(t) for t in table], np.int64)

    def __len__(self) -> int:
        return len(self.table)


@lru_cache(maxsize=2)
def byte_side(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    value = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}
    entries = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    table = [bytes(value[c] for c in e) if all(c in value for c in e) else e.encode() for e in entries]
    return Vocabulary(lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)], table)


@lru_cache(maxsize=2)
def piece_side(path: str) -> tuple[Vocabulary, bool]:
    """The piece model, and whether texts may be cut before a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), table), cuttable


class Tokens:
    """Ids of both sides for each word met, a bounded cache that is kept from batch to batch.

    A word is what lies between two places where no token reaches across; its tokens do
    not depend on its neighbours, and it stands for itself with the space before it.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary, cuttable: bool):
        self.sides, self.cuttable = (a, b), cuttable
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.sound = np.zeros(0, bool)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _CUT.split(text) if self.cuttable else [text]

    def _learn(self, words: list[str]) -> None:
        """New words go through the tokenizers many at a time, as one text that is cut again at their ends."""
        together = [w for w in words if self.cuttable and (w[-1].isalnum() or "!" <= w[-1] <= "~")]
        alone = [w for w in words if not (self.cuttable and (w[-1].isalnum() or "!" <= w[-1] <= "~"))]
        size = np.cumsum([len(w) + 1 for w in together])
        chunks = np.split(np.array(together, object), np.searchsorted(size, np.arange(CHUNK, int(size[-1]), CHUNK)) if len(size) else [])
        chunks = [c.tolist() for c in chunks if len(c)]
        texts = [" ".join(c) for c in chunks]
        found = list(zip(*[side.encode([" " * (1 - k) + t for t in texts]) for k, side in enumerate(self.sides)])) if texts else []
        for chunk, text, ids in zip(chunks, texts, found):
            ends = np.cumsum([len(w.encode()) + 1 for w in chunk])
            cuts = [self._cuts(side, x, " " + text, ends) for side, x in zip(self.sides, ids)]
            if any(c is None for c in cuts):
                alone += chunk
                continue
            self._keep(chunk, [np.array(x, np.int32) for x in ids], cuts, np.ones(len(chunk), bool))
        if alone:
            ids = [side.encode([" " * (1 - k) + w for w in alone]) for k, side in enumerate(self.sides)]
            sound = np.ones(len(alone), bool)
            for side, own in zip(self.sides, ids):
                sound &= [b"".join(map(side.table.__getitem__, x)) == (" " + w).encode() for x, w in zip(own, alone)]
            flat = [np.fromiter((i for x in own for i in x), np.int32) for own in ids]
            self._keep(alone, flat, [np.cumsum([len(x) for x in own]) for own in ids], sound)

    @staticmethod
    def _cuts(side: Vocabulary, ids: list[int], text: str, ends: np.ndarray) -> np.ndarray | None:
        """How many ids lie before each end, if the ids are the text's bytes and some id ends there."""
        if b"".join(map(side.table.__getitem__, ids)) != text.encode():
            return None
        at = np.cumsum(side.lengths[ids])
        cuts = np.searchsorted(at, ends)
        return cuts + 1 if (at[cuts] == ends).all() else None

    def _keep(self, words: list[str], ids: list[np.ndarray], cuts: list[np.ndarray], sound: np.ndarray) -> None:
        for k in range(2):
            self.ends[k] = np.concatenate([self.ends[k], len(self.ids[k]) + cuts[k]])
            self.ids[k] = np.concatenate([self.ids[k], ids[k]])
        self.sound = np.concatenate([self.sound, sound])
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))

    def encode(self, texts: list[str | None]) -> Batch:
        """Ids of both sides of a batch; none for a text that either side does not give back."""
        if len(self.numbers) > CACHE_WORDS or len(self.ids[0]) > 8 * CACHE_WORDS:
            self.forget()
        cut = [self.words(t) for t in texts]
        flat = [w for ws in cut for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in self.numbers]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in cut])
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.sound[numbers]]] = True
        numbers, doc = numbers[~bad[doc]], doc[~bad[doc]]
        sides = []
        for ids, ends in zip(self.ids, self.ends):
            many = ends[numbers + 1] - ends[numbers]
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            sides.append((ids[inside + np.repeat(ends[numbers], many)].astype(np.int64), np.repeat(doc, many)))
        (a, doc_a), (b, doc_b) = sides
        return Batch(len(texts), a, b, doc_a, doc_b)


class Batch(NamedTuple):
    """Ids of both sides, document after document, and the document of each."""

    n: int
    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray


@lru_cache(maxsize=1)
def _words(ids: int) -> list[str]:
    """Decimal ids with each of the three separators: ``,`` ``|`` ``;``."""
    return [f"{i}{mark}" for i in range(ids) for mark in ",|;"]


class Aligned:
    """Links and groups of a batch of documents whose tokens are laid one after another."""

    def __init__(self, batch: Batch, a: Vocabulary, b: Vocabulary):
        n, self.a, self.b, self.doc_a, self.doc_b = batch
        self.many_a, self.many_b = np.bincount(self.doc_a, minlength=n), np.bincount(self.doc_b, minlength=n)
        self.ends_a, self.ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.width = len(b)
        self.ids = max(len(a), len(b))
        place = np.searchsorted(self.ends_b, self.ends_a)
        self.cut_a = self.ends_b[place] == self.ends_a if len(place) else np.zeros(0, bool)
        self.cut_b = np.zeros(len(self.b), bool)
        self.cut_b[place[self.cut_a]] = True
        self.groups = np.bincount(self.doc_a[self.cut_a], minlength=n)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and pair of every overlap; a pair is ``A id * size of B + B id``."""
        def side(ends: np.ndarray, doc: np.ndarray, name: str) -> pd.DataFrame:
            start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            return pd.DataFrame({"start": start, "doc": doc, name: np.arange(len(ends)), f"from_{name}": start})

        a, b = side(self.ends_a, self.doc_a, "a"), side(self.ends_b, self.doc_b, "b")
        over_a = pd.merge_asof(a, b, on="start", by="doc")
        over_b = pd.merge_asof(b, a, on="start", by="doc")
        over_b = over_b[over_b["from_a"] != over_b["start"]]  # equal starts are in the other direction
        at_a = np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()]).astype(np.int64)
        at_b = np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()]).astype(np.int64)
        return self.doc_a[at_a], self.a[at_a] * self.width + self.b[at_b]

    def texts(self) -> Iterator[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        upto_a = np.cumsum(np.bincount(group_a, minlength=1))
        below_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=1))])
        laid = np.zeros(len(self.a) + len(self.b), np.int64)
        laid[np.arange(len(self.a)) + below_b[group_a]] = self.a * 3 + self.cut_a
        laid[np.arange(len(self.b)) + upto_a[group_b]] = self.b * 3 + 2 * self.cut_b
        words, at = _words(self.ids), 0
        for many in (self.many_a + self.many_b).tolist():
            yield "".join(map(words.__getitem__, laid[at : at + many].tolist()))[:-1]
            at += many


class Block:
    """The documents gathered for one block, and their distinct pairs."""

    def __init__(self, number: int):
        self.number, self.size, self.count = number, 0, 0
        self.rows: list[list] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.many: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, texts: list[str | None], tokens: Tokens) -> None:
        n = len(texts)
        found = Aligned(tokens.encode(texts), *tokens.sides)
        doc, pair = found.links()
        key, times = np.unique(doc << PAIR_BITS | pair, return_counts=True)
        hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.texts()]
        self.rows.append([doc_ids, pa.array(found.many_a), pa.array(found.many_b), pa.array(found.groups), pa.array(np.bincount(doc, minlength=n)), pa.array(hashes, pa.string())])
        self.pairs.append(key & (1 << PAIR_BITS) - 1)
        self.times.append(times.astype(np.int32))
        self.many.append(np.bincount(key >> PAIR_BITS, minlength=n))
        self.size += sum(len(t or "") for t in texts)
        self.count += n

    def out(self) -> Iterator[pa.RecordBatch]:
        pairs, slots = np.unique(np.concatenate(self.pairs), return_inverse=True)
        held = np.bincount(slots, minlength=len(pairs)).astype(np.int32)
        slots, times = slots.astype(np.int32), np.concatenate(self.times)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.many))])
        columns = [pa.concat_arrays([r[i] for r in self.rows]) for i in range(6)]
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in TABLE.split(", ")])

        def batch(n: int, values: dict) -> pa.RecordBatch:
            values["block"] = pa.array(np.full(n, self.number))
            return pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        for at in range(0, self.count, ROWS_OUT):
            to = min(at + ROWS_OUT, self.count)
            lists = [pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), pa.array(v[ends[at] : ends[to]])) for v in (slots, times)]
            yield batch(to - at, dict(zip(schema.names[1:9], [*[c.slice(at, to - at) for c in columns], *lists])))
        for at in range(0, len(pairs), 1 << 17):
            to = min(at + (1 << 17), len(pairs))
            yield batch(to - at, {"slot": pa.array(np.arange(at, to, dtype=np.int32)), "pair": pa.array(pairs[at:to]), "held": pa.array(held[at:to])})


@lru_cache(maxsize=1)
def _tokens(byte_path: str, piece_path: str) -> Tokens:
    """One cache per worker process, kept from task to task."""
    return Tokens(byte_side(byte_path), *piece_side(piece_path))


def _blocks(byte_path: str, piece_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(byte_path, piece_path)
        if len(tokens.sides[0]) * len(tokens.sides[1]) >= 1 << PAIR_BITS:
            raise ValueError("the vocabularies have too many pairs of ids")
        first = TaskContext.get().partitionId() << 32
        block = Block(first)
        for batch in batches:
            sizes = np.array([len(t.as_py() or "") for t in batch.column(1)], np.int64)
            turn = (np.cumsum(sizes) - sizes) // BATCH_BYTES
            for at in np.flatnonzero(np.diff(turn, prepend=-1)):
                to = at + int((turn == turn[at]).sum())
                part = batch.slice(at, to - at)
                block.add(part.column(0), part.column(1).to_pylist(), tokens)
                if block.size >= BLOCK_BYTES or block.count >= 1 << 18:
                    yield from block.out()
                    block = Block(block.number + 1)
        if block.count:
            yield from block.out()

    return run


def _measure(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over a block's documents of what is known of its pairs."""
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    slot = pairs["slot"].to_numpy()
    count[slot], best[slot] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    lists, times = docs["slots"].combine_chunks(), docs["times"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    slots, times = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * values[slots])])[ends]) for values in (best, count)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([*[docs[c] for c in names[:5]], pa.array(sums[0]), pa.array(sums[1]), docs["groups_sha256"]], names=names)


def align(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens of both sides, groups, links and what the corpus says of its links."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        table = cut_lineage(rows.mapInArrow(_blocks(byte_path, piece_path), TABLE))
    held = table.where("pair IS NOT NULL").select("block", "slot", "pair", "held")
    counts = cut_lineage(held.groupBy("pair").agg(F.sum("held").alias("count")))
    a_id = F.expr(f"pair DIV {len(piece_side(piece_path)[0])}")
    # One row per id of A's vocabulary.
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    known = counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = held.join(known, "pair").select(F.col("block").alias("of_block"), "slot", "count", "best")
    own = table.where("pair IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    return own.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_measure, RESULT)
