"""Byte-level BPE by overlapping chunks, and the way back to bytes.

Texts are cut into chunks of ``chunk`` characters that run ``overlap`` characters into
the next one; most texts are one chunk. Chunks are pre-tokenised on their own. A
pre-token depends on the text from its start only, so from the first position where the
boundaries of two neighbours agree, the later chunk goes on exactly as one pass over the
whole text would. Stitching cuts both chunks there; by induction all pieces are those of
the whole text. Only then are they encoded, each chunk its own, and the ids put together.
What is stitched are positions: the chunks of long texts are written once and read for
either pass. Where neighbours never agree within the overlap (a run of one kind longer
than it), that document is pre-tokenised in one task.

A pre-token's ids are looked up in a bounded cache; the library sees single pre-tokens
only. A null text counts as empty and has no ids. Every row gives one row, also where
``doc_id`` is null or repeated. Unknown ids fail the decoding. Only the two named
columns are read. The vocabulary is read from ``vocabulary`` on each executor.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: A pre-token that ends this near to a chunk's end could go on behind it.
LOOK_AHEAD = 4
ROWS_OUT = 500
CACHE_PIECES = 100_000
IDS_AT_ONCE = 1 << 18


@lru_cache(maxsize=4)
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks(vocabulary), special_tokens={})


def chunks(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[at : at + chunk + overlap] for at in range(0, max(1, len(text)), chunk)]


@lru_cache(maxsize=4)
def pre_tokens(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, chunk: int, overlap: int, last: bool, pattern: str) -> tuple[list[int], list[int]]:
    """Ends of the pre-tokens of a chunk in its first ``overlap`` characters, and behind ``chunk`` (counted from there)."""
    head, tail = [0], []
    for match in pre_tokens(pattern).finditer(text):
        end = match.end()
        if end > len(text) - LOOK_AHEAD and not last:
            break
        if end <= overlap:
            head.append(end)
        if end >= chunk:
            tail.append(end - chunk)
    return head, tail


class Pieces(dict):
    """A number for each pre-token met, and its ids; each is encoded once while it is in this bounded cache."""

    def __init__(self, vocabulary: str, pattern: str):
        self.encode_one, self.find = encoder(vocabulary, pattern).encode_ordinary, pre_tokens(pattern)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[list[int]] = []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(self.encode_one(piece))
        number = self[piece] = len(self)
        return number

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as their pre-tokens, one after another, and how many lie before the end of each."""
        if len(self) > CACHE_PIECES or len(self.ids) > 8 * CACHE_PIECES:
            self.forget()
        bounds = np.cumsum([0] + [len(t) for t in texts])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(bounds[-1]))
        if self.new:
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in self.new])])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(self.new), np.int32)])
            self.new = []
        begin = self.ends[numbers]
        many = self.ends[numbers + 1] - begin
        upto = np.concatenate([[0], np.cumsum(many)])
        return self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], many)], upto[bounds]


@lru_cache(maxsize=1)
def _pieces(vocabulary: str, pattern: str) -> Pieces:
    """One cache per worker process, kept from task to task."""
    return Pieces(vocabulary, pattern)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _encode_texts(vocabulary: str, pattern: str) -> Callable:
    """``(doc_id, text)`` of one chunk each: there is nothing to stitch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary, pattern)
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                found = pieces.encode([pieces.find.findall(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(*found)], names=["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, uid, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = chunks(text, chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc] * len(some), pa.int64()), "uid": pa.array([uid] * len(some), pa.int64()),
                        "part": pa.array(range(at, at + len(some)), pa.int64()), "parts": pa.array([len(parts)] * len(some), pa.int64()), "text": some,
                    })

    return run


def _bounds(chunk: int, overlap: int, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            uid, part, parts, text = (batch.column(c).to_pylist() for c in ("uid", "part", "parts", "text"))
            found = [boundaries(t, chunk, overlap, p + 1 == n, pattern) for t, p, n in zip(text, part, parts)]
            columns = [pa.array([f[k] for f in found], kind) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), *columns], names=["uid", "part", "head", "tail"])

    return run


def _encode_parts(vocabulary: str, pattern: str) -> Callable:
    """``(uid, part, text, start, stop)``: the pre-tokens between both, which lie on boundaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary, pattern)
        for batch in batches:
            lists = []
            for text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop"))):
                own = []
                for match in pieces.find.finditer(text, start):
                    if match.start() >= stop:
                        break
                    own.append(match.group())
                lists.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), _lists(*pieces.encode(lists))], names=["uid", "part", "ids"])

    return run


def _encode_whole(chunk: int, vocabulary: str, pattern: str) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        pieces = _pieces(vocabulary, pattern)
        text = "".join(t[:chunk] for t in group.sort_values("part")["text"])
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].astype("Int64"), "ids": [pieces.encode([pieces.find.findall(text)])[0]]})

    return run


def stitched(bounds: DataFrame, chunk: int) -> DataFrame:
    """``uid, part, start, stop, sound``: where each chunk's own pieces lie; a text is not sound if two neighbours never agree."""
    by_part = Window.partitionBy("uid").orderBy("part")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(by_part)))
    met = bounds.withColumn("_last", F.lead("part").over(by_part).isNull()).withColumn("_meet", meet)
    start = F.coalesce(F.lag("_meet").over(by_part), F.lit(0))
    return met.select(
        "uid", "part", start.alias("start"), (chunk + F.coalesce("_meet", F.lit(2**30))).alias("stop"),
        F.every(F.col("_last") | F.col("_meet").isNotNull()).over(Window.partitionBy("uid")).alias("sound"),
    )


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id long, ids array<int>`` of every row."""
    if not LOOK_AHEAD < overlap < chunk:
        raise ValueError("the overlap must be longer than the look-ahead and shorter than a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, ids array<int>"
    single = rows.where(F.length("text") <= chunk).mapInArrow(_encode_texts(vocabulary, pattern), schema)
    cut = cut_lineage(
        rows.where(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
        .mapInArrow(_cut(chunk, overlap), "doc_id long, uid long, part long, parts long, text string").repartition("uid", "part")
    )
    bounds = cut.select("uid", "part", "parts", "text").mapInArrow(_bounds(chunk, overlap, pattern), "uid long, part long, head array<int>, tail array<int>")
    places = cut_lineage(stitched(bounds, chunk))
    own = cut.join(places.where("sound").drop("sound"), ["uid", "part"]).select("uid", "part", "text", "start", "stop")
    parts = own.mapInArrow(_encode_parts(vocabulary, pattern), "uid long, part long, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("part", "ids")))
    joined = parts.groupBy("uid").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))
    long = cut.where("part = 0").select("doc_id", "uid").join(joined, "uid").select("doc_id", "ids")
    rest = cut.join(places.where("not sound").select("uid").distinct(), "uid", "left_semi").groupBy("uid").applyInPandas(_encode_whole(chunk, vocabulary, pattern), schema)
    return single.unionByName(long).unionByName(rest)


class TokenBytes:
    """The bytes of every token, one after another."""

    def __init__(self, vocabulary: str):
        found = ranks(vocabulary)
        table = [b""] * (max(found.values(), default=-1) + 1)
        for token, rank in found.items():
            table[rank] = token
        self.known = np.array([bool(t) for t in table])
        self.ends = np.cumsum([0] + [len(t) for t in table])
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise KeyError("an id that the vocabulary does not have")
        return self.ends[ids + 1] - self.ends[ids]

    def joined(self, ids: np.ndarray, many: np.ndarray) -> bytes:
        """The bytes of ``ids`` of the lengths ``many``; some hundred thousand at a time."""
        out = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            own, n = ids[at : at + IDS_AT_ONCE], many[at : at + IDS_AT_ONCE]
            upto = np.cumsum(n)
            out.append(self.data[np.arange(upto[-1]) + np.repeat(self.ends[own] - upto + n, n)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _token_bytes(vocabulary: str) -> TokenBytes:
    return TokenBytes(vocabulary)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``bytes``: the tokens' bytes of ``ids``, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                many = tokens.lengths(ids)
                rows = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                ends = np.concatenate([[0], np.cumsum(many)])[rows]
                data = tokens.joined(ids, many)
                text = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, text.cast(pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
