"""Token ids as Parquet lists: delta-encoded ids, small pages with indexes, row groups of a set size.

A file holds documents in ascending ``doc_id`` order, and files follow one another
in that order. Ids are a list column in DELTA_BINARY_PACKED pages (data page
version 2, no dictionary for ids; the other columns keep theirs), so ids cost about
the bits they need and a reader can skip pages by their column and offset indexes.
Metadata (``doc_id``, ``n_tokens``, ``crc``) lies in columns of its own and is read
without touching an id.

A word's ids do not depend on its neighbours: the tokenizer drops white space and no
pre-token reaches across it. Ids are therefore looked up per white-space separated
word in a bounded cache, and only unseen words are encoded. ASCII letters are lowered
and a mark after a letter or digit is set apart before, which the tokenizer does too, so
that fewer words differ. The tokenizer's added tokens are found in texts, as it does by
default; a text batch that may hold one is not lowered.

A null text counts as empty and has the end id only. A null ``doc_id`` comes first.
Rows that repeat a ``doc_id`` stand in the order of their texts and may lie in several
files; only those whose texts begin alike share a task. Only the two named columns are
read.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder
from .tables import SMALL_BATCHES, settings
from .text_hash import text_bytes

CACHE_WORDS = 1_200_000
#: A word of its own for the end of a text: a byte that UTF-8 does not have.
END = b"\xff"
#: What every added token of the vocabulary begins with.
ADDED = b"<|"
_LETTER, _MARK, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Fixed value: the pattern that cuts words into pre-tokens in the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
ROWS_OUT = 500


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


class WordIds(dict):
    """A number for each white-space separated word (UTF-8 bytes) seen, and its ids in one array.

    Words of characters below U+0250 are lower-cased and cut into pre-tokens here, by
    the tokenizer's own pattern, and a pre-token goes to the tokenizer's model. All
    other words go through the whole tokenizer. Number 0 is the end of a text.
    """

    def __init__(self, vocabulary: str, end_id: int):
        import regex

        self.whole, self.end_id = _tokenizer(vocabulary), end_id
        self.model, self.byte_chars = self.whole.model.tokenize, _byte_chars()
        self.cut = regex.compile(PRE_TOKEN).findall
        self.pieces: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()
        self[END] = 0
        self.ids, self.ends, self.size = [self.end_id], [1], 1
        self.held, self.held_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self.ids += self.of(word)
        self.ends.append(self.held_ends[-1] + len(self.ids))
        number = self[word] = self.size
        self.size += 1
        return number

    def of(self, word: bytes) -> list[int]:
        """The ids of a word."""
        if word.isalpha():
            return [x.id for x in self.model(word.lower().decode())]
        text = word.decode("utf-8")
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            return [x.id for x in self.model("".join(map(self.byte_chars.__getitem__, text.lower().encode())))]
        if ADDED not in word and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text and "\x85" not in text and "\xa0" not in text and unicodedata.is_normalized("NFC", text))):
            if text.isprintable():
                return [i for p in self.cut(text.lower()) for i in self._piece(p)]
        return self.whole.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            seen = piece if piece.isascii() else "".join(map(self.byte_chars.__getitem__, piece.encode()))
            ids = [x.id for x in self.model(seen)]
            if len(piece) < 50:
                self.pieces[piece] = ids
        return ids

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given by number, one after another, and how many each has."""
        if self.ends:
            self.held = np.concatenate([self.held, np.array(self.ids, np.int32)])
            self.held_ends = np.concatenate([self.held_ends, np.array(self.ends, np.int64)])
            self.ids, self.ends = [], []
        many = self.held_ends[numbers + 1] - self.held_ends[numbers]
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return self.held[inside + np.repeat(self.held_ends[numbers], many)], many


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _words_of(vocabulary: str, end_id: int) -> WordIds:
    """One cache per worker process, kept from task to task."""
    return WordIds(vocabulary, end_id)


def words_of(texts: pa.Array) -> list[bytes]:
    """The words of all texts, with ``END`` after each text."""
    whole = b" \xff ".join([t.tobytes() for t in text_bytes(texts)]) + b" \xff "
    data = np.frombuffer(whole if ADDED in whole else whole.lower(), np.uint8)
    apart = np.flatnonzero(_MARK[data[1:-1]]) + 1
    apart = apart[_LETTER[data[apart - 1]] & _SPACE[data[apart + 1]]]
    return np.insert(data, apart, 32).tobytes().split()


def _crcs(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """The CRC-32 of each run of ids between two ends, as little-endian 32-bit numbers."""
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else b""
    return [zlib.crc32(raw[a:b]) for a, b in zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist())]


def _encode(vocabulary: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words_of(vocabulary, end_id)
        for batch in batches:
            for at in range(0, len(batch), ROWS_OUT):
                if len(known) > CACHE_WORDS:
                    known.forget()
                part = batch.slice(at, ROWS_OUT)
                numbers = np.fromiter(map(known.__getitem__, words_of(part.column(1))), np.int64)
                ids, many = known.gather(numbers)
                ends = np.concatenate([[0], np.cumsum(many)[numbers == 0]])
                crc = _crcs(ids, ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    names=["doc_id", "n_tokens", "crc", "ids"],
                )

    return run


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> str:
    """Encode every text, append ``end_id`` and write the files; ``path`` is new."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    with settings(docs.sparkSession, SMALL_BATCHES):  # leaves memory for the cache of words
        (
            ordered.mapInArrow(_encode(vocabulary, end_id), "doc_id long, n_tokens long, crc long, ids array<int>")
            .write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes)
            .option("parquet.page.size", page_bytes).option("parquet.enable.dictionary#ids.list.element", "false")
            .option("compression", "snappy").parquet(path)
        )
    return path


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True) -> DataFrame:
    """Documents with ids from ``first`` to ``last``; the bounds reach the row groups and pages."""
    rows = spark.read.schema("doc_id long, n_tokens long, crc long, ids array<int>").parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows if tokens else rows.drop("ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files, from the ids themselves.

    Sums run over each file's rows; the sums of all files before it, one row per
    file, are added. A file's rows are one range of ids, written by one task.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = np.asarray(ids.offsets)
            flat = np.asarray(ids.values)
            crc = _crcs(flat, ends)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = read(spark, path)
    place = rows.metadataColumn("_metadata")
    found = rows.select("doc_id", place["file_name"].alias("file"), place["row_index"].alias("place"), "ids").mapInArrow(
        measure, "doc_id long, file string, place long, n_tokens long, ids_crc32 long"
    )
    # A file's number is the number of its task, and tasks hold ascending ranges.
    plain = read(spark, path, tokens=False)
    files = plain.select(plain.metadataColumn("_metadata")["file_name"].alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("_all"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = files.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return found.withColumn("_inside", inside).join(before, "file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
