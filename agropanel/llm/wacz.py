"""Web records in ZIP-packaged archives: written with revisits, read by range without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` has one gzip
member per WARC record, ``indexes/index.cdxj`` a line per record with its offset and
length. The reader takes the end of the file, follows the ZIP64 locator where there
is one, parses the central directory, finds both members and reads records by their
byte ranges; neighbouring ranges are read together, up to ``READ_BYTES`` at a time.

Of records with equal payloads (by SHA-256 and length) of ``revisit_bytes`` or more,
the one with the smallest ``page_id`` is a response; the others are revisits that
refer to it and carry no payload. A null html is an empty payload. A row without
``page_id`` cannot be referred to and is always a response; rows that repeat the
smallest ``page_id`` are all responses. A null url is left out of the header.

Archives go to a folder every executor can reach (``pyarrow.fs``: local paths,
hdfs, s3, gs). A task writes archives under names of its own, and only those of
tasks that succeeded are in the written list of archives, so a lost executor leaves
at most unlisted files. Only the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, cut_lineage
from .tables import lookup

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 4 << 20
ARCHIVE_BYTES = 1 << 30
READ_TASKS = 20_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; without a payload it is a revisit."""
    block = b"" if payload is None else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Payload-Length", str(size)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record; a response's payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None
    out = {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(fields["Payload-Length"]),
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        out["payload_bytes"] = len(out["payload"])
        if hashlib.sha256(out["payload"]).hexdigest() != out["payload_digest"]:
            raise ValueError(f"record {out['page_id']}: payload does not match its digest")
    return out


class Archive:
    """Writes one archive to a stream that need not seek."""

    def __init__(self, path: str):
        self.path, self.offset, self.lines = path, 0, []
        where, name = file_system(path)
        self.stream = where.open_output_stream(name)
        self.zip = zipfile.ZipFile(_Forward(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)

    def add(self, page: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 5, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page": page, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX_MEMBER, "\n".join(self.lines))
        self.zip.close()
        self.stream.close()


class _Forward:
    """What zipfile needs of a stream that only goes forward."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """``name -> (offset, length)`` of the stored members, from the central directory."""
    tail_at = max(0, size - (1 << 16) - 22 - 20 - 56)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[locator + 8 : locator + 16])[0]
        wide = source.read_at(56, at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory where its locator points")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, found, at = source.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, whole, names, extras, remarks = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:  # ZIP64: the values that do not fit, in this order
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = values.pop(0) if whole == 0xFFFFFFFF else whole
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if method == 0:
            local = source.read_at(30, header)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no member where the directory has {name}")
            found[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        at += 46 + names + extras + remarks
    return found


def marked(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, size, digest, refers_to``; revisits have no payload."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = cut_lineage(
        rows.where((F.col("size") >= revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    total = groups.agg(F.sum("copies")).first()[0] or 0
    out = lookup(rows, groups, "digest", total, "copies")
    revisit = F.coalesce(F.col("refers_to") < F.col("page_id"), F.lit(False))
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to")
    )


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``marked(...)`` rows; the written list ``path, records`` of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page, url, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive = Archive(f"{folder}/{uuid.uuid4().hex}.wacz")
                archive.add(page, record(page, url, payload, size, digest, refers))
                if archive.offset >= archive_bytes:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_pydict({"path": pa.array([a.path for a in done], pa.string()), "records": pa.array([len(a.lines) for a in done], pa.int64())})

    where, name = file_system(folder)
    where.create_dir(name, recursive=True)
    return cut_lineage(records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "path string, records long"))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record from the archives' indexes: ``path, at, length`` in the file."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, name = file_system(path)
            with where.open_input_file(name) as source:
                found = members(source, source.size())
                begin, _ = found[WARC_MEMBER]
                index_at, index_length = found[INDEX_MEMBER]
                lines = [json.loads(x) for x in source.read_at(index_length, index_at).split(b"\n") if x]
            for at in range(0, len(lines), 10_000):
                some = lines[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({"path": [path] * len(some), "at": [begin + x["offset"] for x in some], "length": [x["length"] for x in some]})


def _records(keep_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)))
            while rows:
                n = 1  # records one behind the other are one read
                while n < len(rows) and rows[n][0] == rows[0][0] and rows[n][1] == rows[n - 1][1] + rows[n - 1][2] and rows[n][1] + rows[n][2] - rows[0][1] <= READ_BYTES:
                    n += 1
                where, name = file_system(rows[0][0])
                with where.open_input_file(name) as source:
                    data = source.read_at(rows[n - 1][1] + rows[n - 1][2] - rows[0][1], rows[0][1])
                found = [parse_record(gzip.decompress(data[a - rows[0][1] : a - rows[0][1] + size])) for _, a, size in rows[:n]]
                for x in [] if keep_payload else found:
                    x["payload"] = None
                yield pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in found], kind) for k, kind in kinds.items()})
                rows = rows[n:]

    return run


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of the archives in ``path``."""
    tasks = max(1, min(archives.count(), READ_TASKS))  # a number, else so few rows would be put into one task
    entries = archives.select("path").repartition(tasks, "path").mapInArrow(_entries, "path string, at long, length long")
    return entries.mapInArrow(
        _records(payloads), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/wacz-{uuid.uuid4().hex}"
