"""Operator 1: WARC archives whose records can be read one by one.

``write_archives`` makes archive files that are one gzip stream each, as many crawlers leave them; ``normalise`` inflates
such a file once, front to back, rewrites every record as a gzip member of its own, and writes a sidecar file (.idx:
offset, length, record id) beside it; ``read_records`` seeks to records by the sidecar's offsets.  Files lie in the shared
folder; every attempt of a task writes names of its own, and the tables of names that the steps return hold those of the
attempts that counted, so a lost executor leaves at most files that nothing reads.  A task holds one record and one
piece of a stream.

The reader takes any archive whose records have a length: header names in any case, with or without white space after
the colon, folded lines, bytes that aren't UTF-8.

Null payloads are empty.  Of records with equal payloads of at least ``least`` bytes that with the smallest id is a
response and the others are revisits that refer to it; shorter ones are responses.  Rows that repeat the smallest id
are responses each; a null id is never the smallest, and if equal payloads have null ids only, all are responses.
Null addresses are left out of the header; characters that a header line can't hold are percent-encoded.  An empty
table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MAY, arrow_batches, may_hold, new_path, released, write_table

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2026-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def inflate(source, piece: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, inflated once and piece by piece from a readable stream."""
    z, rest = zlib.decompressobj(31), b""
    while data := rest or source.read(piece):
        out = z.decompress(data)
        rest = z.unused_data
        if out:
            yield out
        if z.eof:
            z = zlib.decompressobj(31)
    if out := z.flush():
        yield out


def header_fields(block: bytes) -> dict[str, str]:
    """Fields of a record's or an HTTP header by lower-case name: any white space after the colon, folded lines joined,
    bytes that aren't UTF-8 as Latin-1; of a repeated field the first; lines without a colon are left out."""
    try:
        text = block.decode("utf-8")
    except UnicodeDecodeError:
        text = block.decode("latin-1")
    fields: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", text).splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """Whole records with their header fields from a stream; only the record being read is held."""
    buffer, need, fields, begin = bytearray(), 0, {}, 0
    for piece in pieces:
        buffer += piece
        while True:
            if not need:
                end = buffer.find(b"\r\n\r\n", begin)
                if end < 0:
                    begin = max(0, len(buffer) - 3)  # what was looked through is not looked through again
                    break
                if not buffer.startswith(b"WARC/"):
                    raise ValueError("no record begins here")
                fields = header_fields(bytes(buffer[:end]))
                need = end + 4 + int(fields["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need]), fields
            del buffer[:need]
            need = begin = 0
    if buffer:
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> Record:
    (whole, headers), *more = split_records(iter([record]))
    if more:
        raise ValueError("more than one record in a member")
    begin = whole.find(b"\r\n\r\n") + 4
    return Record(headers, whole[begin:-4])


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == "None" else int(name)


def with_references(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``.  Only payloads of likely revisits move, by
    (digest, id), so no group of copies meets."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = base.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = first.select("digest", "first")
    later = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("digest", "page_id", F.col("first").alias("refers_to")).distinct()
    marked = may_hold(base, "page_id", later.select(F.col("page_id").alias("id")))
    likely = F.col(MAY) | F.col("page_id").isNull()
    sure = marked.where(~likely).drop(MAY).withColumn("refers_to", F.lit(None).cast("long"))
    rest = marked.where(likely).drop(MAY)
    later = later.select(F.col("digest").alias("d"), F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "refers_to")
    on = (rest["digest"] == later["d"]) & (F.coalesce(rest["page_id"], F.lit(-(2**63))) == later["p"])
    return sure.unionByName(rest.join(later, on, "left").select("page_id", "url", "payload", "digest", "refers_to"))


class Mounted:
    """A mounted folder, by the few calls of Arrow's file systems that are used here."""

    @staticmethod
    def create_dir(path: str, recursive: bool = True) -> None:
        os.makedirs(path, exist_ok=True)

    @staticmethod
    def open_output_stream(path: str, compression: None = None):
        return open(path, "wb")

    @staticmethod
    def open_input_stream(path: str, compression: None = None):
        return open(path, "rb")

    open_input_file = open_input_stream


def storage(folder: str):
    """The file system and path of a folder that all executors reach; Arrow's file systems are loaded for others than
    mounted ones only, as they take memory in every worker."""
    scheme, colon, path = folder.partition(":")
    if not colon or "/" in scheme:
        return Mounted, folder
    if scheme == "file":
        return Mounted, "/" + path.lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if path.startswith("//") else f"{scheme}://{path}")


def attempt_name() -> str:
    """A name that no other attempt of any task has."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def write_archives(records: DataFrame, level: int = 3, archive_bytes: int = 4 << 20) -> DataFrame:
    """``(archive)``: paths of archives, each one gzip stream of about ``archive_bytes`` before compression."""
    folder = new_path(records.sparkSession, "monolithic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = storage(folder)
        name, n, held, z, sink, made = attempt_name(), 0, 0, None, None, []

        def close() -> None:
            sink.write(z.flush())
            sink.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    files.create_dir(path, recursive=True)
                    made.append(f"{path}/{name}-{n:05d}.warc.gz")
                    sink, z, held = files.open_output_stream(made[-1], compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                record = build(row[0], row[1], row[2], row[3], row[4])
                sink.write(z.compress(record))
                held += len(record)
                if held >= archive_bytes:
                    close()
                    sink, n = None, n + 1
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m.rsplit('/', 1)[1]}" for m in made], pa.string())], names=["archive"])

    with arrow_batches(records.sparkSession, 1000):
        return write_table(records.mapInArrow(lambda batches: released(run(batches)), "archive string"), "archives")


def normalise(archives: DataFrame, level: int = 3) -> DataFrame:
    """``(archive, sidecar, records)``: paths of archives with a member a record and of their sidecar files."""
    folder = new_path(archives.sparkSession, "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = storage(folder)
        name, n = attempt_name(), 0
        for batch in batches:
            for source in batch.column(0).to_pylist():
                files.create_dir(path, recursive=True)
                own, offset, lines = f"{name}-{n:05d}.warc.gz", 0, 0
                n += 1
                there, at = storage(source)
                with there.open_input_stream(at, compression=None) as stream, files.open_output_stream(f"{path}/{own}", compression=None) as sink, files.open_output_stream(f"{path}/{own}.idx", compression=None) as index:
                    for record, fields in split_records(inflate(stream)):
                        one = member(record, level)
                        sink.write(one)
                        index.write(f"{offset}\t{len(one)}\t{fields.get('warc-record-id', '')}\n".encode())
                        offset, lines = offset + len(one), lines + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{own}"]), pa.array([f"{folder}/{own}.idx"]), pa.array([lines], pa.int64())], names=["archive", "sidecar", "records"])

    # an archive is a row: rows are dealt one by one, so that no task gets many
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return write_table(spread.mapInArrow(lambda batches: released(run(batches)), "archive string, sidecar string, records long"), "normalised")


def sidecar(path: str) -> list[tuple[int, int, str]]:
    """(offset, length, record id) of every record of an archive."""
    files, at = storage(path)
    with files.open_input_stream(at, compression=None) as f:
        return [(int(a), int(b), c) for a, b, c in (line.split("\t", 2) for line in f.read().decode().splitlines())]


def record_at(source, offset: int, length: int) -> Record:
    """One record of an open archive, by its place alone."""
    source.seek(offset)
    return parse(zlib.decompress(source.read(length), 31))


def read_records(files: DataFrame) -> DataFrame:
    """Per record, read by offset: what the contract asks, with its place.  A response's digest is taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                there, at = storage(name)
                with there.open_input_file(at) as source:
                    for offset, length, _ in sidecar(index):
                        record = record_at(source, offset, length)
                        kind = record.headers["warc-type"]
                        begin = record.block.find(b"\r\n\r\n") + 4
                        size = int(header_fields(record.block[:begin])["content-length"])
                        digest = record.headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            payload = record.block[begin:]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: damaged payload at {offset}")
                        refers = record.headers.get("warc-refers-to")
                        rows.append((page_of(record.headers["warc-record-id"]), size, digest, kind, page_of(refers) if refers else None, name, offset, length))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"])

    spread = files.select("archive", "sidecar").repartition(max(1, files.count()), "archive")
    return spread.mapInArrow(lambda batches: released(run(batches)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = normalise(write_archives(with_references(pages, 100, "page_id", "url", "html")))
    return read_records(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.n >= 100 AND p.d = f.d
"""
