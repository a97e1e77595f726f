"""WARC (10): archives written from pages and read back one gzip member per record.

Writing: a payload of ``min_revisit`` bytes or more that several pages share is
stored once, with the largest page id; the others become revisit records, which
keep the HTTP head and name the response. Equal payloads are found by SHA-1 with
partial aggregation, so a payload that a third of all pages share is one row per
task; the planner splits the join back if a digest is hot. Each task writes its
own archives, a new one once ``roll_bytes`` are full, under names no other
attempt uses. The list of archives is what the tasks return: archives of lost or
repeated attempts are in no list and never read.

Reading: one archive is one sequential job for a task, spread by file. Bytes are
decompressed as they come, a record ends where its content length says, and the
block and payload digests must agree, else the job fails. Memory is one record.

Defined results: null html is an empty payload; pages below the bound are all
responses, also if equal; rows that repeat a page id with one payload are all
responses; a null page id never wins; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomline.session import fresh_dir, stage

CRLF = b"\r\n"
URN = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode("ascii")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 date: str) -> bytes:
    """One WARC/1.1 record with an HTTP response block, uncompressed."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % len(payload))
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
        ("WARC-Profile", REVISIT if refers_to is not None else None),
        ("WARC-Refers-To", f"<{URN}{refers_to}>" if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [f"{k}: {v}".encode("utf-8") for k, v in fields if v is not None]
    return CRLF.join([b"WARC/1.1", *lines, b"", block, b"", b""])


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 1000,
                   roll_bytes: int = 32 << 20, level: int = 4,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; returns the list of
    archives ``(path, records, bytes)``, written once."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"),
                         F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = sized.withColumn("digest", F.when(
        F.octet_length("payload") >= min_revisit, F.sha1("payload")))
    shared = stage(keyed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "original"), "payloads")
    rows = keyed.join(shared, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, root = files.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, made, out, name = uuid.uuid4().hex, [], None, ""
        records = size = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, body, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"{attempt}-{len(made):05d}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record_bytes(page_id, url, body, refers_to, date))
                data += member.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", records, size))
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
             pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def members(stream: BinaryIO, chunk: int = 1 << 16) -> Iterator["Member"]:
    """The gzip members of a file in order, each to be read to its end."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        member = Member(stream, rest, chunk)
        yield member
        rest = member.finish()


class Member:
    """Decompressed bytes of one gzip member, on demand."""

    def __init__(self, stream: BinaryIO, first: bytes, chunk: int) -> None:
        self.stream, self.chunk = stream, chunk
        self.inflate = zlib.decompressobj(31)
        self.ready = bytearray()
        self.feed = first

    def more(self) -> bool:
        while not self.inflate.eof:
            data = self.feed or self.stream.read(self.chunk)
            self.feed = b""
            if not data:
                raise ValueError("archive ends inside a gzip member")
            got = self.inflate.decompress(data, self.chunk)
            self.feed = self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def line(self) -> bytes:
        while (at := self.ready.find(CRLF)) < 0:
            if not self.more():
                raise ValueError("record head is cut off")
        found = bytes(self.ready[:at])
        del self.ready[:at + 2]
        return found

    def exactly(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self.more():
                raise ValueError("record is shorter than its content length")
        found = bytes(self.ready[:size])
        del self.ready[:size]
        return found

    def finish(self) -> bytes:
        while self.more():
            pass
        if self.ready:
            raise ValueError("record is longer than its content length")
        return self.inflate.unused_data or self.feed


def fields_until_blank(member: Member) -> dict[str, str]:
    fields = {}
    while line := member.line():
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """Records of one archive; digests are verified on the way."""
    for member in members(stream):
        if not member.line().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = fields_until_blank(member)
        block = member.exactly(int(fields["content-length"]))
        if member.exactly(4) != CRLF + CRLF:
            raise ValueError("record does not end with two line breaks")
        if sha1_label(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
            raise ValueError(f"block digest differs in {fields['warc-record-id']}")
        head, _, payload = block.partition(CRLF + CRLF)
        http = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
        kind, size = fields["warc-type"], int(http[b"Content-Length"])
        stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != stated):
            raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
        number = fields["warc-record-id"][len(URN) + 1:-1]
        refers = fields.get("warc-refers-to")
        yield {"page_id": int(number) if number else None, "url": fields.get("warc-target-uri"),
               "payload_bytes": size, "payload_digest": stated.hex(), "record_type": kind,
               "refers_to": int(refers[len(URN) + 1:-1]) if refers else None,
               "payload": payload if kind == "response" else None}


RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives at ``path``, one task reading a file from front to back."""
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = files.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for record in read_records(stream):
                        rows.append(record)
                        held += len(record["payload"] or b"") if with_payload else 0
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    count = archives.count()
    return archives.select("path").repartition(max(1, count)).mapInArrow(run, schema)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared work folder, as a URI."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder
