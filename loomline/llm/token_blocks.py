"""Token-ID output (12): patched frame-of-reference blocks.

Texts are encoded, each followed by an end id, and the ids of all documents form one
stream in ascending ``doc_id`` order. The stream is cut over files, one a partition of
a range partitioning, and a file into blocks of ``BLOCK`` ids. A block is stored as

    least id u32 | ids u16 | bits u8 | exceptions u16 | bit-packed differences
    | positions u16 of the exceptions | their differences u32

where a difference is the id less the block's least id and ``bits`` is the width of
the difference at ``percentile``; wider ones are exceptions, packed as zero. A file is

    magic | blocks | block starts u64 | id starts u64, ids u8 null flags, doc ids i64 | footer

all little-endian; the block starts index the blocks, the id starts the documents, so
any document is read by seeking to its blocks. Task attempts write files of their own
name, and only the files of successful attempts enter the list that readers go by.

Encoding: a worker remembers the ids of the chunks between blanks, up to a bound. A cut before a blank
that a non-blank character follows, or that follows one, never lies inside a piece of the
byte-level tokenizer, so the ids are those of the whole text (tested); texts with other
runs of white space are cut only where white space begins.

Defined results: a null or empty text is the end id alone; rows of a null doc_id come
first; rows that repeat a doc_id follow each other by a hash of their text; long texts
are neither cut nor spread over files; an empty table gives no rows; other columns are
not used.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from loomline.session import fresh_dir, stage

VOCABULARY = "byte_bpe_50k.json"
MAGIC, BLOCK = b"PFOR0001", 1024
HEAD = struct.Struct("<IHBH")
FOOTER = struct.Struct("<QQQ8s")  # blocks, documents, place of the block starts
ENCODED_BYTES = 8 << 20  # texts encoded at a time
REMEMBERED = 2_000_000  # chunks that a worker remembers before it starts anew
# White space where a cut before a blank or line feed could fall inside a piece.
INSIDE = re.compile(r"\s[ \n](?!\S)")
RUNS = re.compile(r"(?<=\S)(?=\s)")
ENDING = re.compile(r"(.*[A-Za-z0-9])([.,;:!?)\"]+)", re.DOTALL)
WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")  # one piece with the blank before it
_encoders: dict[str, "ChunkEncoder"] = {}


def encoder_of(path: str) -> "ChunkEncoder":
    """The encoder of a worker process; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it shows,
    else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class ChunkEncoder(dict):
    """Ids of chunks as little-endian bytes, encoded when first asked for.

    A chunk that starts with neither a line feed nor NUL stands for itself with a blank
    before it; one that starts with NUL for what follows. Plain words are one piece of the
    tokenizer, so they go to its merges at once; marks after a word are pieces of their own.
    """

    def __init__(self, path: str) -> None:
        # Spark gives each worker one core; threads of the library would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.marks: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ending = None if chunk[-1:].isalnum() or len(chunk) > 64 else ENDING.fullmatch(chunk)
        if ending:
            word, marks = ending.groups()
            if marks not in self.marks:
                self.marks[marks] = self.whole(marks)
            ids = self[word] + self.marks[marks]
        elif WORD.fullmatch(chunk):
            piece = b" " + chunk.encode()
            ids = array("I", [t.id for t in self.merges.tokenize(
                piece.decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = self.whole(chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else " " + chunk)
        if len(chunk) <= 256:  # whole texts and long runs are not worth remembering
            self[chunk] = ids
        return ids

    def whole(self, text: str) -> bytes:
        coded = self.tokenizer.encode_batch_fast((text,), add_special_tokens=False)
        return array("I", coded[0].ids).tobytes()

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text, cut where no piece of the tokenizer can lie across."""
        if "\0" in text or any(s in text for s in self.special):
            return ["\0" + text]
        if INSIDE.search(text):
            found = RUNS.split(text)
            return ["\0" + found[0], *(c[1:] if c[0] == " " and c[1:2].strip() else "\0" + c for c in found[1:])]
        found = text.replace("\n", " \n").split(" ")
        found[0] = "\0" + found[0]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        gc.disable()  # a collection would walk all that is remembered
        found = self.__getitem__
        out = [b"".join(map(found, self.chunks(t))) for t in texts]
        gc.enable()
        return out


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes in a string column, or one row."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def pack_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """One block of at most 65535 ids."""
    least = int(ids.min())
    wide = ids.astype(np.int64) - least
    rank = min(len(wide) - 1, int(len(wide) * percentile / 100))
    bits = int(np.partition(wide, rank)[rank]).bit_length()
    out = np.nonzero(wide >> bits)[0]
    kept = wide.astype(np.uint32)
    kept[out] = 0
    flags = ((kept[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return b"".join((HEAD.pack(least, len(ids), bits, len(out)), np.packbits(flags, bitorder="little").tobytes(),
                     out.astype("<u2").tobytes(), wide[out].astype("<u4").tobytes()))


def unpack_block(data: bytes) -> np.ndarray:
    """The ids of a block."""
    least, count, bits, outliers = HEAD.unpack_from(data)
    at = HEAD.size
    size = -(-count * bits // 8)
    flags = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * bits, bitorder="little")
    ids = (flags.reshape(count, bits) @ (2.0 ** np.arange(bits))).astype(np.uint32)  # exact below 2**53
    at += size
    places = np.frombuffer(data, "<u2", outliers, at)
    ids[places] = np.frombuffer(data, "<u4", outliers, at + 2 * outliers)
    if at + 6 * outliers != len(data):
        raise ValueError("block does not end where its head says")
    return ids + np.uint32(least)


class BlockWriter:
    """Writes one file; holds one block of ids and the indexes."""

    def __init__(self, out: BinaryIO, percentile: float) -> None:
        self.out, self.percentile = out, percentile
        self.rest = bytearray()
        self.at, self.ids = len(MAGIC), 0
        self.block_starts, self.id_starts = array("Q"), array("Q")
        self.nulls, self.doc_ids = bytearray(), array("q")
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.id_starts.append(self.ids)
        self.nulls.append(doc_id is None)
        self.doc_ids.append(doc_id or 0)
        self.ids += len(ids) // 4
        self.rest += ids
        while len(self.rest) >= 4 * BLOCK:
            full = len(self.rest) // (4 * BLOCK)
            stream = np.frombuffer(bytes(self.rest[:full * 4 * BLOCK]), "<u4").reshape(full, BLOCK)
            for row in stream:
                self.block(row)
            del self.rest[:full * 4 * BLOCK]

    def block(self, ids: np.ndarray) -> None:
        data = pack_block(ids, self.percentile)
        self.block_starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.rest:
            self.block(np.frombuffer(bytes(self.rest), "<u4"))
        self.block_starts.append(self.at)
        self.id_starts.append(self.ids)
        for part in (self.block_starts.tobytes(), self.id_starts.tobytes(), bytes(self.nulls),
                     self.doc_ids.tobytes(),
                     FOOTER.pack(len(self.block_starts) - 1, len(self.doc_ids), self.at, MAGIC)):
            self.out.write(part)
        self.out.close()


class BlockReader:
    """Documents of one file by their indexes; ``stream`` must be able to seek."""

    def __init__(self, stream: BinaryIO, size: int) -> None:
        self.stream = stream
        stream.seek(size - FOOTER.size)
        blocks, docs, at, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        stream.seek(at)
        self.block_starts = np.frombuffer(stream.read(8 * (blocks + 1)), "<u8").tolist()
        self.id_starts = np.frombuffer(stream.read(8 * (docs + 1)), "<u8").tolist()
        self.nulls = stream.read(docs)
        self.doc_ids = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
        self.held, self.ids = -1, np.empty(0, np.uint32)

    def block(self, number: int) -> np.ndarray:
        if number != self.held:
            start, end = self.block_starts[number:number + 2]
            self.stream.seek(start)
            self.held, self.ids = number, unpack_block(self.stream.read(end - start))
        return self.ids

    def parts(self, row: int) -> Iterator[np.ndarray]:
        """The ids of a document, block by block."""
        at, end = self.id_starts[row], self.id_starts[row + 1]
        while at < end:
            ids = self.block(at // BLOCK)[at % BLOCK:at % BLOCK + end - at]
            yield ids
            at += len(ids)


FILES = "part long, path string, docs long, n_ids long, bytes long"


def write_blocks(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0,
                 percentile: float = 90.0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the ids of ``docs`` below ``folder`` (a URI); returns the list of files in
    order, ``start`` the number of ids in the files before."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # The hash and the place of a row only break up rows of one id over the range partitions.
    keyed = sized.withColumn("by", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("by"), F.asc("row")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = dealt.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        encoder, writer, name, part, docs_written = encoder_of(vocabulary), None, "", None, 0
        store, root = files.FileSystem.from_uri(folder)
        end = struct.pack("<I", end_id)
        for batch in batches:
            for some in by_bytes(batch, 1, ENCODED_BYTES):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name, part = f"{uuid.uuid4().hex}.pfor", some.column(2)[0].as_py()
                    writer = BlockWriter(store.open_output_stream(f"{root}/{name}", compression=None), percentile)
                coded = encoder.encode(some.column(1).to_pylist())
                for doc_id, ids in zip(some.column(0).to_pylist(), coded):
                    writer.add(doc_id, ids + end)
                docs_written += some.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"], pa.string()),
                 *(pa.array([v], pa.int64()) for v in (docs_written, writer.ids, store.get_file_info(
                     f"{root}/{name}").size))], ["part", "path", "docs", "n_ids", "bytes"])

    written = stage(ordered.mapInArrow(run, FILES), "token_files")
    # One row a file: the only window over all of them.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_blocks(listed: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files, a task a file; ``with_ids`` adds the ids as bytes."""
    schema = DOCUMENTS + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for uri, first, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, path = files.FileSystem.from_uri(uri)
                with store.open_input_file(path) as stream:
                    reader = BlockReader(stream, size)
                    rows, held = [], 0
                    for i, doc_id in enumerate(reader.doc_ids):
                        crc, kept, n = 0, [], 0
                        for ids in reader.parts(i):
                            raw = ids.astype("<u4").tobytes()
                            crc, n = zlib.crc32(raw, crc), n + len(ids)
                            if with_ids:
                                kept.append(raw)
                        row = (None if reader.nulls[i] else doc_id, first + reader.id_starts[i], n, crc)
                        rows.append(row + ((b"".join(kept),) if with_ids else ()))
                        held += 4 * n if with_ids else 0
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    count = listed.count()
    return listed.select("path", "start", "bytes").repartition(max(1, count)).mapInArrow(run, schema)


def block_folder(docs: DataFrame) -> str:
    """A new folder for token files in the shared work folder, as a URI."""
    folder = fresh_dir(docs.sparkSession, "tokens")
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder
