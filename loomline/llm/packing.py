"""Packing (7): first-fit decreasing on a tournament tree of free space, in randomised groups.

Documents are tokenised where they are read; a document longer than a sequence is
cut into full sequences and one rest. Pieces go to groups by a hash of document id,
place and content, so neither rows of one id nor pieces of one document meet in a
group. One task packs one group: pieces in falling order of length, each
into the first sequence that has room, which a tournament tree over the free
space finds in O(log n). A group holds ``group_docs`` documents on average
however many there are, so tasks neither grow nor skew, and groups share nothing.

Ids are not shuffled: a piece carries its length and CRC, and with ``with_ids``
its ids. Words are tokenised once per worker and looked up after that; that equals
the tokenizer on the whole text because its pieces never cross white space.

Defined results: a null or empty text has no ids but the end id; a null doc_id
is a document like any other; rows that repeat a doc_id are packed each for
itself; very long texts are cut, never truncated; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 1_500_000  # chunks that a worker remembers before it starts anew
MARKS = rb".,#$%&*!|?:;()\"-"
PARTS = re.compile(rb"([" + re.escape(MARKS) + rb"]*)(.*?)([" + re.escape(MARKS) + rb"]*)", re.DOTALL)
LETTERS = re.compile(rb"[a-z]+")
_coders: dict[str, "WordIds"] = {}


def coder_of(path: str) -> "WordIds":
    """The coder of a worker process; it outlives a task, so words are coded once a worker."""
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


class WordIds(dict):
    """Ids of the chunks between white space as little-endian bytes, coded when first met.

    A chunk is coded as marks, word and marks, since the tokenizer never joins a letter or
    digit with a mark; the word goes by its lower case, as there. What does not fit this
    form once the tokenizer has normalised it, or might hold a special token, is coded as
    it is. A word of plain letters is one piece, so it goes to the merges at once.
    """

    def __init__(self, path: str) -> None:
        # Spark gives each worker one core; threads of the library would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalize, self.merges = self.tokenizer.normalizer.normalize_str, self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        parts = self.parts(chunk)
        if parts != (chunk,):
            ids = b"".join([self[p] for p in parts])
        elif LETTERS.fullmatch(chunk):
            ids = array("I", [t.id for t in self.merges.tokenize(chunk.decode("ascii"))]).tobytes()
        else:
            coded = self.tokenizer.encode_batch_fast((chunk.decode("utf-8"),), add_special_tokens=False)
            ids = array("I", coded[0].ids).tobytes()
        if len(chunk) <= 256:
            self[chunk] = ids
        return ids

    def parts(self, chunk: bytes) -> tuple[bytes, ...]:
        if LETTERS.fullmatch(chunk) or b"<" in chunk:
            return (chunk,)
        before, word, after = PARTS.fullmatch(chunk).groups()
        if not word.isascii():
            text = self.normalize(word.decode("utf-8"))
            if not text or not text[0].isalnum() or not text[-1].isalnum():
                return (chunk,)
        elif not word or not word[:1].isalnum() or not word[-1:].isalnum():
            return (chunk,)
        return tuple(p for p in (before, word.lower(), after) if p)

    def of(self, chunks: list[bytes], end_id: int) -> bytes:
        return b"".join(map(self.__getitem__, chunks)) + struct.pack("<I", end_id)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; ``lengths`` must fall. The tree's leaves are the
    free spaces of the bins, an inner node holds the larger of its two children."""
    leaves = 1
    while leaves < max(len(lengths), 1):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    placed = []
    for length in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < length:
                at += 1
        placed.append((at - leaves, capacity - free[at]))
        free[at] -= length
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return placed


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def tokenize_pieces(docs: DataFrame, vocabulary: str, sequence: int = 2048, end_id: int = 1,
                    with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id"
                    ) -> DataFrame:
    """One row per piece of at most ``sequence`` ids."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if len(coder) > REMEMBERED:
                    coder.clear()
                gc.disable()  # a collection would walk all that is remembered
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = coder.of((text or b"").split(), end_id)
                    total = len(ids) // 4
                    for start in range(0, total, sequence):
                        piece = ids[4 * start:4 * (start + sequence)]
                        out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece))
                gc.enable()
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, schema)


def pack(docs: DataFrame, vocabulary: str, sequence: int = 2048, end_id: int = 1,
         group_docs: int = 2048, seed: int = 7, with_ids: bool = False,
         text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` in it."""
    groups = max(1, -(-docs.count() // group_docs))  # pieces differ little in number from documents
    pieces = tokenize_pieces(docs, vocabulary, sequence, end_id, with_ids, text_col, id_col)
    grouped = pieces.withColumn("group", F.pmod(
        F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="group").sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True],
            kind="stable")
        placed = first_fit_decreasing(rows["length"].tolist(), sequence)
        return rows.assign(sequence_id=[(int(key[0]) << 32) + b for b, _ in placed],
                           offset=[o for _, o in placed])

    return grouped.groupBy("group").applyInPandas(run, schema)
