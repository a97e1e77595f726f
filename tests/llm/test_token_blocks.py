"""Token files: exact round trips and ids equal to the tokenizer on whole texts."""

import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loomline.llm import token_blocks as T
from loomline.llm.queries import vocabulary_path

PATH = vocabulary_path(T.VOCABULARY)


def plain_ids(text):
    return T.encoder_of(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=3000), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    assert (T.unpack_block(T.pack_block(ids, percentile)) == ids).all()


def test_outliers_are_exceptions_and_width_is_that_of_the_percentile():
    ids = np.array([1000 + i % 8 for i in range(1000)] + [50_000] * 24, dtype=np.uint32)
    least, count, bits, exceptions = T.HEAD.unpack_from(T.pack_block(ids, 90))
    assert (least, count, bits, exceptions) == (1000, 1024, 3, 24)
    assert len(T.pack_block(ids, 90)) == T.HEAD.size + 1024 * 3 // 8 + 24 * 6
    assert T.HEAD.unpack_from(T.pack_block(ids, 100))[2:] == (16, 0)
    same = np.full(9, 7, dtype=np.uint32)
    assert len(T.pack_block(same)) == T.HEAD.size  # no bits at all


def test_a_damaged_block_is_refused():
    with pytest.raises(ValueError):
        T.unpack_block(T.pack_block(np.arange(100, dtype=np.uint32)) + b"x")


PARTS = ["a", "Bc", "é", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", " ", "　", ".", ",", "'s", "'",
         "1", "İ", "́", "\0", "ab", "<|endoftext|>", "\xa0", "\x85", "ß", ")", '"', "'ll", "漢字", "🙂"]


def test_chunks_give_the_ids_of_whole_texts():
    rng, encoder = random.Random(5), T.encoder_of(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(8000)]
    texts += ["x" * 3000, " " * 1000, "\n" * 999 + "a", "ab " * 4000]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert list(array("I", raw)) == plain_ids(text), text


ROWS = [(5, "Hello there.\n\nGeneral  words"), (None, "no id"), (3, None), (3, ""), (3, "again"), (3, "again"),
        (-7, "x y " * 5000), (9, "<|endoftext|> as text"), (1 << 40, "last")]


def test_files_hold_the_stream_in_order_of_ids(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in ROWS], "doc_id long, text string, start string, part int")
    listed = T.write_blocks(docs.repartition(3), PATH, T.block_folder(docs))
    got = sorted(T.read_blocks(listed, with_ids=True).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order == [None] + sorted(i for i, _ in ROWS if i is not None)
    start = 0
    for r in got:
        assert r["start"] == start
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    want = sorted((i is not None, i or 0, tuple(plain_ids(t) + [0])) for i, t in ROWS)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(array("I", r["ids"]))) for r in got) == want


def test_one_id_with_most_rows_is_spread_over_files(spark):
    docs = spark.range(4000).selectExpr("IF(id % 4 = 0, id, 1) AS doc_id", "'same text' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = T.write_blocks(docs, PATH, T.block_folder(docs)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["docs"] for r in listed) == 4000
    assert max(r["docs"] for r in listed) < 2000


def test_a_document_is_found_by_the_indexes(tmp_path):
    ids = [array("I", range(k, k + n)).tobytes() for k, n in ((0, 5), (9, 3000), (4, 1), (50, 2047))]
    path = tmp_path / "one"
    writer = T.BlockWriter(open(path, "wb"), 90.0)
    for i, raw in enumerate(ids):
        writer.add(i, raw)
    writer.close()
    with open(path, "rb") as stream:
        reader = T.BlockReader(stream, path.stat().st_size)
        for i in (3, 0, 2, 1):
            assert b"".join(p.tobytes() for p in reader.parts(i)) == ids[i]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_blocks(T.write_blocks(docs, PATH, T.block_folder(docs))).count() == 0
