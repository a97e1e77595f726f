"""Mixing, packing, WARC and the pipeline."""

import gzip
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_jaccard_join import brute
from loomline.llm import mixing as M, packing as P, pii, quality_rules, warc as A
from loomline.llm.queries import vocabulary_path
from loomline.session import stage

# ---- mixing


def plain_targets(words, share=1.5, most=2.0):
    """Reshare by weight until no source is above its bound."""
    order = sorted(words, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left, target = set(), share * sum(words.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        target.update({s: left * weight[s] / total for s in open_})
        above = [s for s in open_ if target[s] > most * words[s] + 1e-9]
        if not above:
            return target
        for s in above:
            target[s] = most * words[s]
            full.add(s)
            left -= target[s]


def source_docs(spark, per_source=120):
    rows, i = [], 0
    for k, source in enumerate(["b", "a", None, "ä", "z", "B"]):
        for j in range(per_source * (8 if k == 0 else 1)):
            rows.append((i, " ".join(["w"] * (1 + (i * 7919) % 60)), source, "x"))
            i += 1
    rows += [(i, None, "a", "x"), (i + 1, "", "empty", "x"), (i + 2, "  ", None, "x"), (None, "w w", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def test_mix_meets_targets(spark):
    docs = source_docs(spark)
    got = M.plan_mixture(docs, shard_words=4000).collect()
    assert len(got) == docs.count()
    words = defaultdict(int)
    for r in got:
        words[r["source"]] += len((r["text"] or "").split())
    want = plain_targets(words)
    taken = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == words[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert len(r["copies"]) <= 2
        taken[r["source"]] += len(r["copies"]) * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    per_shard = Counter(c["shard"] for r in got for c in r["copies"])
    assert len(per_shard) == 32 and max(per_shard.values()) < 2 * min(per_shard.values())
    again = {(r["doc_id"], r["text"]): r["copies"] for r in M.plan_mixture(docs, shard_words=4000).collect()}
    assert again == {(r["doc_id"], r["text"]): r["copies"] for r in got}


def test_mixed_rows_and_edges(spark):
    docs = source_docs(spark, 20)
    mixed = M.mix_documents(docs)
    planned = M.plan_mixture(docs)
    assert mixed.columns == [*docs.columns, "shard"]
    assert mixed.count() == planned.select(F.sum(F.size("copies"))).first()[0]
    assert M.plan_mixture(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert M.plan_mixture(one).first()["target"] == 4.5


def test_draws_follow_the_law(spark):
    n, k, m = 30, 12, 9
    draws = spark.range(20_000).select(M.hypergeometric(
        F.lit(n), F.lit(k), F.lit(m), M.uniform(F.lit(5), F.col("id"))).alias("x"))
    seen = {r["x"]: r["count"] / 20_000 for r in draws.groupBy("x").count().collect()}
    from math import comb
    for x in range(m + 1):
        assert abs(seen.get(x, 0.0) - comb(k, x) * comb(n - k, m - x) / comb(n, m)) < 0.015
    assert [spark.range(1).select(M.hypergeometric(*map(F.lit, a), F.lit(0.5))).first()[0]
            for a in ((10, 10, 4), (10, 0, 4), (10, 4, 0), (10, 4, 10))] == [4, 0, 0, 4]


def test_tree_splits_quotas_exactly(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 333)], "rank int, quota long")
    leaves = M.split_quotas(quotas, 3, 1).collect()
    for rank, quota in ((1, 100), (2, 7), (3, 333)):
        spans = sorted((r["start"], r["quota"]) for r in leaves if r["rank"] == rank)
        at = 0
        for start, length in spans:
            assert start == at
            at += length
        assert at == quota
    totals = Counter()
    for r in leaves:
        totals[r["shard"]] += r["quota"]
    assert set(totals.values()) <= {55} and len(totals) == 8


# ---- packing


def texts():
    return [(1, "Hello world, it's 2024! <|endoftext|> ÄÖ é"), (2, None), (3, ""), (4, "x " * 5000),
            (5, "a b c\x1cd"), (5, "again the same id"), (None, "no id"), (6, "ſtraße İ Σας " * 50),
            (7, "#A<|ENDOFTEXT|>B. <|endoftext|>, (It's) don't'S. x\u0301. .\u0301a (…end…) $5.00, Ǆ. K's ½! \u0301x"),
            *[(10 + i, "some words of text " * (i % 40)) for i in range(300)]]


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("length", F.lit("x"))
    rows = P.pack(docs, vocabulary_path(), group_docs=50, with_ids=True).collect()
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))
        assert r["length"] == len(ids) <= 2048 and r["ids_crc32"] == zlib.crc32(r["ids"])
        made[r["doc_id"], r["doc_tokens"]] += ids
    want = {}
    for doc_id, text in texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc_id, len(ids)] = ids
    assert made == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.pack(docs.limit(0), vocabulary_path()).count() == 0


def test_every_letter_next_to_a_mark(spark):
    """Ids equal the tokenizer's for each character of the first planes between marks and letters."""
    coder = P.coder_of(vocabulary_path())
    chars = [chr(c) for c in range(0x21, 0x3100) if not chr(c).isspace()]
    chunks = [form.format(c) for c in chars for form in ("E{}.", ".{}e", "{}", "({})", "a{}b")]
    want = coder.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
    for chunk, enc in zip(chunks, want):
        if len(chunk.split()) == 1:
            assert coder[chunk.encode()] == struct.pack(f"<{len(enc.ids)}I", *enc.ids), chunk


def test_null_and_repeated_ids_are_spread_over_groups(spark):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, null, IF(id % 3 = 1, 7, id)) AS doc_id",
                                        "concat('text number ', id) AS text")
    groups = Counter(r["sequence_id"] >> 32 for r in P.pack(docs, vocabulary_path(), group_docs=300).collect())
    assert len(groups) == 10 and max(groups.values()) < 450


def test_first_fit_equals_a_plain_scan():
    import random
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    bins, want = [], []
    for length in lengths:
        at = next((i for i, used in enumerate(bins) if used + length <= 100), len(bins))
        bins += [0] * (at == len(bins))
        want.append((at, bins[at]))
        bins[at] += length
    assert P.first_fit_decreasing(lengths, 100) == want
    assert P.first_fit_decreasing([], 10) == []


# ---- WARC


def pages(spark):
    long = "ü" * 700
    rows = [(1, "http://a/1", long, 1), (2, "http://a/2", long, 1), (9, None, long, 1), (3, "http://b", "x" * 999, 1),
            (4, "http://c", "x" * 999, 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u v\r\nw", "y" * 300_000, 1),
            (7, "u v\r\nw", "y" * 300_000, 1), (None, "n", "y" * 300_000, 1), (8, "h", "a\r\n\r\nb\x00", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, records int")


def test_round_trip(spark):
    df = pages(spark)
    archives = A.write_archives(df, A.archive_folder(df), roll_bytes=2000)
    got = A.read_archives(archives).collect()
    key = lambda page, html: (page or 0, zlib.crc32((html or "").encode()))
    want = Counter()
    for r in df.collect():
        body = (r["html"] or "").encode()
        top = max((x["page_id"] for x in df.collect() if x["html"] == r["html"] and x["page_id"]), default=None)
        refers = top if len(body) >= 1000 and r["page_id"] != top else None
        want[r["page_id"], len(body), "revisit" if refers else "response", refers] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == want
    payloads = {key(r["page_id"], r["payload"].decode()) for r in got if r["payload"] is not None}
    assert payloads <= {key(r["page_id"], r["html"]) for r in df.collect()}
    assert archives.count() >= 1 and archives.agg(F.sum("records")).first()[0] == 11
    empty = A.write_archives(df.limit(0), A.archive_folder(df))
    assert A.read_archives(empty).count() == 0


def test_archives_are_standard_gzip_members():
    data = [A.record_bytes(i, f"http://x/{i}", b"body %d" % i, None, "2024-01-01T00:00:00Z") for i in range(3)]
    file = b"".join(gzip.compress(d) for d in data)
    assert gzip.decompress(file) == b"".join(data)
    records = list(A.read_records(io.BytesIO(file)))
    assert [r["payload"] for r in records] == [b"body 0", b"body 1", b"body 2"]
    for broken in (file[:-9], gzip.compress(data[0].replace(b"body", b"bodi")), gzip.compress(data[0] + b"more"),
                   gzip.compress(b"HTTP/1.1\r\n\r\n\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(A.read_records(io.BytesIO(broken)))
    heads = []
    for member in A.members(io.BytesIO(file), chunk=7):
        heads.append(member.line())
        while member.more():
            pass
        member.ready.clear()
    assert heads == [b"WARC/1.1"] * 3


# ---- pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    good = "The house on hill number {} is for the people that live in the town below and it was built of stone {}."
    rows = [(i, good.format(i, i) + f" Unique part {i * 7} is here for the reader {i}.", "en", f"s{i % 3}", 1)
            for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "s0", 1) for i in range(5)]
    rows += [(200, None, "en", "s0", 1), (201, "", None, None, None), (202, "too short", "en", "s1", 1),
             (203, "ip 42.144.35.254 " + rows[1][1].replace("house", "barn on the old road"), "en", None, 1),
             (None, rows[2][1], "en", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_against_plain_versions(spark):
    docs = corpus(spark)
    seen = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, ""), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == seen["documents"].dtypes
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    kept = ids(seen["quality_rules"])
    assert kept == ids(quality_rules.judge(seen["documents"]).filter("kept")) and not {200, 201, 202} & set(kept)
    good = seen["quality_rules"].collect()
    groups = brute([(r["doc_id"], r["text"]) for r in good if r["doc_id"] is not None], 80, 5)
    assert ids(seen["jaccard_join"]) == Counter(
        [i for i, (_, component) in groups.items() if i == component] + [None for r in good if r["doc_id"] is None])
    assert not set(range(100, 105)) & set(ids(seen["jaccard_join"]))
    hidden = {r["doc_id"]: r["text"] for r in seen["pii"].collect()}
    assert "42.144" not in hidden[203] and re.search(r"ip \d+\.\d+\.\d+\.\d+ ", hidden[203])
    assert ids(seen["pii"]) == ids(seen["jaccard_join"])
    mixed = ids(seen["mix_sources"])
    assert set(mixed) <= set(hidden) and max(mixed.values()) <= 2
    pieces = Counter(r["doc_id"] for r in seen["pack"].filter("start = 0").collect())
    assert pieces == mixed


def test_near_copies_of_four_fifths_are_dropped(spark):
    """Copies whose five-word Jaccard lies between 0.8 and 0.9, by one passage or by single
    words, go; those below 0.8 stay."""
    def grams(words):
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    def near(a, b):
        x, y = grams(a), grams(b)
        return len(x & y) / len(x | y)

    rng = random.Random(5)
    rows, gone, left = [], set(), set()
    for group in range(60):
        words = [f"w{group}x{i}" for i in range(rng.randrange(100, 401))]
        first = 1000 * group
        rows.append((first, " ".join(words), "en", "s", 1))
        left.add(first)
        for k in range(1, 9):
            copy, edits = list(words), rng.randrange(1, len(words) // 10)
            start = rng.randrange(len(words) - edits)
            for at in range(start, start + edits) if k % 2 else rng.sample(range(len(words)), max(1, edits // 4)):
                copy[at] = f"new{group}y{k}y{at}"
            value = near(words, copy)
            if 0.8 <= value < 0.9 or value < 0.65:
                rows.append((first + k, " ".join(copy), "en", "s", 1))
                (gone if value >= 0.8 else left).add(first + k)
                break
    assert len(gone) > 20
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert got == left


def test_pipeline_on_an_empty_table(spark):
    docs = corpus(spark).limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_extra_columns_survive(spark):
    docs = corpus(spark).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(7))
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, "")
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_words", "kept"]
        docs = stage(docs, name)
    assert docs.count() > 0 and {r["kept"] for r in docs.collect()} == {7}


def test_rows_that_repeat_an_id(spark):
    """Of rows with one id and text one stays, by a stated order; other texts of the id stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "b", "x"), (1, text, "a", "y"), (1, "quite another text of its own", "a", "x"), (2, text, "a", "x"),
            (None, text, "a", "x"), (None, text, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter([rows[1], rows[2], rows[4], rows[5]])
