"""Phrases next to a plain count of all of them."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import phrase_mining as P

SCHEMA = "doc_id long, lang string, text string, n string, score int"


def plain(rows, rules):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + m])] += 1
    out = []
    for lang, f in counts.items():
        able = {g: a for g, a in f.items() if len(g) > 1 and a >= rules.least}
        gone = {g[i:i + m] for g, b in able.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)
                if 100 * b >= rules.cover * f[g[i:i + m]]}
        kept = []
        for g, a in able.items():
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]])
                                 for k in range(1, len(g)))
            if g not in gone:
                kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:rules.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, rules):
    df = spark.createDataFrame([(i, l, t, "x", 1) for i, (l, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, P.mine_phrases(df, rules).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def prose(seed, lines, words, phrases):
    rng = random.Random(seed)
    fixed = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) for _ in range(phrases)]
    for _ in range(lines):
        yield " ".join(rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randrange(1, 14)))


WORDS = ["a", "B", "c", "D.", "e,", "f\n", "é", "g\tg", "\x1c", "h!"]


@pytest.mark.parametrize("top,bits", [(3, 15), (40, 15), (2000, 25)])
def test_all_rounds_against_plain_counts(spark, monkeypatch, top, bits):
    monkeypatch.setattr(P, "BATCH_BYTES", 700)
    rules = P.Rules(least=3, top=top, filter_bits=bits)
    rows = [("en", t) for t in prose(1, 250, WORDS, 12)] + [(None, t) for t in prose(2, 120, WORDS[:5], 6)]
    rows += [("", "x y x y x y"), ("de", None), ("de", ""), ("fr", "one")] + [("en", "q r s t u")] * 40
    assert mined(spark, rows, rules) == plain(rows, rules)


def test_missing_parts_are_requested(spark):
    """``c d e`` is a poor prefix, since ``c`` is common, and yet the rest of a good phrase."""
    rows = [("en", "k c d e")] * 30 + [("en", f"c w{i}") for i in range(400)] + [("en", f"u{i} v{i}") for i in range(9) for _ in range(30)]
    rules = P.Rules(top=2)
    assert mined(spark, rows, rules) == plain(rows, rules)


def test_ties_go_by_bytes_of_the_phrase(spark):
    rows = [("en", f"{w} x{w}") for w in ("ä", "z", "Z1", "a", "\U0001f642") for _ in range(30)]
    got = mined(spark, rows, P.Rules(top=3))
    assert got == plain(rows, P.Rules(top=3))
    assert [g[2] for g in got] == ["a xa", "z xz", "z1 xz1"]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_000_001
    row = spark.range(1).selectExpr(f"{big}L AS a", f"{big + 5}L AS l", f"{big + 7}L AS r")
    assert row.select(P.ratio(row.a, row.l, row.r).alias("s")).first()["s"] == 2000000 * big // (2 * big + 12)


def test_shared_hashes_take_another_seed(spark, monkeypatch):
    honest = P.word_hashes

    def weak(words, lang, seed):
        h = honest(words, lang, seed)
        return np.ones(len(words), np.uint64) if seed == 0 else h

    monkeypatch.setattr(P, "word_hashes", weak)
    texts = spark.createDataFrame([(b"en", b"a b"), (b"en", b"b c.")], "lang binary, text binary")
    words, seed = P.count_words(texts, P.Rules())
    assert seed == 1 and words.count() == 4


def test_long_texts_and_empty_table(spark):
    rows = [("en", "one two three four five " * 20000), ("en", "z" * 200000)]
    assert mined(spark, rows, P.Rules()) == plain(rows, P.Rules())
    assert mined(spark, [], P.Rules()) == []
    assert mined(spark, [(None, None)], P.Rules()) == []
