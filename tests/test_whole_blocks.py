"""Blocks that one task holds: the same leaders, templates and vetoes as by parts."""

import random

import pytest

from loomline.operators import whole_blocks
from loomline.options import MinerOptions
from loomline.plans import mining
from loomline.session import stage

LEXICON = [("red", True, "JJ"), ("blue", True, "JJ"), ("door", True, "NN"), ("opens", True, "VBZ"), ("of", False, "IN"),
           ("the", False, "DT"), ("Up", None, "RB"), ("to", False, "TO"), ("Go", True, "VB")]
WORDS = [w for w, *_ in LEXICON] + ["x1", "X9", "AB", "CD", ":", "=", ",", "a_b", "camelCase", "n::m", "p/q", "<*>", "Über"]


def lines(spark, rows=260, seed=3):
    rng = random.Random(seed)
    heads = [[rng.choice(WORDS) for _ in range(n)] for n in (1, 2, 3, 5, 5, 8, 8, 8, 70)]
    made = [(i if i % 9 else None, " ".join(t if rng.random() < 0.7 else rng.choice(WORDS) for t in rng.choice(heads)))
            for i in range(rows)]
    return spark.createDataFrame(made + [(rows, ""), (rows + 1, None)], "line_id long, text string")


def mined(spark, options):
    lexicon = spark.createDataFrame(LEXICON, "token string, known boolean, tag string")
    found = mining.mine_templates(lines(spark), options, lexicon=lexicon)
    return sorted(map(str, found.templates.collect())), sorted(map(str, found.lineage.collect()))


@pytest.mark.parametrize("options", [
    MinerOptions(sim_th=0.0, reverse_blocks=False),
    MinerOptions(reverse_blocks=False, static_veto=True, dictionary_veto=True, pos_veto=True)])
def test_whole_blocks_equal_blocks_in_parts(spark, monkeypatch, options):
    whole = mined(spark, options)
    monkeypatch.setattr(whole_blocks, "TOKENS", 0)
    assert whole == mined(spark, options)


def test_blocks_are_compared_without_rows_for_pairs(spark, monkeypatch):
    """Few tables are written, whatever the blocks hold; a task may hold few rows at once."""
    written = []

    def kept(df, label="stage"):
        written.append(label)
        return stage(df, label)

    monkeypatch.setattr(mining, "stage", kept)
    want = mined(spark, MinerOptions())
    assert len(written) < 12
    monkeypatch.setattr(whole_blocks, "PIECE_TOKENS", 40)
    monkeypatch.setattr(whole_blocks, "TILE", 3)
    monkeypatch.setattr(whole_blocks, "WIDTH", 2)
    assert mined(spark, MinerOptions()) == want
