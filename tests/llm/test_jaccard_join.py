import itertools
import random

import numpy as np
import pytest

from loomline.llm import jaccard_join as J
from loomline.llm.components import connected_components
from loomline.session import stage

SCHEMA = "doc_id long, text string, n long, class_id string"


def sets_of(rows, size=3):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {b" ".join(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    return out


def brute(rows, percent=90, size=3):
    s = sets_of(rows, size)
    root = {i: i for i in s}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(s, 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s[i]), top(i)) for i in s}


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in J.join_similar(df, **settings).collect()}


def corpus(seed, copies=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for length in (1, 2, 3, 5, 9, 11, 12, 13, 14, 20, 21, 22, 23, 30, 60, 150):
        for _ in range(4):
            base = rng.choices(words, k=length)
            rows.append(" ".join(base))
            for _ in range(3):
                other = list(base)
                for _ in range(rng.choice((0, 1, 1, 2))):
                    at = rng.randrange(len(other) + 1)
                    if rng.random() < 0.5:
                        other[at:at] = rng.choices(words, k=rng.choice((1, 2)))
                    elif at < len(other) > 1:
                        del other[at]
                rows.append(" ".join(other))
    base = rng.choices(words, k=120)
    for _ in range(copies):  # a group with a long list for every shingle
        other = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            other[rng.randrange(120)] = rng.choice(words)
        rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("settings", [{}, {"heavy": 3, "bucket": 8}, {"heavy": 3, "bucket": 8, "counted": False}])
def test_equals_brute_force(spark, settings):
    rows = corpus(1)
    assert found(spark, rows, **settings) == brute(rows)


@pytest.mark.parametrize("settings", [{}, {"heavy": 3, "bucket": 8}, {"heavy": 3, "bucket": 8, "counted": False}])
def test_five_words_at_80_percent(spark, monkeypatch, settings):
    monkeypatch.setattr(J, "OWN_BUCKET", 4)
    monkeypatch.setattr(J, "PIVOTS", 2)
    rows = corpus(3, copies=90)
    passage = " ".join(f"p{i}" for i in range(60))  # one passage in many texts that do not link
    rows += [(1000 + i, f"{passage} " + " ".join(f"q{i}x{k}" for k in range(30))) for i in range(40)]
    assert found(spark, rows, percent=80, size=5, **settings) == brute(rows, 80, 5)


def test_order_puts_repeated_shingles_last(spark):
    rows = [(i, "one two three four " + f"own{i} word{i} here{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    order = J.frequency_order(docs.repartition(1), 3)
    signed = J.signatures(docs, 3, 80, order).collect()
    common = J.shingles(b"one two three", 3).view(np.int64)[0]
    assert all(common not in r["tokens"] and len(r["tokens"]) == J.prefix_size(r["n"], 80) for r in signed)


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c"),
            (8, "A\x0bB C"), (9, long), (10, long + " end"), (11, "a b c a b c a b c"),
            (12, "ä b c"), (13, "Ä b c"), (14, "a\xa0b c d")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}


def test_repeated_and_null_ids(spark):
    got = J.join_similar(spark.createDataFrame(
        [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")],
        "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [
        (0, 0), (1, 1), (1, 1), (2, 1)]


def test_boundary_has_a_cost(spark):
    short = [(i, " ".join(f"x{i}_{k}" for k in range(12))) for i in range(30)]
    signed = J.signatures(spark.createDataFrame(
        [(i, t.encode()) for i, t in short], "doc_id long, text binary"), 3, 90, np.zeros(1 << J.ORDER_BITS, np.uint8))
    assert 0 <= J.choose_boundary(signed, 90) <= J.SMALL_LIMIT
    assert J.subset_count(9, 90) == 2 and J.least_common(19, 20, 90) == 19


def test_blocks_equal_single_comparisons():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 60, 80, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.random(80) < 0.96], rng.integers(0, 2 ** 60, 2, dtype=np.uint64)])
            for _ in range(40)]
    a, b = J.linked_in_block(sets, 90, columns=16)
    want = {(i, j) for i, j in itertools.combinations(range(40), 2)
            if 100 * (c := J.common_of(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]) - c)}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_components_of_a_chain_and_a_star(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, i) for i in range(1001, 1050)] + [(7, 7), (5000, 5000)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1050)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_member_of_many_long_lists_is_one_row(spark, monkeypatch):
    """Joins by document meet one row a member; its lists are unfolded behind them."""
    written = {}

    def kept(df, label="stage"):
        out = stage(df, label)
        written.setdefault(label, out.count())
        return out

    monkeypatch.setattr(J, "stage", kept)
    lists = spark.createDataFrame([(t, d, 30) for d in range(50) for t in range(20)], "token long, doc long, n long")
    assert sorted(map(tuple, J.held_lists(lists).selectExpr("doc", "n", "size(tokens)").collect())) == [
        (d, 30, 20) for d in range(50)]
    sets = spark.createDataFrame([(d, np.arange(30 * (d % 2), 30 * (d % 2) + 30, dtype=np.uint64).tobytes())
                                  for d in range(50)], "doc long, set binary")
    got = connected_components(J.heavy_links(lists, sets, 90, 16))
    assert {r["node"]: r["component"] for r in got.collect()} == {d: d % 2 for d in range(50)}
    assert written["held"] == 50 and written["homes"] == 50


def test_members_of_a_list_go_only_where_their_place_lets_them_link(spark, monkeypatch):
    """A passage that many texts hold late in their prefixes does not bring each to all the others."""
    shown = []

    def kept(df, label="stage"):
        out = stage(df, label)
        if label == "sided":
            shown.append(out.count())
        return out

    monkeypatch.setattr(J, "stage", kept)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(passage + [f"q{i}x{k}" for k in range(rng.randrange(2, 9))]) for i in range(400)]
    texts += [" ".join([f"r{i}"] * (i % 2) + passage + [f"s{i // 40}x{k}" for k in range(12)]) for i in range(80)]
    rows = list(enumerate(texts))
    assert found(spark, rows, percent=80, size=5, heavy=4, bucket=8, counted=False) == brute(rows, 80, 5)
    assert 0 < shown[0] < 1000


def test_maps_lose_no_link():
    """Sets that link may link by their maps, also across widths; sets that share a passage may not."""
    rng = np.random.default_rng(5)
    base = J.mix(rng.integers(0, 2 ** 60, 130, dtype=np.uint64))
    sets = [np.unique(np.r_[base[rng.random(130) < p], J.mix(rng.integers(0, 2 ** 60, k, dtype=np.uint64))])
            for p in (1.0, 0.97, 0.93, 0.6) for k in (0, 3, 12, 200) for _ in range(6)] + [np.empty(0, dtype=np.uint64)]
    sizes = np.array([len(s) for s in sets])
    for percent in (40, 80, 90):
        a, b = J.may_link([J.parity_map(s) for s in sets], sizes, percent)
        able = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        linked = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in J.linked_in_block(sets, percent)))}
        assert linked and linked <= able
    assert len(able) < len(sets) * (len(sets) - 1) / 4  # most pairs go


def test_only_sets_that_may_link_are_made_whole(spark, monkeypatch):
    """A passage in many texts brings their maps together, not their whole sets."""
    made = []

    def kept(df, label="stage"):
        out = stage(df, label)
        if label == "wholes":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "stage", kept)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"q{i}x{k}" for k in range(30))) for i in range(300)]
    rows += [(1000 + i, " ".join([f"r{i}"] + [f"s{i // 2}x{k}" for k in range(60)])) for i in range(20)]
    assert found(spark, rows, percent=80, size=5, heavy=4, bucket=16, counted=False) == brute(rows, 80, 5)
    assert made and sum(made) < 60
