import itertools

import numpy as np
import pytest

from loomline.llm import lattice_dedup as L

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def brute(rows, threshold=0.95):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if L.usable(v)}
    links = {i: set() for i, _ in rows}
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
            for r in L.near_duplicates(df, **settings).collect()}


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    point = L.nearest_e8(x)
    twice = np.rint(point * 2)
    assert np.allclose(twice, point * 2)
    assert all(len(set(t % 2)) == 1 and t.sum() % 4 == 0 for t in twice)
    other = point[:, None] + L.minimal_vectors()[None]
    best = ((other - x[:, None]) ** 2).sum(-1).min(1)
    assert (((point - x) ** 2).sum(-1) <= best + 1e-9).all()


def test_groups_chains_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.05 * rng.normal(size=16)).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=16).tolist()) for i in range(40)]
    angle = np.arccos(0.96)  # a chain: neighbours link, others do not
    rows += [(200 + i, [float(np.cos(i * angle)), float(np.sin(i * angle))] + [0.0] * 14)
             for i in range(6)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, []),
             (304, [None] + [1.0] * 15), (305, base.tolist()), (306, base.tolist()),
             (307, (2 * base).tolist()), (308, [1.0, 0.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v])
            for i, v in rows]
    assert found(spark, rows, chunk=16) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        w = rng.normal(size=64)
        w -= (w @ u) * u
        v = 0.9505 * u + np.sqrt(1 - 0.9505 ** 2) * w / np.linalg.norm(w)
        rows += [(2 * i, u.tolist()), (2 * i + 1, v.tolist())]
    got = found(spark, rows)
    assert sum(n for n, *_ in got.values()) >= 0.97 * 600


def test_empty_table_and_repeated_ids(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]) == {
        1: (1, 1, True), 2: (1, 1, False)}


def test_null_id_is_returned(spark):
    got = found(spark, [(None, [1.0, 2.0]), (4, [1.0, 2.0])])
    assert got[4] == (0, 4, True) and None in got


@pytest.mark.parametrize("vector,usable", [([1.0], True), ([float("inf")], False), (None, False)])
def test_usable(vector, usable):
    assert L.usable(vector) is usable
