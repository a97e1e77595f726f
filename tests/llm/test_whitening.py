"""Whitening next to integer covariances in plain Python and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from loomline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def plain(rows, components=8):
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(1024 * float(np.float32(e))) + 100000 for e in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n ** 3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    z = (np.array(y, dtype=float) / n) @ vectors[:, order] / np.sqrt(values[order])
    return kept, [sum(e * e for e in r) for r in y], z, values[order] / np.trace(cov), cov


def test_matches_plain_covariances(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * 0.2
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, [1.0] * 11 + [float("nan")]), (902, [1.0] * 11 + [float("inf")]),
             (903, [None] + [1.0] * 11), (5, rows[5][1])]
    kept, deviation, z, share, _ = plain(rows)
    got = W.whiten(table(spark, rows).repartition(5)).toPandas()
    assert len(got) == 8 * len(kept)
    by_row = sorted((i, int(d)) for (i, _), d in zip(kept, deviation))
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id, map(int, first.deviation))) == by_row
    for k in range(1, 9):
        part = got[got.component == k]
        want = sorted((i, v) for (i, _), v in zip(kept, z[:, k - 1]))
        have = sorted(zip(part.vec_id, part.whitened))
        sign = 1 if have[0][1] * want[0][1] > 0 else -1
        assert np.allclose([v for _, v in have], sorted_by(want, sign, have), atol=1e-9)
        assert math.isclose(part.explained.iloc[0], share[k - 1], rel_tol=1e-9)
    assert (got.n == len(kept)).all() and got.identity_error.max() < 1e-9


def sorted_by(want, sign, have):
    """Values of the plain version in the order of ``have``; rows of one id by value."""
    flipped = sorted((i, sign * v) for i, v in want)
    assert [i for i, _ in flipped] == [i for i, _ in have]
    return [v for _, v in flipped]


@pytest.mark.parametrize("size", [1, 1 << 25, 1 << 30, 1 << 46, 1 << 60])
def test_square_sums_are_exact_at_every_size(size):
    rng = np.random.default_rng(size % 97)
    values = rng.integers(-size, size + 1, size=(W.ROWS, 3))
    assert W.square_sums(values) == [sum(int(e) ** 2 for e in c) for c in values.T]


def test_polarisation_recovers_cross_covariances():
    y = np.array([[3, -1, 4], [-1, 5, -9], [-2, -4, 5]])
    n = len(y)
    cov = W.covariances(W.pair_squares(y), 3, n)
    assert np.allclose(cov, (y.T @ y) / n ** 3, rtol=1e-15)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * (i % 3), float(i), -3.0]) for i in range(50)]
    kept, deviation, *_ = plain(rows)
    got = W.whiten(table(spark, rows)).filter("component = 1").collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: d for (i, _), d in zip(kept, deviation)}


def test_defined_cases(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, None)])).count() == 0
    one = W.whiten(table(spark, [(None, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [
        (None, 1, 0, None, 0.0), (None, 2, 0, None, 0.0)]
    ragged = W.whiten(table(spark, [(1, []), (2, [1.0]), (3, [0.5, 1.0])])).collect()
    padded = W.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0])])).collect()
    assert sorted(map(tuple, ragged)) == sorted(map(tuple, padded))
