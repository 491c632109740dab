"""Nearest neighbours against all distances: ties, own rows, long and far vectors, tiny slices."""

import numpy as np
import pytest

from lattica.operators import scoring


def all_distances(x, y, one, two, k):
    out = []
    for i in range(len(x)):
        d = np.round(np.sqrt(((x[i] - y) ** 2).sum(-1)), 9)
        d[one[i] == two] = np.inf
        out += [(i, int(j), d[j]) for j in np.argsort(d, kind="stable")[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("shift", [0.0, 1e4, 1e8])
@pytest.mark.parametrize("cells", [1, 50, 4_000_000])
def test_closest_equals_all_distances(shift, cells):
    """Far from the origin the rough distances are off by more than the gaps; the bound keeps the right pairs."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=(60, 7)).round(2) + shift
    y[20:40] = y[5]
    x = np.concatenate([y[:15] + 1e-6, y[3:6], rng.normal(size=(5, 7)) + shift])
    one, two = np.arange(len(x)), np.arange(len(y)) + 2
    for k in (1, 5, 100):
        got = scoring.closest(x, y, one, two, k, cells)
        assert list(zip(*(c.tolist() for c in got))) == all_distances(x, y, one, two, k)


def test_closest_without_rows_or_numbers():
    none, some = np.zeros((0, 3)), np.array([[0.0, 1, 2], [np.nan, 1, 2], [np.inf, 0, 0]])
    assert [len(c) for c in scoring.closest(none, some, np.arange(0), np.arange(3), 2)] == [0, 0, 0]
    assert [len(c) for c in scoring.closest(some, none, np.arange(3), np.arange(0), 2)] == [0, 0, 0]
    got = scoring.closest(some, some[[0, 1, 2, 0]], np.arange(3), np.array([7, 8, 9, 10]), 2)
    assert [c.tolist() for c in got] == [[0, 0], [0, 3], [0.0, 0.0]]


def test_blocks_do_not_grow_with_the_rows():
    assert [scoring.blocks_of(n, 64) for n in (0, 500, 20_000, 100_000, 600_000)] == [1, 1, 10, 16, 16]
    assert scoring.blocks_of(100_000, 10_000) == 50 and scoring.blocks_of(6_000_000, 64) == 96


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, [float(x) for x in rng.integers(0, 4, 3)], k % 3) for k in range(60)], "id long, vec array<double>, label int")
    one, many = (sorted(map(tuple, scoring.nearest(rows, rows, 3, n).collect())) for n in (2000, 2))
    assert one == many and len(one) == 180
