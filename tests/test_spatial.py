"""Eigenvalues and transforms against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import spatial


def laplacian(n, edges):
    m = np.zeros((n, n))
    for a, b in edges:
        m[a, a] += 1
        m[b, b] += 1
        m[a, b] = m[b, a] = -1
    return m


def test_second_eigenvalue_equals_numpy():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 40, 150):
        edges = {(int(rng.integers(k)), k) for k in range(1, n)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(n)}
        a, b = np.array(sorted(edges)).T
        assert abs(spatial.second_eigenvalue(n, a, b) - np.linalg.eigvalsh(laplacian(n, edges))[1]) < 1e-8
    path = np.arange(299)
    assert abs(spatial.second_eigenvalue(300, path, path + 1) - 4 * math.sin(math.pi / 600) ** 2) < 1e-9
    assert spatial.second_eigenvalue(1, np.array([], int), np.array([], int)) == 0


def test_laplacian_profile_equals_numpy(spark):
    rng = random.Random(4)
    grid = [(k, r, c, min(1.0, abs(r - 2) / 5 + abs(c - 2) / 5 + rng.random() / 10)) for k in range(6) for r in range(5) for c in range(6)]
    got = {(r.image_id, r.k): r for r in spatial.laplacian_profile(spark.createDataFrame(grid, "image_id long, r int, c int, v double"), [0.3, 0.6, -1.0]).collect()}
    connected = 0
    for k in range(6):
        for level, t in enumerate((0.3, 0.6, -1.0)):
            ids = {(r, c): n for n, (r, c) in enumerate(sorted((r, c) for i, r, c, v in grid if i == k and v <= t))}
            edges = [(n, ids[q]) for (r, c), n in ids.items() for q in ((r, c + 1), (r + 1, c)) if q in ids]
            m = laplacian(len(ids), edges)
            values = np.linalg.eigvalsh(m) if len(ids) else np.zeros(0)
            x = got[k, level]
            assert (x.vertices, x.edges, x.trace) == (len(ids), len(edges), round(np.trace(m)))
            assert x.trace2 == round(np.trace(m @ m)) and x.components == int((values < 1e-6).sum())
            assert abs(x.second - (values[1] if len(values) > 1 else 0)) < 1e-6
            connected += x.components == 1
    assert connected > 3


def test_eigenvalues_of_3x3_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, rng.normal(size=6))) for _ in range(50)] + [(2.0, 2.0, 2.0, 0.0, 0.0, 0.0), (3.0, 1.0, 1.0, 0.0, 0.0, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").select("*", F.array(*spatial.eigenvalues_3x3(*[F.col(x) for x in "abcdef"])).alias("v")).collect()
    for x in got:
        want = np.linalg.eigvalsh([[x.a, x.d, x.e], [x.d, x.b, x.f], [x.e, x.f, x.c]])[::-1]
        assert np.abs(np.array(x.v) - want).max() < 1e-6


def test_weighted_transform_equals_counts(spark):
    rng = np.random.default_rng(6)
    v = rng.random((3, 4, 5))
    rows = [(1, z, y, x, float(v[z, y, x])) for z in range(3) for y in range(4) for x in range(5)] + [(2, 0, 0, 0, 0.1)]
    got = {(r.image_id, r.d, r.k): r.chi for r in spatial.weighted_euler_transform_3d(spark.createDataFrame(rows, "image_id long, z int, y int, x int, v double"), 5, 7).collect()}
    top = math.sqrt(3 * 3 + 4 * 4 + 5 * 5)
    z, y, x = np.mgrid[0:3, 0:4, 0:5]
    for d, (dx, dy, dz) in enumerate(spatial.spiral(5)):
        height = dx * (x - 2.5) + dy * (y - 2) + dz * (z - 1.5)
        for k, t in enumerate(np.linspace(-top, top, 7)):
            m = ((v > 0.5) & (height <= t + 1e-9)).astype(int)
            both = lambda a, b, c: sum(np.prod([m[i : 3 - a + i, j : 4 - b + j, l : 5 - c + l] for i in range(a + 1) for j in range(b + 1) for l in range(c + 1)], axis=0).sum() * 1 for _ in (0,))  # noqa: B023, E731, E741
            chi = sum((-1) ** (a + b + c) * both(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))
            want = chi * v[m == 1].mean() if m.any() else 0.0
            assert abs(got[1, d, k] - want) < 1e-9
    assert all(x == 0 for (i, *_), x in got.items() if i == 2)


def test_circle_weights_add_up():
    for points, radius in ((8, 1.0), (16, 2.0), (24, 3.0)):
        assert all(abs(sum(w for *_, w in p) - 1) < 1e-9 for p in spatial.circle(points, radius))
    assert spatial.circle(8, 1.0)[0] == [(0, 1, 1.0)] and spatial.circle(8, 1.0)[2] == [(-1, 0, 1.0)]


def test_laplacian_profile_by_rounds_and_in_one_pass(spark):
    """Images of both kinds, with gaps and nulls, and no shuffle but that by image for small ones."""
    rng = random.Random(8)
    grid = [(k, r, c, None if rng.random() < 0.1 else abs(r - 2) / 9 + abs(c - 2) / 9 + rng.random() / 10) for k in range(5) for r in range(3 + k) for c in range(6) if rng.random() < 0.95]
    grid = spark.createDataFrame([*grid, (9, 0, 0, 2.0)], "image_id long, r int, c int, v double")
    rows = lambda df: sorted((x.image_id, x.k, x.vertices, x.edges, x.trace, x.trace2, x.components, round(x.second, 8)) for x in df.collect())
    whole, mixed = (spatial.laplacian_profile(grid, [0.2, 0.5, 1.0], whole=n) for n in (1 << 20, 24))
    assert rows(whole) == rows(mixed) and len(rows(whole)) == 18 and any(x[-1] for x in rows(whole))
    fresh = spatial.laplacian_profile(grid, [0.2, 0.5, 1.0])  # a plan that has not run names each shuffle once
    assert str(fresh._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning") == 1
    assert rows(spatial.laplacian_profile(grid, [0.2, 0.5, 1.0], second=False).selectExpr("*", "0.0D as second")) == [(*x[:-1], 0.0) for x in rows(whole)]


def test_euler_curve_over_squares_is_that_of_cells(spark):
    """Images of several squares, with gaps, missing values and ties; no pixel becomes nine cells."""
    import random

    from pyspark.sql import functions as F

    from lattica.operators import grid as g

    rng = random.Random(3)
    rows = [(i, r, c, rng.choice([rng.random(), round(rng.random(), 1), -0.2]) if rng.random() > 0.01 * i else None) for i, (h, w) in enumerate([(64, 64), (65, 3), (8, 130), (1, 1)]) for r in range(h) for c in range(w) if rng.random() > 0.1 * i or r + c == 0]
    table = spark.createDataFrame(rows, "image_id long, r int, c int, v double")
    first = F.greatest(F.floor(F.col("entry") * 8).cast("int") + 1, F.lit(0))
    cells = g.cells_of(table).select("image_id", first.alias("k"), "sign").collect()
    got = {(r.image_id, r.k): r.chi for r in g.euler_curve(table, 9).collect()}
    assert got == {(i, k): sum(x.sign for x in cells if x.image_id == i and x.k <= k) for i in range(4) for k in range(9)}
    assert "sign" not in g.euler_curve(table, 9)._jdf.queryExecution().optimizedPlan().toString()


def test_minkowski_sorts_pixels_before_thresholds(spark):
    """Windows over a row for each pixel and threshold would sort ten times the pixels. Neighbours are the next pixels there are."""
    from lattica.operators import grid as g

    rng = random.Random(6)
    image = {(k, r, c): None if k == 3 and rng.random() < 0.2 else round(rng.random(), 1) for k in range(5) for r in range(3 + k) for c in range(6) if k != 4 or rng.random() < 0.7}
    got = g.minkowski(spark.createDataFrame([(*at, v) for at, v in image.items()], "image_id long, r int, c int, v double"), [0.0, 0.25, 0.5, 1.0])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("Window")
    found = {(x.image_id, x.t): x for x in got.collect()}
    assert len(found) == 20
    for (k, t), x in found.items():
        own = {(r, c): v for (i, r, c), v in image.items() if i == k}
        rows, columns = {r: sorted(c for y, c in own if y == r) for r, _ in own}, {c: sorted(r for r, z in own if z == c) for _, c in own}

        def near(r, c, dr, dc):
            line, at = (rows[r], rows[r].index(c) + dc) if dc else (columns[c], columns[c].index(r) + dr)
            return ((r, line[at]) if dc else (line[at], c)) if 0 <= at < len(line) else None

        fg = lambda p: int(p is not None and own[p] is not None and own[p] > t)
        volume = surface = chi = known = 0
        for p, v in own.items():
            if v is None:
                continue
            right, left, down, up = (near(*p, *s) for s in ((0, 1), (0, -1), (1, 0), (-1, 0)))
            across = right and near(*right, 1, 0)
            known, volume = known + 1, volume + fg(p)
            surface += fg(p) * (1 - fg(right) * fg(left) * fg(down) * fg(up))
            chi += fg(p) * (1 - fg(right) - fg(down) + fg(right) * fg(down) * fg(across))
        assert abs(x.volume - volume / known) < 1e-12 and abs(x.surface - surface / known) < 1e-12 and x.chi == chi
