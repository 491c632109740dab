"""H0 and H1 against a union-find reference and known shapes; Euler numbers against both."""

import random

from pyspark.sql import functions as F

from lattica.operators import components, grid, persistence

WIDTH = 8


def pairs_h0(values, links):
    """Union-find: (birth, death) of components of a vertex-weighted graph; death None for the oldest."""
    order = sorted(values, key=lambda i: (values[i], i))
    place, parent, out = {i: k for k, i in enumerate(order)}, {}, []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in order:
        parent[i] = i
        for j in links[i]:
            if j in parent:
                a, b = sorted((root(i), root(j)), key=place.get)
                if a != b:
                    if values[b] < values[i]:
                        out.append((values[b], values[i]))
                    parent[b] = a
    return sorted(out) + [(values[order[0]], None)]


def image(seed, levels):
    r = random.Random(seed)
    return [[float(r.randrange(levels)) for _ in range(WIDTH)] for _ in range(WIDTH)]


def near(conn):
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (conn == 8 or a * b == 0)]
    return {r * WIDTH + c: [(r + a) * WIDTH + c + b for a, b in steps if 0 <= r + a < WIDTH and 0 <= c + b < WIDTH] for r in range(WIDTH) for c in range(WIDTH)}


def table(spark, images):
    return spark.createDataFrame([(k, r, c, v) for k, m in enumerate(images) for r, row in enumerate(m) for c, v in enumerate(row)], "image_id long, r int, c int, v double")


def test_h0_and_h1_match_union_find(spark):
    images = [image(s, n) for s in range(6) for n in (4, 1000)]
    got = persistence.persistence(table(spark, images)).collect()
    for k, m in enumerate(images):
        flat = {r * WIDTH + c: v for r, row in enumerate(m) for c, v in enumerate(row)}
        own = sorted((x.birth, x.death) for x in got if x.image_id == k and x.hdim == 0 and x.death is not None)
        assert own == pairs_h0(flat, near(8))[:-1]
        links = {i: list(x) for i, x in near(4).items()}
        links[-1] = [i for i in links if i // WIDTH in (0, WIDTH - 1) or i % WIDTH in (0, WIDTH - 1)]
        for i in links[-1]:
            links[i].append(-1)
        want = sorted((-d, -b) for b, d in pairs_h0({i: -v for i, v in flat.items()} | {-1: float("-inf")}, links)[:-1])
        assert sorted((x.birth, x.death) for x in got if x.image_id == k and x.hdim == 1) == want


def test_euler_curve_is_alternating_bar_count(spark):
    images = [image(s, 1000) for s in range(4)]
    images = [[[v / 1000 for v in row] for row in m] for m in images]
    g = table(spark, images)
    bars = persistence.persistence(g).collect()
    for x in grid.euler_curve(g, 16).collect():
        alive = [b.hdim for b in bars if b.image_id == x.image_id and b.birth < x.t and (b.death is None or x.t <= b.death)]
        assert x.chi == alive.count(0) - alive.count(1)


def test_known_shapes(spark):
    ring = [[1 if max(abs(r - 3), abs(c - 3)) == 2 else 0 for c in range(WIDTH)] for r in range(WIDTH)]
    two = [[1 if r < 2 and (c < 2 or c > 5) else 0 for c in range(WIDTH)] for r in range(WIDTH)]
    none = [[0] * WIDTH for _ in range(WIDTH)]
    m = table(spark, [[[float(v) for v in row] for row in x] for x in (ring, two, none)]).withColumn("fg", F.col("v").cast("int"))
    stats = {x.image_id: x.n for x in components.component_stats(m).collect()}
    holes = {x.image_id: (x.holes, x.fill_ratio) for x in components.holes_and_fill(m).collect()}
    euler = {x.image_id: x.chi for x in grid.euler_number(m, 8).collect()}
    assert stats == {0: 1, 1: 2, 2: 0} and euler == {0: 0, 1: 2, 2: 0}
    assert holes[0] == (1, 25 / 16) and holes[1] == (0, 1.0) and holes[2] == (0, 0.0)


def test_partition_count_does_not_matter(spark):
    g = table(spark, [image(s, 50) for s in range(3)])
    a, b = (sorted(map(tuple, persistence.persistence_h0(g.repartition(n)).collect()), key=str) for n in (1, 7))
    assert a == b


def test_images_wider_than_eight(spark):
    wide = [[float((c // 3) % 2) for c in range(20)], [0.0] * 20, [float(c % 4 == 1) for c in range(20)]]
    hole = [[float(max(abs(r - 5), abs(c - 9)) in (1, 4)) for c in range(20)] for r in range(11)]
    m = table(spark, [wide, hole]).withColumn("fg", F.col("v").cast("int"))
    got = {(x.image_id, x.r, x.c): x.label for x in components.mask_components(m).collect()}
    assert {x for (k, _, _), x in got.items() if k == 0} == {3, 9, 15} | {40 + c for c in (1, 5, 9, 13, 17)}
    assert all(got[0, 0, c] == c - c % 3 for c in range(20) if (c // 3) % 2) and len({x for (k, _, _), x in got.items() if k == 1}) == 2
    assert {x.image_id: x.holes for x in components.holes_and_fill(m).collect()} == {0: 0, 1: 2}
    bars = persistence.persistence(m).collect()
    assert sorted((x.hdim, x.birth, x.death) for x in bars if x.image_id == 1 and x.death is not None) == [(0, 0.0, 1.0)] * 2 + [(1, 0.0, 1.0)] * 2


def test_staircase_of_many_basins(spark):
    n = 70
    nodes = [(0, k, float(k)) for k in range(n)] + [(0, n + k, 1000.0 - k) for k in range(n - 1)]
    edges = [(0, n + k, j) for k in range(n - 1) for j in (k, k + 1)]
    got = persistence.persistence_h0_graph(spark.createDataFrame(nodes, "g int, id int, v double"), spark.createDataFrame(edges, "g int, a int, b int")).collect()
    assert sorted((x.birth, x.death) for x in got if x.death is not None) == [(float(k), 1001.0 - k) for k in range(1, n)]
    assert [x.birth for x in got if x.death is None] == [0.0]
