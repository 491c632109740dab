"""Filters over squares of images against plain loops, and how often they shuffle."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import pipelines
from lattica.operators import diagram, grid, pixels
from lattica.sources import views

SCHEMA = "image_id long, r int, c int, v double"


def shuffles(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def near(image, kernel):
    """(r, c) to the values that are there with their weights, mirrored once at borders."""
    h, wd = max(r for r, _ in image) + 1, max(c for _, c in image) + 1
    flip = lambda x, n: -x - 1 if x < 0 else 2 * n - 1 - x if x >= n else x
    return {(r, c): [(image[q], w) for a, b, w in kernel if (q := (flip(r + a, h), flip(c + b, wd))) in image] for r, c in image}


def images():
    rng = random.Random(5)
    out = {k: {(r, c): rng.random() for r in range(h) for c in range(w)} for k, (h, w) in enumerate([(11, 7), (8, 8), (1, 5), (2, 2), (1, 1)])}
    out[5] = {k: (None if rng.random() < 0.2 else v) for k, v in out[0].items() if rng.random() < 0.7}  # gaps and nulls
    return out


@pytest.mark.parametrize("side", [4, 64])
def test_filters_equal_loops(spark, side):
    every = images()
    grid = spark.createDataFrame([(k, r, c, v) for k, image in every.items() for (r, c), v in image.items()], SCHEMA)
    gauss, cross = pixels.gaussian(0.5), pixels.SOBEL_X
    got = pixels.filtered(grid, {"gauss": (gauss, pixels.weighted_sum), "cross": (cross, pixels.weighted_sum), "mid": (pixels.uniform(3), pixels.median)}, side).collect()
    assert len(got) == len({(x.image_id, x.r, x.c) for x in got})
    want = {(k, *at) for k, image in every.items() for at in image if all(near(image, kernel)[at] for kernel in (gauss, cross, pixels.uniform(3)))}
    assert {(x.image_id, x.r, x.c) for x in got} == want
    for x in got:
        for value, kernel in ((x.gauss, gauss), (x.cross, cross), (x.mid, pixels.uniform(3))):
            there = [(u, w) for u, w in near(every[x.image_id], kernel)[x.r, x.c] if u is not None]
            if not there:
                assert value is None
            elif value is x.mid:
                s = sorted(u for u, _ in there)
                assert abs(value - (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2) < 1e-12
            else:
                assert abs(value - sum(u * w for u, w in there)) < 1e-12


def test_bilateral_equals_loops(spark):
    every = images()
    grid = spark.createDataFrame([(k, r, c, v) for k, image in every.items() for (r, c), v in image.items()], SCHEMA)
    kernel = [(a, b, math.exp(-(a * a + b * b) / 2)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for x in pixels.bilateral_filter(grid, 1.0, 0.1, 3).collect():
        own = every[x.image_id][x.r, x.c]
        if own is None:
            continue
        w = [(u, k * math.exp(-((u - own) ** 2) / 0.02)) for u, k in near(every[x.image_id], kernel)[x.r, x.c] if u is not None]
        assert abs(x.v - sum(u * k for u, k in w) / sum(k for _, k in w)) < 1e-12


def test_filters_shuffle_arrays_once(spark):
    grid = views.grids(spark, "/root/testdata/sf0.001")
    for df in (pixels.convolve(grid, pixels.gaussian(1.0)), pixels.bilateral_filter(grid), pixels.median_filter(grid)):
        assert shuffles(df) == 1
    assert shuffles(pipelines.scalars(grid, pixels.convolve(grid, pixels.gaussian(1.0)))) <= 3
    plain = views.minmax_normalize(views.grid_from_array(views.read(spark, "/root/testdata/sf0.001", "embeddings"), 8))
    assert grid.exceptAll(plain).isEmpty() and plain.exceptAll(grid).isEmpty()


def test_grids_of_odd_arrays(spark):
    rows = spark.createDataFrame([(1, [0.5, None, 1.5]), (2, [0.25, 0.25]), (3, []), (4, None), (5, [1.0]), (5, [3.0, 2.0]), (6, [None])], "vec_id long, embedding array<float>")
    path = spark.conf.get("spark.sql.warehouse.dir") + "/odd"
    rows.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    key = lambda df: sorted(map(str, df.select("image_id", "r", "c", F.col("v")).collect()))
    assert key(views.grids(spark, path)) == key(views.minmax_normalize(views.grid_from_array(rows, 8)))


def test_betti_curves_shuffle_bars_by_image_only(spark):
    bars = spark.createDataFrame([(1, 0, 0.1, 0.9), (1, 0, 0.2, 0.4), (1, 1, 0.3, 0.5), (2, 0, 0.5, 0.5)], "image_id long, hdim int, birth double, death double")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    got = {(x.image_id, x.hdim, x.k): x.betti for x in diagram.betti_curves(bars, images, 9).collect()}
    want = {}
    for t in diagram.thresholds(bars, images, 9).collect():
        for h in (0, 1):
            want[t.image_id, h, t.k] = sum(x.image_id == t.image_id and x.hdim == h and x.birth <= t.t < x.death for x in bars.collect())
    assert got == want and len(got) == 54 and any(want.values())
    assert "hashpartitioning(image_id" in (plan := diagram.betti_curves(bars, images, 9)._jdf.queryExecution().executedPlan().toString())
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "k#" in x.split("plan_id")[0]]


def test_edge_histogram_filters_once(spark):
    plan = grid.edge_histogram(views.grids(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
