"""Characteristics of whole images against the way by joins, and of images with gaps."""

import random

import pytest

from lattica.operators import characteristics as ch


def _images(spark):
    rng = random.Random(4)
    rows = []
    for i, (h, w) in enumerate([(8, 8), (8, 8), (5, 9), (1, 6), (6, 1), (70, 9), (12, 12)]):
        for r in range(h):
            for c in range(w):
                v = rng.random() if i != 6 else float(2 < r < 9 and 2 < c < 9 and not (r == c == 5))
                if i == 1:
                    v = round(v, 1)
                rows.append((i, r, c, v))
    return spark.createDataFrame(rows, "image_id long, r int, c int, v double")


def test_whole_images_are_as_by_joins(spark):
    grid = _images(spark)
    cut = ch.squares(grid)
    assert cut.where("whole").count() == 7
    one, two = ({r.image_id: r.asDict() for r in df.collect()} for df in (ch.of_images(cut), ch._by_joins(grid)))
    assert one.keys() == two.keys()
    for i in one:
        for name in (x.split()[0] for x in ch.OF_IMAGE.split(", ")):
            assert one[i][name] == (None if two[i][name] is None else pytest.approx(two[i][name], abs=1e-9)), (i, name)


def test_gaps_and_doubles_go_by_joins(spark):
    grid = _images(spark).where("not (image_id = 2 and r = 1 and c = 1)").where("not (image_id = 3 and c = 5)")
    grid = grid.unionByName(grid.where("image_id = 4 and r = 0"))
    cut = ch.squares(grid)
    assert {r.image_id for r in cut.where("not whole").collect()} == {2, 4}
    assert ch.of_images(cut.where("image_id <> 4")).count() == 6


def test_a_constant_image_counts(spark):
    grid = spark.createDataFrame([(i, r, c, 0.0 if i else (r + c) / 14) for i in (0, 1) for r in range(8) for c in range(8)], "image_id long, r int, c int, v double")
    members = spark.createDataFrame([("d", 0, 1), ("d", 1, 2)], "dataset string, image_id long, label int")
    assert ch.dataset_characteristics(grid, members).collect()[0].n_samples == 2


def test_pixels_are_shuffled_once(spark):
    """The rows of whole images come from the written squares without a further exchange."""
    plan = ch.of_images(ch.squares(_images(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
