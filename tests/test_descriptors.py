"""Every named descriptor on gray and on colour images; fixed chains; weights and templates of a caller."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import descriptors, pipelines
from lattica.operators import diagram

SMALL = {"persistence_image": {"res": 4}, "persistence_landscapes": {"layers": 2, "n": 5}, "betti_curves": {"n": 6}, "persistence_entropy": {"n": 6}, "persistence_silhouette": {"n": 6}, "template_functions": {"n": 9}, "minkowski": {"n": 4}, "euler_transform": {"directions": 3, "heights": 4}, "euler_curve": {"n": 6}}
LENGTH = {"persistence_image": 32, "persistence_landscapes": 20, "betti_curves": 12, "persistence_entropy": 12, "persistence_silhouette": 12, "template_functions": 18, "minkowski": 12, "euler_transform": 12, "euler_curve": 6, "glcm": 2, "carlsson_coordinates": 8, "lbp": 10, "lbp_scales": 28}


@pytest.fixture(scope="module")
def rgb(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(k, ch, r, c, rng.random()) for k in range(3) for ch in "RGB" for r in range(7) for c in range(9)], "image_id long, channel string, r int, c int, v double").cache()


def test_all_are_known_and_have_their_length(rgb):
    gray = rgb.where("channel = 'R'").drop("channel").cache()
    assert len(descriptors.names()) >= 15
    for name in descriptors.names():
        got = descriptors.extract(name, gray, **SMALL.get(name, {})).collect()
        assert got and {r.image_id for r in got} == {0, 1, 2} and all(r.descriptor == name for r in got)
        at = [(r.image_id, r.pos) for r in got]
        assert len(at) == len(set(at)) and min(p for _, p in at) >= 0
        if name in LENGTH:
            assert max(p for _, p in at) < LENGTH[name]


def test_channels_follow_one_another(rgb):
    got = descriptors.extract("betti_curves", rgb, "per_channel", n=4)
    assert got.groupBy("image_id").count().where("count <> 24").count() == 0
    red = descriptors.extract("betti_curves", rgb.where("channel = 'R'").drop("channel"), n=4)
    assert red.join(got, ["image_id", "descriptor", "pos", "x"]).count() == red.count() == 24
    green = descriptors.extract("betti_curves", rgb.where("channel = 'G'").drop("channel"), n=4).withColumn("pos", F.col("pos") + 8)
    assert green.join(got, ["image_id", "descriptor", "pos", "x"]).count() == 24
    with pytest.raises(ValueError):
        descriptors.extract("lbp", rgb, "other")
    with pytest.raises(TypeError):
        descriptors.extract("lbp", rgb, n=3)


def test_chains(rgb):
    gray = rgb.where("channel = 'R'").drop("channel")
    assert {r.part for r in pipelines.statistics_pipeline(gray).collect()} == {"statistics", "foreground_ratio"}
    assert pipelines.landscape_pipeline(gray, 2, 5).count() == 3 * 20
    parts = pipelines.curves_pipeline(gray, n=6).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"betti_curves": 36, "euler": 3, "image_mean": 3, "image_std": 3, "foreground_ratio": 3}


def test_own_weights_and_templates(spark):
    bars = spark.createDataFrame([(1, 0, 0.1, 0.5), (1, 0, 0.2, 0.9), (1, 1, 0.3, 0.4)], "image_id long, hdim int, birth double, death double")
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    key = ("hdim", "i", "j", "value")
    assert rows(diagram.persistence_image(bars, 4, 0.2, lambda p: p**2), *key) == rows(diagram.persistence_image(bars, 4, 0.2, "squared"), *key)
    tent = lambda a, b, step: F.greatest(F.lit(0.0), 1 - F.greatest(a, b) / step)
    assert rows(diagram.template_functions(bars, 9, tent), "hdim", "k", "value") == rows(diagram.template_functions(bars, 9), "hdim", "k", "value")
