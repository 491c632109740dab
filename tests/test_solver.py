"""The grouped solver and the rounds of joins give the same bars, on images of any shape, with ties and with holes in them."""

import random

from lattica.operators import persistence


def test_grouped_and_rounds_agree(spark):
    rng = random.Random(5)
    rows = []
    for k, (h, w, levels) in enumerate(((6, 9, 4), (1, 7, 3), (7, 5, 1000), (8, 8, 2), (1, 1, 1))):
        rows += [(k, r, c, float(rng.randrange(levels))) for r in range(h) for c in range(w) if k != 2 or rng.random() < 0.8]
    grid = spark.createDataFrame(rows, "image_id long, r int, c int, v double")
    bars = lambda df: sorted(((r.image_id, r.hdim, r.birth, r.death) for r in df.collect()), key=str)
    whole, rounds, mixed = (bars(persistence.persistence(grid, whole=n)) for n in (1 << 20, 0, 40))
    assert whole == rounds == mixed and any(x[1] == 1 for x in whole)
    alive = {(r.image_id, r.k): (r.b0, r.b1) for r in persistence.alive(persistence.persistence(grid.withColumn("v", grid.v / 1000)), 3).collect()}
    assert alive[4, 0] == (1, 0) and len(alive) == 15


def test_empty(spark):
    assert persistence.persistence(spark.createDataFrame([], "image_id long, r int, c int, v double")).count() == 0
