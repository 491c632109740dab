"""Graphs and masks that are solved in one pass have the rows of the rounds."""

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import components, persistence
from lattica.operators.components import least_labels


def graphs(spark, seed=3):
    """Sparse random graphs with ties, lone nodes, twice given edges and edges to nodes that are not there."""
    rng = np.random.default_rng(seed)
    nodes, edges = [], []
    for g in range(5):
        n = int(rng.integers(1, 30))
        nodes += [(g, int(10 * k + g), float(rng.integers(0, 6))) for k in rng.permutation(n)]
        edges += [(g, int(10 * a + g), int(10 * b + g)) for a, b in rng.integers(0, n + 2, (n, 2)) if a != b]
    return spark.createDataFrame(nodes, "g long, id long, v double"), spark.createDataFrame(edges + edges[:5] + [(9, 1, 2)], "g long, a long, b long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_graphs_equal_rounds(spark):
    nodes, edges = graphs(spark)
    for whole in (10, 1 << 20):
        assert rows(persistence.persistence_h0_graph(nodes, edges, whole)) == rows(persistence.persistence_h0_graph(nodes, edges, 0))
        known = edges.join(nodes.select("g", F.col("id").alias("a")), ["g", "a"]).join(nodes.select("g", F.col("id").alias("b")), ["g", "b"])
        assert rows(components.connected_components(nodes, edges, whole)) == rows(components.connected_components(nodes, known, 0))


def test_small_graphs_need_no_rounds(spark, monkeypatch):
    """A round joins tables that are small on disk and large in memory, which all goes through the driver."""
    monkeypatch.setattr(persistence, "_rounds", None)
    monkeypatch.setattr(components, "_rounds", None)
    nodes, edges = graphs(spark)
    assert persistence.persistence_h0_graph(nodes, edges).count() and components.connected_components(nodes, edges).count() == nodes.count()
    mask = nodes.select(F.col("g").alias("image_id"), (F.col("id") % 7).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"), F.lit(1).alias("fg")).distinct()
    assert components.mask_components(mask).count() == mask.count()
    assert components.holes_and_fill(mask).count() == components.component_stats(mask).count() == 5


def test_whole_masks_equal_rounds(spark):
    rng = np.random.default_rng(5)
    pixels = [(g, r, c, int(rng.integers(0, 2)) if g else 0) for g in range(4) for r in range(6 + g) for c in range(9 - g) if g < 3 or rng.random() < 0.8]
    mask = spark.createDataFrame(pixels, "image_id long, r int, c int, fg int")
    for conn in (4, 8):
        want = components.mask_components(mask, conn, 0)
        assert {rows(components.mask_components(mask, conn, n)) == rows(want) for n in (50, 1 << 20)} == {True}
        assert components.mask_components(mask, conn).schema == want.schema


def test_least_labels():
    assert least_labels(7, np.array([5, 3, 6]), np.array([3, 1, 2])).tolist() == [0, 1, 2, 1, 4, 1, 2]
    assert least_labels(2, np.array([], int), np.array([], int)).tolist() == [0, 1]
