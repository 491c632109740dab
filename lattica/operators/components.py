"""Connected components of many graphs at once, and statistics of image components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.tables import drop, save
from lattica.operators.grid import I, STEPS, grid_edges, pixel_id as at


#: Most pixels of an image, or nodes of a graph, that one task solves at once; memory and time of the pass grow with it and with
#: nothing else.
WHOLE = 1 << 20


def ends(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ids of the ends of edges, and whether both are there."""
    if not len(ids):
        return np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    order = np.argsort(ids, kind="stable")
    i, j = (np.minimum(np.searchsorted(ids, x, sorter=order), len(ids) - 1) for x in (a, b))
    return order[i], order[j], (ids[order[i]] == a) & (ids[order[j]] == b)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component: the greater of two labels that meet points to the lesser, then pointers jump."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def connected_components(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(g, id, label) from nodes(g, id) and edges(g, a, b): the least id of each component. Graphs of at most `whole` nodes are
    solved one by one in the tasks of a single shuffle by graph, larger ones together by rounds; the labels are a written table."""
    nodes = save(nodes.select("g", "id"), "nodes")
    large = save(nodes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("g"), "large")
    if large.isEmpty():
        labels = save(_solved(nodes, edges), "labels")
        drop(nodes, large)
        return labels
    hinted = large.hint("merge")
    rounds = _rounds(nodes.join(hinted, "g"), edges.join(hinted, "g"))
    labels = save(_solved(nodes.join(hinted, "g", "left_anti"), edges.join(hinted, "g", "left_anti")).unionByName(rounds), "labels")
    drop(nodes, large, rounds)
    return labels


def _solved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("g", "id")}

    def run(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids = np.sort(nodes["id"].to_numpy())
        a, b, known = ends(ids, edges["a"].to_numpy(), edges["b"].to_numpy())
        label = ids[least_labels(len(ids), a[known], b[known])]
        return pa.table([pa.array([key[0].as_py()] * len(ids), key[0].type), pa.array(ids), pa.array(label)], names=["g", "id", "label"])

    return nodes.groupBy("g").cogroup(edges.select("g", "a", "b").groupBy("g")).applyInArrow(run, f"g {kind['g']}, id {kind['id']}, label {kind['id']}")


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least-label propagation with pointer jumping over all graphs in one job. Each round is a written table, which goes once
    the next one is written; it ends when no label changes."""
    both = save(edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = nodes.select("g", "id", F.col("id").alias("label"))
    last = []
    while True:  # labels only fall
        near = both.join(labels.select("g", F.col("id").alias("b"), "label"), ["g", "b"]).groupBy("g", F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, ["g", "id"], "left").select("g", "id", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        up = low.select("g", F.col("id").alias("label"), F.col("label").alias("up"))
        new = save(low.join(up, ["g", "label"]).select("g", "id", "before", F.least("label", "up").alias("label")), "labels")
        drop(*last)
        labels, last = new.select("g", "id", "label"), [new]
        if new.where("before <> label").isEmpty():
            drop(both)
            return new.select("g", "id", "label")


def mask_components(mask: DataFrame, conn: int = 8, whole: int = WHOLE) -> DataFrame:
    """(image_id, r, c, label) of fg pixels; a label is r * width + c of the component's first pixel, with the image's own width.
    Images of at most `whole` pixels are labelled one by one in the tasks of a single shuffle by image."""
    mask = save(mask.select(I, "r", "c", "fg"), "mask")
    large = save(mask.groupBy(I).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(I), "large")
    if large.isEmpty():
        return _labelled(mask, conn)
    hinted = large.hint("merge")
    return _labelled(mask.join(hinted, I, "left_anti"), conn).unionByName(_joined(mask.join(hinted, I), conn))


def _labelled(mask: DataFrame, conn: int) -> DataFrame:
    kind = {c: mask.schema[c].dataType.simpleString() for c in (I, "r", "c")}
    number = "bigint" if "bigint" in (kind["r"], kind["c"]) else "int"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        r, c = (rows[x].to_numpy().astype(np.int64) for x in ("r", "c"))
        width, on = int(c.max()) + 1, rows["fg"].to_numpy() == 1
        order = np.lexsort((c[on], r[on]))
        r, c = r[on][order], c[on][order]
        ids = r * (width + 1) + c  # one column more, so that no row runs into the next
        near = [ends(ids, ids, ids + dr * (width + 1) + dc) for dr, dc in STEPS[conn]]
        label = least_labels(len(ids), *(np.concatenate([x[k][x[2]] for x in near]) for k in (0, 1)))
        image = pa.array([key[0].as_py()] * len(ids), key[0].type)
        return pa.table([image, pa.array(r), pa.array(c), pa.array(r[label] * width + c[label])], names=[I, "r", "c", "label"])

    # pixel numbers are long inside
    found = mask.groupBy(I).applyInArrow(run, f"{I} {kind[I]}, r bigint, c bigint, label bigint")
    return found.select(I, F.col("r").cast(kind["r"]).alias("r"), F.col("c").cast(kind["c"]).alias("c"), F.col("label").cast(number).alias("label"))


def _joined(mask: DataFrame, conn: int) -> DataFrame:
    fg = mask.where("fg = 1").select(I, "r", "c", F.lit(0.0).alias("v"))
    found = connected_components(fg.select(F.col(I).alias("g"), at("r", "c").alias("id")), grid_edges(fg, conn).select(F.col(I).alias("g"), at("r", "c").alias("a"), at("r2", "c2").alias("b")), 0)
    row, col = (lambda x: F.shiftright(x, 32).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    width = mask.groupBy(F.col(I).alias("g")).agg((F.max("c") + 1).alias("width"))
    label = (row(F.col("label")) * F.col("width") + col(F.col("label"))).alias("label")
    return found.join(width, "g").select(F.col("g").alias(I), row(F.col("id")).alias("r"), col(F.col("id")).alias("c"), label)


def component_stats(mask: DataFrame, conn: int = 8) -> DataFrame:
    """Number, mean size, variation and largest share of components; 0 for an empty mask."""
    sizes = mask_components(mask, conn).groupBy(I, "label").agg(F.count("*").alias("size"))
    got = sizes.groupBy(I).agg(F.count("*").alias("n"), F.avg("size").alias("mean"), (F.stddev_pop("size") / F.avg("size")).alias("cv"), (F.max("size") / F.sum("size")).alias("largest"))
    out = mask.select(I).distinct().join(got, I, "left")
    return out.select(I, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean", "cv", "largest")])


def holes_and_fill(mask: DataFrame) -> DataFrame:
    """Holes: background components (4-neighbours) that touch no border. Fill ratio: fg with holes filled over fg."""
    back = mask.withColumn("fg", 1 - F.col("fg"))
    last = mask.groupBy(I).agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    label = mask_components(back, 4).join(last, I)
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("last_r")) | (F.col("c") == F.col("last_c"))
    inner = label.groupBy(I, "label").agg(F.max(edge.cast("int")).alias("edge"), F.count("*").alias("size")).where("edge = 0")
    holes = inner.groupBy(I).agg(F.count("*").alias("holes"), F.sum("size").alias("inside"))
    fg = mask.groupBy(I).agg(F.sum("fg").alias("fg"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return fg.join(holes, I, "left").select(I, zero("holes").alias("holes"), F.when(F.col("fg") > 0, (F.col("fg") + zero("inside")) / F.nullif("fg", F.lit(0))).otherwise(0.0).alias("fill_ratio"))


def betti_estimate(components: DataFrame, euler: DataFrame) -> DataFrame:
    """b0 components, b1 = max(0, b0 - chi)."""
    return components.join(euler, I).select(I, F.col("n").alias("b0"), F.greatest(F.lit(0), F.col("n") - F.col("chi")).alias("b1"), "chi")
