"""Persistent homology of all images together.

Images of at most WHOLE pixels are solved one by one in the tasks of a single shuffle by image: pixels are numbered by
(value, place), edges are taken in the order of their later end, and of two clusters that meet the younger dies. Both
dimensions come from the same pass.

Graphs of at most WHOLE nodes are solved in the same way. Larger images and graphs are solved together as rounds of joins. Nodes are numbered by (value, id). In a round
each cluster takes its least outgoing edge; if the cluster across is older, it dies there. Clusters that die are contracted into
the older ones, and only the least edge between two clusters stays. The rounds end when no edge is left. H0 and H1 of
such images are one set of graphs, so their rounds are shared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import drop, over, save
from lattica.operators.components import WHOLE, ends
from lattica.operators.grid import I, grid_edges, pixel_id as at
from lattica.operators.pixels import flat_pixels, slices, tiles

OUTSIDE = -1
BARS = "hdim int, birth double, death double"


def persistence_h0_graph(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(g, birth, death) from nodes(g, id, v) and edges(g, a, b): death is null for the component that never dies; pairs
    of no length are left out. Graphs of at most `whole` nodes are solved one by one in the tasks of a single shuffle by graph,
    larger ones together by rounds."""
    ranked = save(nodes.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))), "ranked")
    large = ranked.where(F.col("k") > whole).select("g").distinct()  # k runs from 1 to the number of nodes
    if large.isEmpty():
        return _solved_graphs(ranked, edges)
    hinted = large.hint("merge")
    rounds = _rounds(ranked.join(hinted, "g"), edges.join(hinted, "g"))
    return _solved_graphs(ranked.join(hinted, "g", "left_anti"), edges.join(hinted, "g", "left_anti")).unionByName(rounds)


def _solved_graphs(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    kind = {c: ranked.schema[c].dataType.simpleString() for c in ("g", "v")}

    def run(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("k")
        value, every = nodes["v"].combine_chunks(), np.arange(nodes.num_rows)
        a, b, known = ends(nodes["id"].to_numpy(), edges["a"].to_numpy(), edges["b"].to_numpy())
        gone = np.array(merges(every, a[known], b[known]), np.int64).reshape(-1, 2)
        stay = np.setdiff1d(every, gone[:, 0])
        g = pa.array([key[0].as_py()] * len(every), key[0].type)
        birth = value.take(pa.array(np.concatenate([gone[:, 0], stay])))
        death = pa.concat_arrays([value.take(pa.array(gone[:, 1])), pa.nulls(len(stay), value.type)])
        return pa.table([g, birth, death, pa.array(np.arange(len(every)) < len(gone))], names=["g", "birth", "death", "died"])

    each = ranked.select("g", "id", "v", "k").groupBy("g").cogroup(edges.select("g", "a", "b").groupBy("g"))
    found = each.applyInArrow(run, f"g {kind['g']}, birth {kind['v']}, death {kind['v']}, died boolean")
    return found.where("not died or birth < death").select("g", "birth", "death")


def _rounds(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """The graphs together by rounds of joins; ranked(g, id, v, k)."""
    a, b = ranked.select("g", F.col("id").alias("a"), F.col("k").alias("x")), ranked.select("g", F.col("id").alias("b"), F.col("k").alias("y"))
    one = edges.select("g", "a", "b").join(a, ["g", "a"]).join(b, ["g", "b"]).select("g", "x", "y", F.greatest("x", "y").alias("w"))
    live = save(one.unionByName(one.select("g", F.col("y").alias("x"), F.col("x").alias("y"), "w")), "live")
    deaths, written = None, []  # tables that `deaths` reads
    for k in count(1):  # the least edge of all merges two clusters, so every round has fewer edges
        if live.isEmpty():
            break
        least = live.groupBy("g", "x").agg(F.min(F.struct("w", "y")).alias("e")).where("e.y < x").select("g", "x", F.col("e.y").alias("y"), F.col("e.w").alias("w"))
        least, stale = save(least, "least"), []
        written.append(least)
        deaths = least.select("g", "x", "w") if deaths is None else deaths.unionByName(least.select("g", "x", "w"))
        if k % 32 == 0:  # keeps the plan short
            deaths = save(deaths, "deaths")
            stale, written = written, [deaths]
        root, last = least.select("g", "x", F.col("y").alias("root")), []
        while True:  # pointer jumping: chains of deaths lead to the oldest
            up = root.select("g", F.col("x").alias("root"), F.col("root").alias("up"))
            next_ = save(root.join(up, ["g", "root"], "left").select("g", "x", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "root")
            drop(*last)
            root, last = next_.select("g", "x", "root"), [next_]
            if next_.where("moved").isEmpty():
                break
        to_x, to_y = root.select("g", "x", F.col("root").alias("rx")), root.select("g", F.col("x").alias("y"), F.col("root").alias("ry"))
        moved = live.join(to_x, ["g", "x"], "left").join(to_y, ["g", "y"], "left").select("g", F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), "w")
        fewer = save(moved.where("x <> y").groupBy("g", "x", "y").agg(F.min("w").alias("w")), "live")
        drop(live, *last, *stale)
        live = fewer
    drop(live)
    value = ranked.select("g", "k", "v")
    born = value.select("g", F.col("k").alias("x"), F.col("v").alias("birth"))
    if deaths is None:
        return born.select("g", "birth", F.lit(None).cast("double").alias("death"))
    died = deaths.join(born, ["g", "x"]).join(value.select("g", F.col("k").alias("w"), F.col("v").alias("death")), ["g", "w"]).where("birth < death").select("g", "birth", "death")
    kept = born.join(deaths.select("g", "x"), ["g", "x"], "left_anti").select("g", "birth", F.lit(None).cast("double").alias("death"))
    return died.unionByName(kept)


def merges(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(rank of the oldest node of the cluster that dies, rank at which it dies) of a graph whose nodes are ranked by age."""
    a, b = rank[a], rank[b]
    old, young = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(young, kind="stable")
    root, out = list(range(len(rank))), []
    for x, y in zip(old[order].tolist(), young[order].tolist()):
        at = y
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            x, y = (x, y) if x < y else (y, x)
            root[y] = x  # the older one stays
            out.append((y, at))
    return out


def solve_image(r: np.ndarray, c: np.ndarray, v: np.ndarray) -> list[tuple[int, float, float | None]]:
    """(hdim, birth, death) of one image: H0 with 8 neighbours; H1 by duality, from the components of the negated image with
    4 neighbours and one node outside that touches the border. Pixels may be missing; bars of no length are left out."""
    order = np.lexsort((c, r))
    r, c, v = r[order], c[order], v[order]
    number = -np.ones((int(r.max()) + 3, int(c.max()) + 3), np.int64)
    number[r + 1, c + 1] = np.arange(len(v))
    ahead = {(dr, dc): number[r + 1 + dr, c + 1 + dc] for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1))}
    every = np.arange(len(v))

    def bars(value: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[float, float]], list[float]]:
        by_age = np.argsort(value, kind="stable")
        rank = np.empty(len(value), np.int64)
        rank[by_age] = np.arange(len(value))
        sorted_value = value[by_age]
        gone = merges(rank, np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges]))
        dead = np.ones(len(value), bool)
        dead[[k for k, _ in gone]] = False
        return [(sorted_value[x], sorted_value[y]) for x, y in gone if sorted_value[x] < sorted_value[y]], sorted_value[dead].tolist()

    edges = [(every[to >= 0], to[to >= 0]) for to in ahead.values()]
    died, stay = bars(v, edges)
    out: list[tuple[int, float, float | None]] = [(0, float(x), float(y)) for x, y in died] + [(0, float(x), None) for x in stay]
    rim = (r == 0) | (c == 0) | (r == r.max()) | (c == c.max())
    four = [(a + 1, b + 1) for a, b in edges[:2]] + [(np.zeros(int(rim.sum()), np.int64), every[rim] + 1)]
    died, _ = bars(np.append(-np.inf, -v), four)  # node 0 is the outside, the oldest
    return out + [(1, float(-y), float(-x)) for x, y in died]


def _solved(small: DataFrame) -> DataFrame:
    kind = small.schema[I].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = solve_image(*(rows.column(x).to_numpy() for x in ("r", "c", "v")))
        hdim, birth, death = zip(*found)
        image = pa.array([key[0].as_py()] * len(found), key[0].type)
        return pa.table([image, pa.array(hdim, pa.int32()), pa.array(birth, pa.float64()), pa.array(death, pa.float64())], names=[I, "hdim", "birth", "death"])

    return small.groupBy(I).applyInArrow(run, f"{I} {kind}, {BARS}")


def _graphs(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of both dimensions as one set of graphs, g = (image_id, hdim)."""
    g = lambda k: F.struct(F.col(I), F.lit(k).alias("hdim")).alias("g")
    inner = grid.select(g(1), at("r", "c").alias("id"), (-F.col("v")).alias("v"))
    outside = grid.select(I).distinct().select(g(1), F.lit(OUTSIDE).cast("long").alias("id"), F.lit(float("-inf")).alias("v"))
    w = over(I)
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.max("r").over(w)) | (F.col("c") == F.max("c").over(w))
    rim = grid.withColumn("edge", edge).where("edge").select(g(1), at("r", "c").alias("a"), F.lit(OUTSIDE).cast("long").alias("b"))
    ends = (at("r", "c").alias("a"), at("r2", "c2").alias("b"))
    nodes = grid.select(g(0), at("r", "c").alias("id"), "v").unionByName(inner).unionByName(outside)
    return nodes, grid_edges(grid, 8).select(g(0), *ends).unionByName(grid_edges(grid, 4).select(g(1), *ends)).unionByName(rim)


def _solved_squares(squares: DataFrame) -> DataFrame:
    """Bars of images that are each a single row of `tiles`, some hundred at a time."""
    kind = squares.schema[I].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            image, r, c, v, known = flat_pixels(batch)
            v, cut = np.where(known, v, np.nan), np.searchsorted(image, np.arange(batch.num_rows + 1))
            found = [(k, *bar) for k in range(batch.num_rows) for bar in solve_image(*(x[cut[k] : cut[k + 1]] for x in (r, c, v)))]
            k, hdim, birth, death = zip(*found)
            yield pa.RecordBatch.from_arrays([batch[I].take(pa.array(k)), pa.array(hdim, pa.int32()), pa.array(birth, pa.float64()), pa.array(death, pa.float64())], names=[I, "hdim", "birth", "death"])

    return squares.mapInArrow(run, f"{I} {kind}, {BARS}")


def persistence(grid: DataFrame, filtration: str = "sublevel", whole: int = WHOLE) -> DataFrame:
    """(image_id, hdim, birth, death) of H0 and H1, a written table; death is null for a component that never dies; superlevel works
    on 1 - v. Images are written as arrays of squares, and those of a single square are solved without another shuffle."""
    if filtration == "superlevel":
        grid = grid.withColumn("v", 1 - F.col("v"))
    side = 1 << 10
    squares = save(tiles(grid, 0, side=side), "squares")
    if squares.rdd.getNumPartitions() < (cores := squares.sparkSession.sparkContext.defaultParallelism):
        squares = squares.repartition(4 * cores, I)  # small files would keep tasks idle
    alone = (F.col("h") <= side) & (F.col("wd") <= side) & (F.size("pixels") <= whole)
    rest = squares.where(~alone)
    if rest.isEmpty():
        return save(_solved_squares(squares), "bars")
    kind = {c: grid.schema[c].dataType.simpleString() for c in ("r", "c")}
    pixels = save(rest.select(I, F.explode("pixels").alias("p")).select(I, *[F.col(f"p.{c}").cast(kind[c]).alias(c) for c in ("r", "c")], "p.v"), "grid")
    large = save(pixels.groupBy(I).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(I), "large")
    nodes, edges = _graphs(pixels.join(large, I))
    rounds = persistence_h0_graph(nodes, edges, whole).where("g.hdim = 0 or death is not null")
    flip = lambda a, b: F.when(F.col("g.hdim") == 0, F.col(a)).otherwise(-F.col(b))
    rounds = rounds.select(F.col(f"g.{I}").alias(I), F.col("g.hdim").alias("hdim"), flip("birth", "death").alias("birth"), flip("death", "birth").alias("death"))
    return save(_solved_squares(squares.where(alone)).unionByName(_solved(pixels.join(large, I, "left_anti"))).unionByName(rounds), "bars")


def persistence_h0(grid: DataFrame, conn: int = 8) -> DataFrame:
    """H0 alone; with 4 neighbours by rounds of joins."""
    if conn == 8:
        return persistence(grid).where("hdim = 0")
    nodes = grid.select(F.col(I).alias("g"), at("r", "c").alias("id"), "v")
    edges = grid_edges(grid, conn).select(F.col(I).alias("g"), at("r", "c").alias("a"), at("r2", "c2").alias("b"))
    return persistence_h0_graph(nodes, edges).select(F.col("g").alias(I), F.lit(0).alias("hdim"), "birth", "death")


def persistence_h1(grid: DataFrame) -> DataFrame:
    return persistence(grid).where("hdim = 1")


def alive(diagram: DataFrame, thresholds: int) -> DataFrame:
    """(image_id, k, b0, b1): bars alive at k / (thresholds - 1), born at or below it and dying above it."""
    t = F.col("k") / F.lit(thresholds - 1)
    on = diagram.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1)))).where((F.col("birth") <= t) & (F.col("death").isNull() | (F.col("death") > t)))
    n = lambda k: F.sum(F.when(F.col("hdim") == k, 1).otherwise(0)).alias(f"b{k}")
    spine = diagram.select(I).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))))
    return spine.join(on.groupBy(I, "k").agg(n(0), n(1)), [I, "k"], "left").select(I, "k", *[F.coalesce(f"b{x}", F.lit(0)).cast("long").alias(f"b{x}") for x in (0, 1)])


def cap_infinite(diagram: DataFrame, grid: DataFrame | None = None, policy: str = "image_max") -> DataFrame:
    if policy == "drop":
        return diagram.where("death is not null")
    if policy == "image_max":
        top = grid.groupBy(I).agg(F.max("v").alias("top"))
    else:
        top = diagram.groupBy(I).agg(F.coalesce(1.1 * F.max("death"), F.max("birth") + 1).alias("top"))
    return diagram.join(top, I).withColumn("death", F.coalesce("death", "top")).drop("top")


def valid_pairs(diagram: DataFrame) -> DataFrame:
    return diagram.where("death > birth and abs(birth) < 1e6 and abs(death) < 1e6")


def compare_diagrams(a: DataFrame, b: DataFrame) -> DataFrame:
    """Count match, greatest difference of sorted pairs and share of equal ones, for each image and dimension."""
    w = Window.partitionBy(I, "hdim").orderBy("birth", "death")
    x = a.withColumn("k", F.row_number().over(w)).select(I, "hdim", "k", F.col("birth").alias("b1"), F.col("death").alias("d1"))
    y = b.withColumn("k", F.row_number().over(w)).select(I, "hdim", "k", F.col("birth").alias("b2"), F.col("death").alias("d2"))
    gap = F.greatest(F.abs(F.col("b1") - F.col("b2")), F.abs(F.col("d1") - F.col("d2")))
    return x.join(y, [I, "hdim", "k"], "full").groupBy(I, "hdim").agg((F.count("b1") == F.count("b2")).alias("same_count"), F.max(gap).alias("max_diff"), (F.sum(F.when(gap == 0, 1).otherwise(0)) / F.count("*")).alias("exact"))
