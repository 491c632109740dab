"""Operators on neighbourhoods beyond one step: weighted Euler transforms and anisotropy of voxels(image_id, z, y, x, v), circular
binary patterns and Laplacian profiles of grid(image_id, r, c, v)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, save, small
from lattica.operators.components import WHOLE, connected_components, ends, least_labels
from lattica.operators.grid import I, grid_edges
from lattica.operators.grid import pixel_id as at
from lattica.operators.pixels import flat_pixels, slices, tiles

AXES = ("z", "y", "x")


def spiral(n: int) -> list[tuple[float, float, float]]:
    """n directions (x, y, z) spread evenly over the sphere along a spiral with the golden angle, from pole to pole."""
    turn, out = math.pi * (3 - math.sqrt(5)), []
    for k in range(n):
        y = 1 - 2 * k / (n - 1) if n > 1 else 0.0
        radius = math.sqrt(max(0.0, 1 - y * y))
        out.append((math.cos(turn * k) * radius, y, math.sin(turn * k) * radius))
    return out


def _cells(voxels: DataFrame) -> DataFrame:
    """(image_id, z, y, x, v, cells): for each foreground voxel the cells that begin at it, each an array of three numbers that are
    1 along the axes in which it reaches one voxel on. A cell is there if all its voxels are."""

    def ahead(axis: str, col: str) -> Column:
        rest = [a for a in AXES if a != axis]
        return F.coalesce(F.when(F.lead(axis).over(Window.partitionBy(I, *rest).orderBy(axis)) == F.col(axis) + 1, F.lead(col).over(Window.partitionBy(I, *rest).orderBy(axis))), F.lit(0))

    m = voxels.withColumn("o000", F.lit(1))
    for k, axis in enumerate(AXES):  # a voxel's reach along the axes so far, one axis more at a time
        for name in [c for c in m.columns if c.startswith("o")]:
            more = name[: k + 1] + "1" + name[k + 2 :]
            m = m.withColumn(more, F.col(name) * ahead(axis, name))
    names = sorted(c for c in m.columns if c.startswith("o"))
    cells = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.array(*[F.lit(int(b)) for b in n[1:]])) for n in names]))
    return m.select(I, *AXES, "v", cells.alias("cells"))


def weighted_euler_transform_3d(voxels: DataFrame, directions: int = 8, thresholds: int = 16, weighted: bool = True, level: float = 0.5) -> DataFrame:
    """(image_id, d, k, chi): Euler number (6 neighbours) of the voxels above `level` and up to each of evenly spaced heights, from
    minus to plus the image's diagonal, along each direction of a spiral; times the mean value of these voxels. Cells
    enter at the height of their highest voxel, so one pass over cells and running sums serve all heights."""
    spark = voxels.sparkSession
    size = voxels.groupBy(I).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    fg = _cells(voxels.where(F.col("v") > level)).join(size, I)
    # a table of fixed size
    d = F.broadcast(spark.createDataFrame([(k, *map(float, xyz)) for k, xyz in enumerate(spiral(directions))], "d int, dx double, dy double, dz double"))
    height = sum(((F.col(a) - F.col(f"n{a}") / 2) * F.col(f"d{a}") for a in ("x", "y", "z")), F.lit(0.0))
    reach = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AXES), F.lit(0)).cast("double"))
    each = fg.join(d).withColumn("h", height).withColumn("top", reach).withColumn("cell", F.explode("cells"))
    on = lambda k, a: F.get("cell", F.lit(k)) * F.greatest(F.col(f"d{a}"), F.lit(0.0))
    entry = F.col("h") + on(0, "z") + on(1, "y") + on(2, "x")
    step = F.greatest(F.lit(0), F.ceil(F.round((entry / F.col("top") + 1) / 2 * (thresholds - 1), 9))).cast("int")
    dims = F.aggregate("cell", F.lit(0), lambda a, x: a + x)
    got = each.groupBy(I, "d", step.alias("k")).agg(F.sum(1 - 2 * (dims % 2)).alias("s"), F.sum(F.when(dims == 0, F.col("v"))).alias("w"), F.sum((dims == 0).cast("int")).alias("n"))
    up = Window.partitionBy(I, "d").orderBy("k")
    spine = voxels.select(I).distinct().join(small(spark, directions, "d")).join(small(spark, thresholds, "k"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(up)
    mean = total("w") / F.nullif(total("n"), F.lit(0)) if weighted else F.lit(1.0)
    return spine.join(got, [I, "d", "k"], "left").select(I, "d", "k", F.coalesce(total("s") * mean, F.lit(0.0)).alias("chi"))


def transform_summary(ect: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and total variation of a transform(image_id, d, k, chi), and its signature: means over directions."""
    step = F.abs(F.col("chi") - F.lag("chi").over(Window.partitionBy(I, "d").orderBy("k")))
    s = ect.withColumn("step", step).groupBy(I).agg(F.avg("chi").alias("mean"), F.stddev_pop("chi").alias("std"), F.max("chi").alias("max"), F.min("chi").alias("min"), F.sum("step").alias("variation"))
    sign = ect.groupBy(I, "k").agg(F.avg("chi").alias("m")).groupBy(I).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("signature"))
    return s.join(sign, I)


#: Half of the 26 neighbours of a voxel, as steps (z, y, x).
HALF = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
FULL = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def eigenvalues_3x3(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """Eigenvalues, greatest first, of the symmetric matrix with diagonal a, b, c and d = (0, 1), e = (0, 2), f = (1, 2): by the angle
    of its characteristic polynomial."""
    m = (a + b + c) / 3
    p = F.sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2 + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - e * f) + e * (d * f - e * (b - m))
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(1.0))))) / 3
    first, last = m + 2 * p * F.cos(turn), m + 2 * p * F.cos(turn + 2 * math.pi / 3)
    return [first, 3 * m - first - last, last]


def anisotropy_3d(voxels: DataFrame, n_dir: int = 13, level: float = 0.5) -> DataFrame:
    """Degrees of anisotropy of the voxels above `level`: for each direction the mean intercept length 2 * volume / surface, where
    the surface counts voxels without a neighbour that way; the fabric tensor is the mean of length^2 times the outer square
    of the unit direction, six sums; its eigenvalues are column expressions."""
    steps = HALF if n_dir == 13 else FULL
    fg = save(voxels.where(F.col("v") > level).select(I, *AXES), "fg")
    # a table of fixed size
    d = F.broadcast(voxels.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(steps)], "d int, dz int, dy int, dx int"))
    volume = fg.groupBy(I).agg(F.count("*").alias("volume"))
    to = fg.join(d).select(I, "d", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES])
    met = to.join(fg, [I, *AXES]).groupBy(I, "d").agg(F.count("*").alias("met"))
    spine = voxels.select(I).distinct().join(d).join(volume, I, "left").join(met, [I, "d"], "left")
    n, inside = F.coalesce("volume", F.lit(0)), F.coalesce("met", F.lit(0))
    square = F.pow(2 * n / F.greatest(n - inside, F.lit(1)), F.lit(2.0)) / (F.col("dz") ** 2 + F.col("dy") ** 2 + F.col("dx") ** 2) / len(steps)
    sums = [F.sum(square * F.col(f"d{p}") * F.col(f"d{q}")).alias(p + q) for p, q in ("zz", "yy", "xx", "zy", "zx", "yx")]
    t = spine.groupBy(I).agg(F.max(n).alias("volume"), *sums)
    values = eigenvalues_3x3(*[F.col(c) for c in ("zz", "yy", "xx", "zy", "zx", "yx")])
    t = t.select(I, "volume", *[v.alias(f"e{k}") for k, v in enumerate(values, 1)])
    e1, e2, e3 = (F.col(f"e{k}") for k in (1, 2, 3))
    mean, squares, tiny = (e1 + e2 + e3) / 3, e1 * e1 + e2 * e2 + e3 * e3, F.lit(1e-10)
    fa = F.sqrt(F.lit(1.5)) * F.sqrt(((e1 - mean) ** 2 + (e2 - mean) ** 2 + (e3 - mean) ** 2) / F.nullif(squares, F.lit(0.0)))
    return t.select(I, "volume", (1 - e3 / F.greatest(e1, tiny)).alias("degree"), F.when(mean > 0, fa).otherwise(0.0).alias("fractional"), "e1", "e2", "e3", (e1 / F.greatest(e3, tiny)).alias("ratio"))


def circle(points: int, radius: float) -> list[list[tuple[int, int, float]]]:
    """For each of the points on a circle the pixels (dr, dc) around it with their bilinear weights; places have 5 decimals."""
    out = []
    for k in range(points):
        r, c = round(-radius * math.sin(2 * math.pi * k / points), 5), round(radius * math.cos(2 * math.pi * k / points), 5)
        r0, c0 = math.floor(r), math.floor(c)
        a, b = r - r0, c - c0
        four = [(r0, c0, (1 - a) * (1 - b)), (r0, c0 + 1, (1 - a) * b), (r0 + 1, c0, a * (1 - b)), (r0 + 1, c0 + 1, a * b)]
        out.append([x for x in four if x[2] > 0])
    return out


def lbp_circular(grid: DataFrame, points: int, radius: float) -> DataFrame:
    """(image_id, bin, n, density) of uniform patterns: of `points` samples on a circle, which are at least the centre. At most two
    changes along the samples: the number of set ones; else points + 1. Outside the image is 0. Each row of an image is one
    array, and a pixel sees the rows around it by windows, so an image is shuffled once."""
    ring = circle(points, radius)
    reach = max(abs(dr) for p in ring for dr, _, _ in p)
    rows = grid.groupBy(I, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("line"))
    up = Window.partitionBy(I).orderBy("r")
    lines = rows.select(I, *[(F.lag("line", -dr) if dr < 0 else F.lead("line", dr)).over(up).alias(f"line{dr + reach}") if dr else F.col("line").alias(f"line{reach}") for dr in range(-reach, reach + 1)])
    pixels = lines.select("*", F.posexplode(f"line{reach}").alias("c", "v"))

    def pixel(dr: int, dc: int) -> Column:
        at_ = F.col("c") + dc
        return F.coalesce(F.when(at_ >= 0, F.get(f"line{dr + reach}", at_)), F.lit(0.0))

    sample = [F.round(sum((pixel(dr, dc) * w for dr, dc, w in p), F.lit(0.0)), 9) >= F.round("v", 9) for p in ring]
    bits = pixels.select(I, F.array(*[b.cast("int") for b in sample]).alias("bits"))
    changes = F.aggregate(F.sequence(F.lit(1), F.lit(points - 1)), F.lit(0), lambda a, k: a + (F.get("bits", k) != F.get("bits", k - 1)).cast("int"))
    ones = F.aggregate("bits", F.lit(0), lambda a, b: a + b)
    n = bits.select(I, F.when(changes <= 2, ones).otherwise(points + 1).alias("bin")).groupBy(I, "bin").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / F.sum("n").over(over(I)))


def lbp_multi_scale(grid: DataFrame, scales: int) -> DataFrame:
    """(image_id, scale, bin, n, density): circles of 8, 16, ... samples with radius 1, 2, ..."""
    out = None
    for k in range(scales):
        one = lbp_circular(grid, 8 * (k + 1), float(k + 1)).select(I, F.lit(k).alias("scale"), "bin", "n", "density")
        out = one if out is None else out.unionByName(one)
    return out


def lbp_summary(histogram: DataFrame) -> DataFrame:
    """Entropy, uniformity and bins above a thousandth of a histogram(image_id, bin, density)."""
    h = F.col("density")
    return histogram.groupBy(I).agg((-F.sum(h * F.log(h + 1e-10))).alias("entropy"), F.sum(h * h).alias("uniformity"), F.sum((h > 0.001).cast("int")).alias("n_nonzero"))


#: Most nodes of a graph whose Laplacian is solved as a matrix.
DENSE = 100


def second_eigenvalue(n: int, a: np.ndarray, b: np.ndarray) -> float:
    """Second eigenvalue of the Laplacian of a connected graph of n nodes. Small ones are solved as a matrix; others by Lanczos steps on
    the space without constants, each new vector made orthogonal to all before, until the least value settles or the space is used up."""
    if n < 2:
        return 0.0
    if n <= DENSE:
        m = np.zeros((n, n))
        m[a, b] = m[b, a] = -1.0
        m[np.arange(n), np.arange(n)] = -m.sum(axis=0)
        return max(float(np.linalg.eigvalsh(m)[1]), 0.0)
    degree = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)).astype(float)
    times = lambda x: degree * x - np.bincount(a, x[b], n) - np.bincount(b, x[a], n)
    q = np.cos(np.arange(n) * 1.7) + np.arange(n) / n  # any start that is not constant
    basis, alpha, beta, before = [], [], [], math.inf
    q -= q.mean()
    q /= np.linalg.norm(q)
    for step in range(1, n):
        basis.append(q)
        w = times(q)
        alpha.append(float(q @ w))
        done = np.array(basis)
        for _ in range(2):
            w = w - w.mean()
            w -= done.T @ (done @ w)
        size = float(np.linalg.norm(w))
        if size < 1e-9 or step == n - 1 or step % 10 == 0:
            value = float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))[0])
            if size < 1e-9 or step == n - 1 or abs(value - before) < 1e-12:
                return max(value, 0.0)
            before = value
        beta.append(size)
        q = w / size
    return max(alpha[0], 0.0)


#: Columns of a profile beside image and level.
PROFILE = ("vertices", "edges", "trace", "trace2", "components")


def laplacian_profile(grid: DataFrame, values: list[float], second: bool = True, whole: int = WHOLE) -> DataFrame:
    """(image_id, k, vertices, edges, trace, trace2, components, second) of the 4-neighbour graphs of {v <= values[k]}: sums of
    degrees, traces of L and L^2, near-zero eigenvalues (components), and, if asked for, the second eigenvalue, 0 for a graph of several
    parts. Images of at most `whole` pixels are worked out in the tasks of a single shuffle by image, larger ones by rounds."""
    large = save(grid.groupBy(I).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(I), "large")
    if large.isEmpty():
        return _profiles(grid, values, second)
    hinted = large.hint("merge")
    return _profiles(grid.join(hinted, I, "left_anti"), values, second).unionByName(_profiles_by_rounds(grid.join(hinted, I), values, second))


def _profiles(grid: DataFrame, values: list[float], second: bool) -> DataFrame:
    kind = grid.schema[I].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            image, r, c, v, known = flat_pixels(batch)
            order, width = np.lexsort((c, r, image)), int(c.max()) + 2  # one column more, so that no row runs into the next
            ids = ((image * (int(r.max()) + 2) + r) * width + c)[order]
            image, v, known = image[order], v[order], known[order]
            for k, t in enumerate(values):
                on = known & (v <= t)
                own, low = image[on], ids[on]
                near = [ends(low, low, low + step) for step in (1, width)]
                a, b = (np.concatenate([x[side][x[2]] for x in near]) for side in (0, 1))
                degree = np.bincount(a, minlength=len(low)) + np.bincount(b, minlength=len(low))
                count = lambda which, by=None: np.bincount(which, by, batch.num_rows).astype(np.int64)
                label = least_labels(len(low), a, b)
                vertices, components, trace = count(own), count(own[label == np.arange(len(low))]), count(own, degree)
                columns = [vertices, trace // 2, trace, count(own, degree * degree + degree), components]
                if second:
                    columns.append(_seconds(batch.num_rows, own, a, b, (components == 1) & (vertices > 1)))
                yield pa.RecordBatch.from_arrays([batch[I], pa.array(np.full(batch.num_rows, k, np.int32)), *map(pa.array, columns)], names=[I, "k", *PROFILE, *["second"] * second])

    return tiles(grid, 0, side=1 << 31).mapInArrow(run, f"{I} {kind}, k int, " + ", ".join(f"{c} bigint" for c in PROFILE) + ", second double" * second)


def _seconds(n: int, own: np.ndarray, a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Second eigenvalues of the wanted ones of n graphs; own gives the graph of each node, graphs after one another."""
    order = np.argsort(own[a], kind="stable")
    a, b = a[order], b[order]
    first, cut, out = np.searchsorted(own, np.arange(n + 1)), np.searchsorted(own[a], np.arange(n + 1)), np.zeros(n)
    for g in np.flatnonzero(wanted):
        edges = slice(cut[g], cut[g + 1])
        out[g] = second_eigenvalue(int(first[g + 1] - first[g]), a[edges] - first[g], b[edges] - first[g])
    return out


def _profiles_by_rounds(grid: DataFrame, values: list[float], second: bool) -> DataFrame:
    """The images together by rounds of joins. Only connected graphs go to the eigenvalue step, each one to a task."""
    spark = grid.sparkSession
    # a table of fixed size
    t = F.broadcast(spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k int, t double"))
    level = F.struct(I, "k")
    sub = save(grid.join(t).where("v <= t").select(level.alias(I), "r", "c", "v"), "sublevels")
    edges = save(grid_edges(sub, 4).select(F.col(I).alias("g"), at("r", "c").alias("a"), at("r2", "c2").alias("b")), "edges")
    nodes = sub.select(F.col(I).alias("g"), at("r", "c").alias("id"))
    degree = edges.select("g", F.explode(F.array("a", "b")).alias("id")).groupBy("g", "id").agg(F.count("*").alias("d"))
    moment = degree.groupBy("g").agg(F.sum("d").alias("trace"), F.sum(F.col("d") * F.col("d") + F.col("d")).alias("trace2"))
    labels = connected_components(nodes, edges)
    parts = labels.groupBy("g").agg(F.count("*").alias("vertices"), F.countDistinct("label").alias("components"))
    out = parts.join(moment, "g", "left").select(F.col(f"g.{I}").alias(I), F.col("g.k").alias("k"), "vertices", "components", "trace", "trace2")
    spine = grid.select(I).distinct().join(t.select("k"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    got = spine.join(out, [I, "k"], "left").select(I, "k", zero("vertices"), (F.coalesce("trace", F.lit(0)) / 2).cast("long").alias("edges"), zero("trace"), zero("trace2"), zero("components"))
    if not second:
        return got
    whole = parts.where("components = 1 and vertices > 1").select("g", "vertices")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        ids, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        value = second_eigenvalue(len(ids), number[: len(a)], number[len(a) :])
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([value])], names=[I, "k", "second"])

    kind = grid.schema[I].dataType.simpleString()
    flat = edges.join(whole, "g").select(F.col(f"g.{I}").alias(I), F.col("g.k").alias("k"), "a", "b")
    eigen = flat.groupBy(I, "k").applyInArrow(run, f"{I} {kind}, k int, second double")
    return got.join(eigen, [I, "k"], "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
