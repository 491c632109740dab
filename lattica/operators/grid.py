"""Grid topology, morphology and texture on grid(image_id, r, c, v) and voxels(image_id, z, y, x, v)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, small
from lattica.operators.pixels import SIDE, SOBEL_X, SOBEL_Y, filtered, flat_pixels, places, quantize, slices, tiles, weighted_sum

I = "image_id"
STEPS = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def pixel_id(r: str, c: str) -> Column:
    """One number for a pixel of an image of any size, in row order."""
    return F.shiftleft(F.col(r).cast("long"), 32) + F.col(c)


def grid_edges(grid: DataFrame, conn: int = 8) -> DataFrame:
    """(image_id, r, c, v, r2, c2, v2): each pair of neighbours once."""
    step = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in STEPS[conn]])
    go = grid.withColumn("s", F.explode(step)).withColumn("r2", F.col("r") + F.col("s.dr")).withColumn("c2", F.col("c") + F.col("s.dc")).drop("s")
    return go.join(grid.select(I, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("v").alias("v2")), [I, "r2", "c2"])


def cells_of(grid: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, entry, sign): the pixel, edge and corner cells of the 8-connected complex with the value at which
    each enters a sublevel filtration: the least of the pixels that it touches. Signs add up to the Euler number."""
    own = grid.select(I, F.explode(F.array(*[F.struct(F.col("r") * 2 + a, F.col("c") * 2 + b, F.lit(1 - 2 * ((a + b) % 2))) for a in (0, 1, 2) for b in (0, 1, 2)])).alias("s"), F.col(value).alias("e"))
    # a pixel is the open square at odd places, its edges and corners lie around it
    return own.select(I, F.col("s.col1").alias("y"), F.col("s.col2").alias("x"), F.col("s.col3").alias("sign"), "e").groupBy(I, "y", "x", "sign").agg(F.min("e").alias("entry")).select(I, "entry", "sign")


def euler_curve(grid: DataFrame, n: int = 32) -> DataFrame:
    """(image_id, k, t, chi): Euler number of {v < t} at n even thresholds. Tasks count the cells of `cells_of` on squares of images: a
    pixel's own, and those above and left of it."""
    kind = grid.schema[I].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tile, r, c, v, known = flat_pixels(batch)
            at, r0, c0 = places(batch, tile, r, c, 1)
            pixel = np.pad(at, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
            there, sure = pixel >= 0, (pixel >= 0) & known[pixel]
            value = np.where(sure, v[pixel], np.inf)
            own = ((r0[:, None] + np.arange(at.shape[1] + 1)) // SIDE == batch["tr"].to_numpy()[:, None])[:, :, None] & ((c0[:, None] + np.arange(at.shape[2] + 1)) // SIDE == batch["tc"].to_numpy()[:, None])[:, None, :]
            four = lambda x: (x[:, 1:, 1:], x[:, :-1, 1:], x[:, 1:, :-1], x[:, :-1, :-1])
            chi = np.zeros((batch.num_rows, n), np.int64)
            for sign, near in ((1, [0]), (-1, [0, 1]), (-1, [0, 2]), (1, [0, 1, 2, 3])):
                some, any_, least = (f.reduce([four(x)[k] for k in near]) for f, x in ((np.logical_or, there), (np.logical_or, sure), (np.minimum, value)))
                first = np.where(any_, np.maximum(np.floor(np.where(any_, least, 0.0) * (n - 1)) + 1, 0), 0)  # first threshold above the entry
                t, y, x = np.nonzero(own & some & (first < n))
                np.add.at(chi, (t, first[t, y, x].astype(np.int64)), sign)
            chi = np.cumsum(chi, axis=1)
            ids = batch[I].take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(chi.ravel())], names=[I, "k", "chi"])

    got = tiles(grid, 1, 1).mapInArrow(run, f"{I} {kind}, k int, chi bigint").groupBy(I, "k").agg(F.sum("chi").alias("chi"))
    return got.select(I, "k", (F.col("k") / F.lit(n - 1)).alias("t"), "chi")


def euler_number(mask: DataFrame, conn: int = 4) -> DataFrame:
    """Euler number of fg pixels: V - E + F with 4-neighbours, by windows after one shuffle by image, or the 8-connected complex."""
    if conn == 8:
        got = cells_of(mask.where("fg = 1").withColumn("one", F.lit(0.0)), "one").groupBy(I).agg(F.sum("sign").alias("chi"))
        return mask.select(I).distinct().join(got, I, "left").select(I, F.coalesce("chi", F.lit(0)).cast("long").alias("chi"))
    row, col = Window.partitionBy(I, "r").orderBy("c"), Window.partitionBy(I, "c").orderBy("r")
    m = mask.select(I, "r", "c", "fg").repartition(I).withColumn("right", F.coalesce(F.lead("fg").over(row), F.lit(0))).withColumn("down", F.coalesce(F.lead("fg").over(col), F.lit(0)))
    m = m.withColumn("across", F.coalesce(F.lead("down").over(row), F.lit(0)))
    v, right, down = F.col("fg"), F.col("right"), F.col("down")
    return m.groupBy(I).agg(F.sum(v - v * right - v * down + v * right * down * F.col("across")).cast("long").alias("chi"))


def minkowski(grid: DataFrame, thresholds: list[float]) -> DataFrame:
    """(image_id, t, volume, surface, chi), the first two as shares of all pixels: fg = v > t, surface = fg with a
    4-neighbour outside fg or outside the image. Neighbours come by windows over the values, along columns and then rows, once for all
    thresholds; only then does a pixel become a row for each of them."""
    spark = grid.sparkSession
    # a table of fixed size
    t = F.broadcast(spark.createDataFrame([(float(x),) for x in thresholds], "t double"))
    row, col = Window.partitionBy(I, "r").orderBy("c"), Window.partitionBy(I, "c").orderBy("r")
    m = grid.select(I, "r", "c", "v").withColumn("down", F.lead("v").over(col)).withColumn("up", F.lag("v").over(col))
    m = m.withColumn("right", F.lead("v").over(row)).withColumn("left", F.lag("v").over(row)).withColumn("across", F.lead("down").over(row))
    fg = lambda x: (F.col(x) > F.col("t")).cast("int")
    v, (right, left, down, up, across) = fg("v"), (F.coalesce(fg(x), F.lit(0)) for x in ("right", "left", "down", "up", "across"))
    edge = v * (1 - right * left * down * up)
    return m.join(t).groupBy(I, "t").agg(F.avg(v).alias("volume"), F.avg(edge).alias("surface"), F.sum(v - v * right - v * down + v * right * down * across).cast("long").alias("chi"))


def euler_transform(mask: DataFrame, directions: int = 8, heights: int = 16) -> DataFrame:
    """(image_id, d, k, chi): Euler number of fg pixels up to each of n heights along each direction (8-connected)."""
    spark = mask.sparkSession
    angle = F.col("d") * math.pi / directions
    p = mask.where("fg = 1").join(small(spark, directions, "d")).withColumn("p", F.round(F.cos(angle) * F.col("r") + F.sin(angle) * F.col("c"), 9))
    w = over(I, "d")
    low, high = F.min("p").over(w), F.max("p").over(w)
    at = F.when(high > low, F.ceil(F.round((F.col("p") - low) / F.nullif(high - low, F.lit(0.0)) * (heights - 1), 6)))
    p = p.withColumn("at", at).where("at is not null").withColumn(I, F.struct(I, "d"))
    got = cells_of(p, "at").groupBy(I, F.col("entry").cast("int").alias("k")).agg(F.sum("sign").alias("s")).select(f"{I}.{I}", f"{I}.d", "k", "s")
    spine = mask.select(I).distinct().join(small(spark, directions, "d")).join(small(spark, heights, "k"))
    chi = F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy(I, "d").orderBy("k"))
    return spine.join(got, [I, "d", "k"], "left").select(I, "d", "k", chi.cast("long").alias("chi"))


def level_set_growth(grid: DataFrame, n: int = 50, every: int = 10) -> DataFrame:
    t = small(grid.sparkSession, n, "k").where(F.col("k") % every == 0).withColumn("t", F.col("k") / F.lit(n - 1))
    return grid.join(F.broadcast(t)).groupBy(I, "k").agg(F.avg((F.col("v") <= F.col("t")).cast("int")).alias("sublevel"), F.avg((F.col("v") >= F.col("t")).cast("int")).alias("superlevel"))


def box_count_dimension(mask: DataFrame, sizes: list[int]) -> DataFrame:
    """Slope of log count on log size, negated, and R squared."""
    # a table of fixed size
    s = F.broadcast(mask.sparkSession.createDataFrame([(x,) for x in sizes], "s int"))
    boxes = mask.where("fg = 1").join(s).select(I, "s", F.floor(F.col("r") / F.col("s")).alias("br"), F.floor(F.col("c") / F.col("s")).alias("bc")).distinct()
    n = boxes.groupBy(I, "s").agg(F.count("*").alias("n"))
    return n.groupBy(I).agg((-F.regr_slope(F.log("n"), F.log("s"))).alias("dimension"), F.regr_r2(F.log("n"), F.log("s")).alias("r2"), F.max("n").alias("finest"), F.min("n").alias("coarsest"))


def lacunarity(mask: DataFrame, size: int = 2) -> DataFrame:
    """Variance over squared mean of gliding box masses, plus 1."""
    row, col = Window.partitionBy(I, "r").orderBy("c").rowsBetween(0, size - 1), Window.partitionBy(I, "c").orderBy("r").rowsBetween(0, size - 1)
    m = mask.withColumn("m", F.sum("fg").over(row)).withColumn("k", F.count("*").over(row)).withColumn("m", F.sum("m").over(col)).withColumn("l", F.count("*").over(col))
    mean = F.avg("m")
    return m.where((F.col("k") == size) & (F.col("l") == size)).groupBy(I).agg(F.when(mean > 0, F.var_pop("m") / F.nullif(mean * mean, F.lit(0.0)) + 1).otherwise(1.0).alias("lacunarity"))


RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def lbp_codes(grid: DataFrame) -> DataFrame:
    """(image_id, r, c, code): bit k is set where the k-th of 8 neighbours is at least the centre; border pixels, and those beside a
    missing one, are 0. Neighbours come by windows along columns and then rows, so an image is shuffled once."""
    row, col = Window.partitionBy(I, "r").orderBy("c"), Window.partitionBy(I, "c").orderBy("r")

    def step(w: Window, axis: str, by: int, value: str) -> Column:
        near = lambda x: F.lag(x, -by).over(w) if by < 0 else F.lead(x, by).over(w)
        return F.when(near(axis) == F.col(axis) + by, near(value))

    m = grid.select(I, "r", "c", "v").repartition(I).withColumn("v-1", step(col, "r", -1, "v")).withColumn("v0", F.col("v")).withColumn("v1", step(col, "r", 1, "v"))
    near = [step(row, "c", b, f"v{a}") if b else F.col(f"v{a}") for a, b in RING]
    m = m.select(I, "r", "c", "v", *[x.alias(f"n{k}") for k, x in enumerate(near)])
    bits = sum((F.when(F.col(f"n{k}") >= F.col("v"), 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    whole = F.lit(True)
    for k in range(8):
        whole = whole & F.col(f"n{k}").isNotNull()
    return m.select(I, "r", "c", F.when(whole, bits).otherwise(0).alias("code"))


def uniform_bin(code: Column) -> Column:
    """Number of set bits where at most two neighbours differ around the ring, else 9."""
    turned = F.shiftleft(code % 128, 1) + F.shiftright(code, 7)
    return F.when(F.bit_count(code.bitwiseXOR(turned)) <= 2, F.bit_count(code)).otherwise(9)


def lbp_histogram(grid: DataFrame, uniform: bool = True) -> DataFrame:
    code = lbp_codes(grid).withColumn("bin", uniform_bin(F.col("code")) if uniform else F.col("code"))
    return code.groupBy(I, "bin").agg(F.count("*").alias("n")).withColumn("density", F.col("n") / F.sum("n").over(over(I)))


def edge_histogram(grid: DataFrame, bins: int = 8, cells: int = 2) -> DataFrame:
    """(image_id, cell, bin, density): orientations of edges stronger than the 70th percentile of non-zero strengths."""
    g = filtered(grid, {"gx": (SOBEL_X, weighted_sum), "gy": (SOBEL_Y, weighted_sum)}).withColumnsRenamed({"h": "r_size", "wd": "c_size"})
    g = g.withColumn("m", F.round(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 9)).where("m > 0")
    g = g.withColumn("cut", F.expr("percentile(m, 0.7)").over(over(I))).where("m > cut")
    angle = F.pmod(F.round(F.atan2("gy", "gx"), 9), F.lit(math.pi))
    side = lambda x: F.greatest(F.floor(F.col(f"{x}_size") / cells), F.lit(1))
    place = lambda x: F.least(F.floor(F.col(x) / side(x)), F.lit(cells - 1))
    cell = place("r") * cells + place("c")
    e = g.select(I, cell.cast("int").alias("cell"), F.least(F.floor(angle / math.pi * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    n = e.groupBy(I, "cell", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(over(I, "cell")) * (math.pi / bins)))


def glcm(grid: DataFrame, levels: int = 8, tall: int = 64, stride: int = 4) -> DataFrame:
    """Contrast and homogeneity of horizontal neighbours, symmetric; of images of more than `tall` rows every stride-th row and
    column counts."""
    seen = F.when(F.max("r").over(over(I)) + 1 > tall, (F.col("r") % stride == 0) & (F.col("c") % stride == 0)).otherwise(F.lit(True))
    few = grid.withColumn("seen", seen).where("seen").drop("seen")
    q = quantize(few, levels).withColumn("b", F.lead("q").over(Window.partitionBy(I, "r").orderBy("c"))).where("b is not null")
    gap = F.abs(F.col("q") - F.col("b"))  # both measures are the same for (a, b) and (b, a)
    return q.groupBy(I).agg(F.avg(gap * gap).alias("contrast"), F.avg(1 / (1 + gap)).alias("homogeneity"))


def low_frequency_ratio(grid: DataFrame) -> DataFrame:
    """Share of the summed DFT amplitudes within radius min(h, w) // 8 of the centre, for images of any size: rows are
    transformed, then columns."""
    size = grid.groupBy(I).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("wd"))
    sized = grid.join(size, I)
    turn = lambda x, y, n: -2 * math.pi * F.col(x) * F.col(y) / F.col(n)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = sized.withColumn("k", upto("wd")).groupBy(I, "h", "wd", "r", "k").agg(F.sum(F.col("v") * F.cos(turn("c", "k", "wd"))).alias("re"), F.sum(F.col("v") * F.sin(turn("c", "k", "wd"))).alias("im"))
    cos, sin = F.cos(turn("r", "j", "h")), F.sin(turn("r", "j", "h"))
    both = rows.withColumn("j", upto("h")).groupBy(I, "h", "wd", "k", "j").agg(F.sum(F.col("re") * cos - F.col("im") * sin).alias("re"), F.sum(F.col("re") * sin + F.col("im") * cos).alias("im"))
    far = lambda x, n: F.when(F.col(x) >= F.floor((F.col(n) + 1) / 2), F.col(x) - F.col(n)).otherwise(F.col(x))
    a = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    near = far("k", "wd") ** 2 + far("j", "h") ** 2 <= F.floor(F.least("h", "wd") / 8) ** 2
    return both.groupBy(I).agg((F.sum(F.when(near, a).otherwise(0.0)) / F.sum(a)).alias("ratio"))


def anisotropy_faces(voxels: DataFrame, t: float = 0.5) -> DataFrame:
    """3-D Euler number with 6-neighbours, volume and exposed faces of v > t."""
    def ahead(axis: str, col: str) -> Column:
        rest = [a for a in "zyx" if a != axis]
        return F.coalesce(F.lead(col).over(Window.partitionBy(I, *rest).orderBy(axis)), F.lit(0))

    m = voxels.withColumn("o", (F.col("v") > t).cast("int")).withColumn("ox", ahead("x", "o")).withColumn("oy", ahead("y", "o")).withColumn("oz", ahead("z", "o"))
    m = m.withColumn("oxy", ahead("x", "oy")).withColumn("oxz", ahead("x", "oz")).withColumn("oyz", ahead("y", "oz")).withColumn("oxyz", ahead("x", "oyz"))
    o, ox, oy, oz = (F.col(c) for c in ("o", "ox", "oy", "oz"))
    xy, xz, yz = o * ox * oy * F.col("oxy"), o * ox * oz * F.col("oxz"), o * oy * oz * F.col("oyz")
    cube = xy * oz * F.col("oxz") * F.col("oyz") * F.col("oxyz")
    pairs = o * ox + o * oy + o * oz
    return m.groupBy(I).agg(F.sum(o).alias("volume"), F.sum(6 * o - 2 * pairs).alias("faces"), F.sum(o - pairs + xy + xz + yz - cube).cast("long").alias("chi"))
