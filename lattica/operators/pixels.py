"""Pixel projections, filters and neighbourhood operators on grid(image_id, r, c, v)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over

I = "image_id"


def to_gray(rgb: DataFrame, mode: str = "mean") -> DataFrame:
    """One channel from (image_id, channel, r, c, v): mean, luma, red, green, blue, hsv_value or hsv_saturation."""
    one = rgb.groupBy(I, "r", "c").agg(*[F.max(F.when(F.col("channel") == x, F.col("v"))).alias(f"of_{x}") for x in "RGB"])
    r, g, b = (F.col(f"of_{x}") for x in "RGB")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    modes = {"mean": (r + g + b) / 3, "luma": 0.299 * r + 0.587 * g + 0.114 * b, "red": r, "green": g, "blue": b, "hsv_value": top, "hsv_saturation": F.when(top != 0, (top - low) / F.nullif(top, F.lit(0.0))).otherwise(0.0)}
    return one.select(I, "r", "c", modes[mode].alias("v"))


def scale_255(grid: DataFrame) -> DataFrame:
    return grid.withColumn("v", F.when(F.max("v").over(over(I)) > 1, F.col("v") / 255).otherwise(F.col("v")))


def block_downsample(grid: DataFrame, most: int) -> DataFrame:
    """Block means where a side is longer than `most`; rows and columns that fill no block are cut."""
    size = grid.groupBy(I).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    scale = F.lit(float(most)) / F.greatest("h", "w", F.lit(most))
    block = lambda x: F.floor(F.col(x) / F.greatest(F.floor(F.col(x) * scale), F.lit(1))).cast("int")
    side = lambda x: F.greatest(F.floor(F.col(x) * scale), F.lit(1)).cast("int")
    size = size.select(I, block("h").alias("bh"), block("w").alias("bw"), side("h").alias("nh"), side("w").alias("nw"))
    cut = grid.join(size, I).withColumn("r", F.floor(F.col("r") / F.col("bh")).cast("int")).withColumn("c", F.floor(F.col("c") / F.col("bw")).cast("int"))
    return cut.where("r < nh and c < nw").groupBy(I, "r", "c").agg(F.avg("v").alias("v"))


def quantize(grid: DataFrame, n: int) -> DataFrame:
    return grid.withColumn("q", F.least(F.greatest(F.floor(F.col("v") * n), F.lit(0)), F.lit(n - 1)).cast("int"))


def otsu_threshold(grid: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, threshold): the first bin that has the greatest variance between classes; 0.5 without a split."""
    count = quantize(grid, bins).groupBy(I, "q").agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy(I).orderBy("q"), over(I)
    x = (F.col("q") + 0.5) / bins
    t = count.withColumn("wb", F.sum("n").over(up)).withColumn("sb", F.sum(F.col("n") * x).over(up)).withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * x).over(all_))
    wf = F.col("w") - F.col("wb")
    gain = F.when(wf > 0, F.round(F.col("wb") * wf * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.nullif(wf, F.lit(0)), 2), 6))
    best = t.withColumn("gain", gain).groupBy(I).agg(F.max("gain").alias("top"), F.min_by((F.col("q") + 0.5) / bins, F.struct(F.coalesce(-F.col("gain"), F.lit(1.0)), F.col("q"))).alias("at"))
    return best.select(I, F.when(F.col("top") > 0, F.col("at")).otherwise(0.5).alias("threshold"))


def binarize(grid: DataFrame, method: str = "otsu", threshold: float = 0.5) -> DataFrame:
    """Adds fg (0 or 1) and the threshold used."""
    if method == "otsu":
        grid = grid.join(otsu_threshold(grid), I)
    elif method == "midrange":
        w = over(I)
        low, high = F.min("v").over(w), F.max("v").over(w)
        grid = grid.withColumn("threshold", F.when((low < 0) | (high > 1), (low + high) / 2).otherwise(0.5))
    else:
        grid = grid.withColumn("threshold", F.lit(threshold))
    return grid.withColumn("fg", (F.col("v") > F.col("threshold")).cast("int"))


#: Side of the squares into which larger images are cut, so that no row or task holds more than a square and what surrounds it.
SIDE = 64
#: Pixels and squares that a task works on at once.
AT_ONCE, SQUARES = 1 << 15, 512

Kernel = list[tuple[int, int, float]]
#: (values u, whether each is there, weights w, the pixel's own value v) to a value: u has a row for each place of the kernel.
Filter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def reflect(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index of the mirrored border (the edge pixel is repeated)."""
    return np.where(x < 0, -x - 1, np.where(x >= n, 2 * n - 1 - x, x))


def tiles(grid: DataFrame, reach: int, beyond: int = 0, side: int = SIDE) -> DataFrame:
    """(image_id, h, wd, tr, tc, pixels array<struct<r, c, v>>): squares of each image's pixels, with those at most `reach` away from
    them; squares begin up to `beyond` after the image's end. One shuffle by image, none where pixels lie by image."""
    w = over(I)
    sized = grid.select(I, "r", "c", F.col("v").cast("double").alias("v"), (F.max("r").over(w) + 1).alias("h"), (F.max("c").over(w) + 1).alias("wd"))
    upto = lambda x, n: F.explode(F.sequence(F.floor(F.greatest(F.col(x) - reach, F.lit(0)) / side), F.floor(F.least(F.col(x) + reach, F.col(n) - 1 + beyond) / side)))
    placed = sized.withColumn("tr", upto("r", "h")).withColumn("tc", upto("c", "wd"))
    return placed.groupBy(I, "h", "wd", "tr", "tc").agg(F.collect_list(F.struct("r", "c", "v")).alias("pixels"))


def slices(batches: Iterable[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cuts batches of tiles so that those of a slice hold at most `most` pixels, or are a single one."""
    for batch in batches:
        ends, begin = batch["pixels"].offsets.to_numpy(), 0
        while begin < batch.num_rows:
            end = min(begin + SQUARES, max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1))
            yield batch.slice(begin, end - begin)
            begin = end


def flat_pixels(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all pixels of some tiles: number of the tile, r, c, v and whether v is there."""
    pixels, lists = batch["pixels"].flatten(), batch["pixels"]
    tile = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    r, c, v = (pixels.field(k) for k in range(3))
    r, c, known = r.to_numpy().astype(np.int64), c.to_numpy().astype(np.int64), ~np.asarray(v.is_null().to_numpy(zero_copy_only=False), bool)
    return tile, r, c, np.where(known, v.to_numpy(zero_copy_only=False), 0.0), known


def places(batch: pa.RecordBatch, tile: np.ndarray, r: np.ndarray, c: np.ndarray, reach: int, side: int = SIDE) -> tuple[np.ndarray, ...]:
    """A table that gives the pixel at each place of each tile, -1 where none is, with the place of a tile's first row and column."""
    first = [np.maximum(batch[x].to_numpy().astype(np.int64) * side - reach, 0) for x in ("tr", "tc")]
    y, x = r - first[0][tile], c - first[1][tile]
    at = np.full((batch.num_rows, int(y.max()) + 1, int(x.max()) + 1), -1, np.int32)
    at[tile, y, x] = np.arange(len(r))
    return at, *first


def filtered(grid: DataFrame, filters: dict[str, tuple[Kernel, Filter]], side: int = SIDE) -> DataFrame:
    """(image_id, r, c, h, wd, one column a filter): what a filter makes of the values that its kernel (dr, dc, weight) reaches from each
    pixel, mirrored at borders, and of the image's size. Pixels from which a kernel reaches none are left out, and a filter of values
    that are all null gives null. Tasks work on squares of images, many at a time."""
    reach = max(max(abs(a), abs(b)) for kernel, _ in filters.values() for a, b, _ in kernel)
    kind = {c: grid.schema[c].dataType.simpleString() for c in (I, "r", "c")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tile, r, c, v, known = flat_pixels(batch)
            at, r0, c0 = places(batch, tile, r, c, reach, side)
            h, wd, tr, tc = (batch[x].to_numpy().astype(np.int64) for x in ("h", "wd", "tr", "tc"))
            own = np.flatnonzero((r // side == tr[tile]) & (c // side == tc[tile]))
            t, y, x = tile[own], r[own], c[own]
            reached, out = np.ones(len(own), bool), []
            for kernel, f in filters.values():
                u, there, any_ = np.zeros((len(kernel), len(own))), np.zeros((len(kernel), len(own)), bool), np.zeros(len(own), bool)
                rows = {a: reflect(y + a, h[t]) - r0[t] for a in {a for a, _, _ in kernel}}
                columns = {b: reflect(x + b, wd[t]) - c0[t] for b in {b for _, b, _ in kernel}}
                for k, (a, b, _) in enumerate(kernel):
                    yy, xx = rows[a], columns[b]
                    inside = (yy >= 0) & (xx >= 0) & (yy < at.shape[1]) & (xx < at.shape[2])
                    pixel = at[t, np.where(inside, yy, 0), np.where(inside, xx, 0)]
                    found = inside & (pixel >= 0)
                    any_ |= found
                    there[k] = found & known[pixel]
                    u[k] = np.where(there[k], v[pixel], 0.0)
                value = f(u, there, np.array([w for _, _, w in kernel]), np.where(known[own], v[own], np.nan))
                out.append((value, ~there.any(axis=0)))
                reached &= any_
            keep = np.flatnonzero(reached)
            ids = batch[I].take(pa.array(t[keep]))
            size = [pa.array(z[t[keep]]) for z in (h, wd)]
            columns = [pa.array(value[keep], mask=empty[keep]) for value, empty in out]
            yield pa.RecordBatch.from_arrays([ids, pa.array(y[keep]), pa.array(x[keep]), *size, *columns], names=[I, "r", "c", "h", "wd", *filters])

    schema = f"{I} {kind[I]}, r bigint, c bigint, h bigint, wd bigint, " + ", ".join(f"`{name}` double" for name in filters)
    got = tiles(grid.where(F.col(I).isNotNull()), reach, side=side).mapInArrow(run, schema)
    return got.select(I, *[F.col(x).cast(kind[x]).alias(x) for x in ("r", "c")], "h", "wd", *filters)


def weighted_sum(u: np.ndarray, there: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return w @ u  # values that are not there are 0


def median(u: np.ndarray, there: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    order, n = np.sort(np.where(there, u, np.nan), axis=0), there.sum(axis=0)
    each = np.arange(u.shape[1])
    return (order[np.maximum(n - 1, 0) // 2, each] + order[n // 2, each]) / 2


def convolve(grid: DataFrame, kernel: Kernel) -> DataFrame:
    return filtered(grid, {"v": (kernel, weighted_sum)}).select(I, "r", "c", "v")


SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(c, r, w) for r, c, w in SOBEL_X]
LAPLACE = [(0, 0, -4), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1)]


def uniform(k: int) -> Kernel:
    h = k // 2
    return [(a, b, 1.0 / (k * k)) for a in range(-h, h + 1) for b in range(-h, h + 1)]


def gaussian(sigma: float) -> Kernel:
    import math

    h = int(4 * sigma + 0.5)
    raw = {(a, b): math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for a in range(-h, h + 1) for b in range(-h, h + 1)}
    total = sum(raw.values())
    return [(a, b, w / total) for (a, b), w in raw.items()]


def median_filter(grid: DataFrame, k: int = 3) -> DataFrame:
    return filtered(grid, {"v": (uniform(k), median)}).select(I, "r", "c", "v")


def bilateral_filter(grid: DataFrame, sigma_s: float = 1.0, sigma_r: float = 0.1, k: int = 5) -> DataFrame:
    h = k // 2
    import math

    def run(u: np.ndarray, there: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        near = np.where(there, w[:, None] * np.exp(-((u - v) ** 2) / (2 * sigma_r**2)), 0.0)
        return (near * u).sum(axis=0) / near.sum(axis=0)

    kernel = [(a, b, math.exp(-(a * a + b * b) / (2 * sigma_s**2))) for a in range(-h, h + 1) for b in range(-h, h + 1)]
    return filtered(grid, {"v": (kernel, run)}).select(I, "r", "c", "v")


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.join(after.withColumnRenamed("v", "f"), [I, "r", "c"])
    a, b = F.stddev_pop("v"), F.stddev_pop("f")
    return both.groupBy(I).agg(a.alias("original_std"), b.alias("filtered_std"), F.when(a > 0, (a - b) / F.nullif(a, F.lit(0.0))).otherwise(0.0).alias("reduction"), F.min("f").alias("low"), F.max("f").alias("high"))


def gradient(grid: DataFrame) -> DataFrame:
    """Central differences inside, one-sided at the edges; gy along rows, gx along columns, and their length."""

    def along(line: str, at: str) -> Column:
        w = Window.partitionBy(I, line).orderBy(at)
        back, ahead = F.lag("v").over(w), F.lead("v").over(w)
        return F.coalesce((ahead - back) / 2, ahead - F.col("v"), F.col("v") - back, F.lit(0.0))

    g = grid.withColumn("gy", along("c", "r")).withColumn("gx", along("r", "c"))
    return g.withColumn("magnitude", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))


def box_mean_3(grid: DataFrame, name: str = "s") -> DataFrame:
    """Adds the mean of 3 x 3 pixels, mirrored at borders, to grids without gaps: sums along rows and then columns by windows."""
    def along(line: str, at: str, value: str) -> Column:
        w = Window.partitionBy(I, line).orderBy(at)
        return F.coalesce(F.lag(value).over(w), F.col(value)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.col(value))

    return grid.withColumn(name, along("r", "c", "v")).withColumn(name, along("c", "r", name) / 9)


def image_stats(grid: DataFrame) -> DataFrame:
    """Bright, dark and middle shares, SNR, contrast, variance, edge density, mean and std of each image."""
    g = gradient(box_mean_3(grid.repartition(I))).withColumn("top", F.max("magnitude").over(over(I)))  # one shuffle, by image
    v, noise = F.col("v"), F.var_pop(F.col("v") - F.col("s"))
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    return g.groupBy(I).agg(
        share(v > 0.7).alias("bright_ratio"), share(v < 0.3).alias("dark_ratio"), share((v >= 0.3) & (v <= 0.7)).alias("mid_ratio"),
        F.round(F.when(noise <= 1e-10, 100.0).otherwise(F.var_pop("s") / F.nullif(noise, F.lit(0.0))), 2).alias("snr"),
        F.round((F.max("v") - F.min("v")) / F.nullif(F.max("v") + F.min("v"), F.lit(0.0)), 4).alias("contrast"),
        F.round(F.var_pop("v"), 6).alias("variance"), share((F.col("top") > 0) & (F.col("magnitude") / F.nullif("top", F.lit(0.0)) > 0.2)).alias("edge_density"),
        F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"),
    )


def recommend_preprocessing(stats: DataFrame) -> DataFrame:
    """Filtration, noise filter and complexity chosen from image_stats by fixed limits."""
    bright, dark, snr = F.col("bright_ratio"), F.col("dark_ratio"), F.col("snr")
    return stats.select(
        I, F.when(dark > bright + 0.1, "superlevel").when(bright > dark + 0.1, "sublevel").otherwise("sublevel").alias("filtration"),
        F.when(snr < 5, "median").when(snr < 10, "gaussian").otherwise("none").alias("noise_filter"),
        F.when(snr < 5, 0.2).when(snr < 15, 0.1).otherwise(0.05).alias("sigma"),
        F.when(F.col("edge_density") > 0.3, "high").when(F.col("edge_density") > 0.1, "medium").otherwise("low").alias("complexity"),
    )
