"""Characteristics of image datasets: 25 values that tell how large, bright, rough and disconnected their images are.

grid(image_id, r, c, v) holds values from 0 to 1; members(dataset, image_id, label) say which images a dataset has. Each image
is worked out once (`of_images`), whatever the number of datasets and samples that it is in; datasets are then aggregates.
Pixels are written once, as squares, by one shuffle by image. An image that is one whole square is worked out in a task; larger
images and those with gaps are worked out together by joins, where pixels only meet neighbours of their own kind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over, save
from lattica.operators.components import connected_components, least_labels
from lattica.operators.grid import I, glcm, grid_edges, low_frequency_ratio
from lattica.operators.grid import pixel_id as at
from lattica.operators.pixels import LAPLACE, binarize, convolve, gradient

NAMES = (
    "n_samples n_classes samples_per_class class_imbalance intensity_mean intensity_std intensity_skewness intensity_kurtosis intensity_p95_p5 intensity_entropy "
    "edge_density gradient_mean otsu_components otsu_holes binary_fill_ratio glcm_contrast glcm_homogeneity fft_low_freq_ratio otsu_stability "
    "component_size_mean component_size_cv fg_bg_contrast polarity largest_component_ratio laplacian_variance"
).split()
#: Bins in which the ranks of percentiles are found.
BINS = 4096
#: Side of the squares: at most 2^20 pixels in a row or a task.
SIDE = 1024
#: What is known of an image.
OF_IMAGE = "n_comp bigint, area bigint, squares bigint, holes bigint, fill double, largest double, contrast double, polarity double, gradient_mean double, edge_density double, glcm_contrast double, glcm_homogeneity double, ratio double, laplacian double"


def or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def parts(mask: DataFrame) -> DataFrame:
    """(image_id, fg, label, size, edge): 4-connected parts of foreground and background, and whether one touches the border."""
    w = over(I)
    m = mask.withColumn("edge", ((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.max("r").over(w)) | (F.col("c") == F.max("c").over(w))).cast("int"))
    pixels = save(m.select(F.col(I).alias("g"), at("r", "c").alias("id"), "fg", "edge"), "pixels")
    step = grid_edges(mask.select(I, "r", "c", F.col("fg").alias("v")), 4).where("v = v2")
    labels = connected_components(pixels.select("g", "id"), step.select(F.col(I).alias("g"), at("r", "c").alias("a"), at("r2", "c2").alias("b")))
    return labels.join(pixels, ["g", "id"]).groupBy(F.col("g").alias(I), "fg", "label").agg(F.count("*").alias("size"), F.max("edge").alias("edge"))


def squares(grid: DataFrame) -> DataFrame:
    """(image_id, tr, tc, pixels array<struct<r, c, v>> in row order), written; `whole`: no pixel is missing, doubled or no number."""
    part = lambda x: F.floor(F.col(x) / SIDE).alias(f"t{x}")
    g = grid.select(I, part("r"), part("c"), F.struct("r", "c", F.col("v").cast("double").alias("v")).alias("p"))
    g = g.groupBy(I, "tr", "tc").agg(F.array_sort(F.collect_list("p")).alias("pixels"))
    wide = F.element_at("pixels", -1)["c"] + 1
    known = lambda p, k: (p["r"] * wide + p["c"]).eqNullSafe(k.cast("bigint")) & p["v"].isNotNull() & ~F.isnan(p["v"]) & (F.abs(p["v"]) < float("inf"))
    return save(g.withColumn("whole", (F.col("tr") == 0) & (F.col("tc") == 0) & F.forall(F.transform("pixels", known), lambda x: F.coalesce(x, F.lit(False)))), "squares")


def _split(v: np.ndarray, bins: int = 256) -> float:
    """The threshold of `otsu_threshold`."""
    n = np.bincount(np.clip(np.floor(v * bins), 0, bins - 1).astype(np.int64).ravel(), minlength=bins)
    q = np.flatnonzero(n)
    x, n = (q + 0.5) / bins, n[q]
    wb, sb = np.cumsum(n), np.cumsum(n * x)
    wf = wb[-1] - wb
    gain = wb[:-1] * wf[:-1] * (sb[:-1] / wb[:-1] - (sb[-1] - sb[:-1]) / wf[:-1]) ** 2
    gain = np.where(gain < 1e9, np.floor(gain * 1e6 + 0.5) / 1e6, gain)
    return float(x[gain.argmax()]) if len(gain) and gain.max() > 0 else 0.5


def _slopes(v: np.ndarray) -> np.ndarray:
    """Differences along the first axis, one-sided at the ends."""
    return np.gradient(v, axis=0) if len(v) > 1 else np.zeros_like(v)


def _of_image(v: np.ndarray) -> tuple:
    """The values of OF_IMAGE of a whole image, as `_by_joins` has them."""
    h, wide = v.shape
    fg = v > _split(v)
    ids = np.arange(v.size).reshape(v.shape)
    right, down = fg[:, 1:] == fg[:, :-1], fg[1:] == fg[:-1]
    label = least_labels(v.size, np.concatenate([ids[:, :-1][right], ids[:-1][down]]), np.concatenate([ids[:, 1:][right], ids[1:][down]]))
    size = np.bincount(label, minlength=v.size)
    edge = np.zeros(v.size, bool)
    edge[np.concatenate([label[ids[0]], label[ids[-1]], label[ids[:, 0]], label[ids[:, -1]]])] = True
    part, own = size > 0, fg.ravel()  # a part's label is one of its pixels
    of, back = size[part & own], part & ~own
    area, inside = int(of.sum()), int(size[back & ~edge].sum())
    gap = v[fg].mean() - v[~fg].mean() if 0 < area < v.size else None
    m = np.sqrt(_slopes(v) ** 2 + _slopes(v.T).T ** 2)
    mean = m.mean()
    q = np.clip(np.floor((v[::4, ::4] if h > 64 else v) * 8), 0, 7)
    step = np.abs(np.diff(q, axis=1))
    a = np.abs(np.fft.fft2(v))
    far = lambda n: np.abs(np.fft.fftfreq(n, 1 / n)) ** 2
    near = far(h)[:, None] + far(wide)[None, :] <= (min(h, wide) // 8) ** 2
    p = np.pad(v, 1, mode="edge")
    rough = p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * v
    return (
        len(of), area, int((of * of).sum()), max(0, int(back.sum()) - 1), (area + inside) / area if area else 0.0, int(of.max()) / area if area else 0.0,
        0.0 if gap is None else abs(float(gap)), 0.0 if gap is None else (1.0 if gap > 0 else -1.0), float(mean), float(((m > 2 * mean) & (mean > 0)).mean()),
        float((step * step).mean()) if step.size else None, float((1 / (1 + step)).mean()) if step.size else None, float(a[near].sum() / a.sum()) if a.sum() else None, float(rough.var()),
    )


def _in_tasks(whole: DataFrame) -> DataFrame:
    kind, names = whole.schema[I].dataType.simpleString(), [x.split()[0] for x in OF_IMAGE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch["values"].offsets.to_numpy(), batch["values"].values.to_numpy()
            rows = [_of_image(flat[a:b].reshape(-1, n)) for a, b, n in zip(ends[:-1], ends[1:], batch["wide"].to_pylist())]
            types = [pa.int64() if x.endswith("bigint") else pa.float64() for x in OF_IMAGE.split(", ")]
            yield pa.RecordBatch.from_arrays([batch[I], *[pa.array([row[k] for row in rows], t) for k, t in enumerate(types)]], names=[I, *names])

    arrays = whole.select(I, (F.element_at("pixels", -1)["c"] + 1).cast("int").alias("wide"), F.col("pixels.v").alias("values"))
    return arrays.mapInArrow(run, f"{I} {kind}, {OF_IMAGE}")


def of_images(cut: DataFrame) -> DataFrame:
    """One row for each image of squares, with whole-number sums of its components so that datasets can pool them."""
    odd = save(cut.where(~F.col("whole")).select(I).distinct(), "odd")
    if odd.isEmpty():
        return _in_tasks(cut)
    pixels = cut.join(odd, I).select(I, F.explode("pixels").alias("p")).select(I, "p.r", "p.c", "p.v")
    return _in_tasks(cut.join(odd, I, "left_anti")).unionByName(_by_joins(save(pixels, "grid")))


def _by_joins(grid: DataFrame) -> DataFrame:
    mask = save(binarize(grid, "otsu"), "mask")
    one = lambda c: F.when(c, 1).otherwise(0)
    own = F.col("fg") == 1
    p = parts(mask).groupBy(I).agg(
        F.sum(one(own)).alias("n_comp"), F.sum(one(~own)).alias("n_back"), F.sum(F.when(own, F.col("size")).otherwise(0)).alias("area"), F.sum(F.when(own, F.col("size") * F.col("size")).otherwise(0)).alias("squares"),
        F.max(F.when(own, F.col("size")).otherwise(0)).alias("largest"), F.sum(F.when(~own & (F.col("edge") == 0), F.col("size")).otherwise(0)).alias("inside"),
    )
    area = F.nullif("area", F.lit(0))
    p = p.select(I, "n_comp", "area", "squares", F.greatest(F.lit(0), F.col("n_back") - 1).alias("holes"), F.coalesce((F.col("area") + F.col("inside")) / area, F.lit(0.0)).alias("fill"), F.coalesce(F.col("largest") / area, F.lit(0.0)).alias("largest"))
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    sides = mask.groupBy(I).agg(mean(own).alias("f"), mean(~own).alias("b"))
    gap = F.col("f") - F.col("b")
    sides = sides.select(I, F.coalesce(F.abs(gap), F.lit(0.0)).alias("contrast"), F.coalesce(F.when(gap > 0, 1.0).otherwise(F.when(gap.isNotNull(), -1.0)), F.lit(0.0)).alias("polarity"))
    g = gradient(mask.select(I, "r", "c", "v")).withColumn("mean", F.avg("magnitude").over(over(I)))
    g = g.groupBy(I).agg(F.max("mean").alias("gradient_mean"), F.avg(one((F.col("magnitude") > 2 * F.col("mean")) & (F.col("mean") > 0))).alias("edge_density"))
    texture = glcm(grid).select(I, F.col("contrast").alias("glcm_contrast"), F.col("homogeneity").alias("glcm_homogeneity"))
    rough = convolve(grid, LAPLACE).groupBy(I).agg(F.var_pop("v").alias("laplacian"))
    return p.join(sides, I).join(g, I).join(texture, I, "left").join(low_frequency_ratio(grid), I).join(rough, I)


def exact_percentiles(values: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, one column a share): linear percentiles of values(keys, v from 0 to 1). A histogram finds the bins that hold the
    ranks; only their distinct values are sorted, so no group is collected or sorted whole."""
    binned = values.withColumn("bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)))
    h = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin")
    h = save(h.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(over(*keys))).withColumn("before", F.col("upto") - F.col("n")), "bins")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("all") - 1)).alias("pos")) for name, p in shares.items()]))
    ranks = h.select(*keys, "all").distinct().select(*keys, wanted.alias("w")).select(*keys, "w.name", "w.pos", F.explode(F.array(F.floor("w.pos"), F.ceil("w.pos"))).alias("rank")).distinct()
    held = ranks.join(h.select(*keys, "bin", "before", "upto"), keys).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
    few = binned.join(held.select(*keys, "bin", "before").distinct(), [*keys, "bin"]).groupBy(*keys, "bin", "before", "v").agg(F.count("*").alias("n"))
    few = few.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v")))
    met = held.select(*keys, "name", "pos", "rank", "bin").join(few.select(*keys, "bin", "v", "upto", F.col("n").alias("many")), [*keys, "bin"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("many")))
    two = met.groupBy(*keys, "name", "pos").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("pos") - F.floor("pos"))
    return two.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in shares])


def of_samples(cut: DataFrame, images: DataFrame, members: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """The 25 values for each key of sample(keys, image_id), keys beginning with dataset; sizes and classes count all members."""
    n = members.groupBy("dataset", "label").agg(F.count("*").alias("n")).groupBy("dataset").agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"), (F.max("n") / F.min("n")).alias("class_imbalance"))
    pixels = save(cut.select(I, F.col("pixels.v").alias("values")).join(sample, I).select(*keys, "values"), "values").select(*keys, F.explode("values").alias("v"))
    moments = pixels.groupBy(*keys).agg(F.avg("v").alias("intensity_mean"), F.stddev_pop("v").alias("intensity_std"), F.skewness("v").alias("intensity_skewness"), F.kurtosis("v").alias("intensity_kurtosis"))
    histogram = pixels.groupBy(*keys, F.least(F.floor(F.col("v") * 256), F.lit(255)).alias("bin")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(over(*keys)))
    entropy = histogram.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("intensity_entropy"))
    spread = exact_percentiles(pixels, keys, {"p5": 0.05, "p95": 0.95}).select(*keys, (F.col("p95") - F.col("p5")).alias("intensity_p95_p5"))
    comp, size = F.avg("n_comp"), F.sum("area") / F.nullif(F.sum("n_comp"), F.lit(0))
    cv = F.stddev_pop("n_comp") / F.greatest(comp, F.lit(1e-10))
    variance = F.sum("squares") / F.nullif(F.sum("n_comp"), F.lit(0)) - size * size
    avg = {"edge_density": "edge_density", "gradient_mean": "gradient_mean", "otsu_holes": "holes", "binary_fill_ratio": "fill", "glcm_contrast": "glcm_contrast", "glcm_homogeneity": "glcm_homogeneity", "fft_low_freq_ratio": "ratio", "fg_bg_contrast": "contrast", "polarity": "polarity", "largest_component_ratio": "largest", "laplacian_variance": "laplacian"}
    pooled = images.join(sample, I).groupBy(*keys).agg(
        comp.alias("otsu_components"), (1 / (1 + cv)).alias("otsu_stability"), size.alias("component_size_mean"), (F.sqrt(F.greatest(variance, F.lit(0.0))) / size).alias("component_size_cv"), *[F.avg(c).alias(name) for name, c in avg.items()]
    )
    out = moments.join(entropy, keys).join(spread, keys).join(pooled, keys).join(n, "dataset").withColumn("samples_per_class", F.col("n_samples") / F.col("n_classes"))
    return out.select(*keys, *[or_zero(F.col(c).cast("double")).alias(c) for c in NAMES])


def dataset_characteristics(grid: DataFrame, members: DataFrame) -> DataFrame:
    """(dataset, 25 values) over all images."""
    cut = squares(grid)
    return of_samples(cut, save(of_images(cut), "images"), members, members.select("dataset", I), ["dataset"])


def stable_characteristics(grid: DataFrame, members: DataFrame, repeats: int = 5, most: int = 100, seed: int = 42) -> DataFrame:
    """(dataset, 25 values): means over `repeats` samples of at most `most` images, drawn by md5 of (seed + 1000 * repeat, image)."""
    each = members.select("dataset", I, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    draw = F.md5(F.concat_ws(":", (F.lit(seed) + 1000 * F.col("rep")).cast("string"), F.col(I).cast("string")))
    drawn = each.withColumn("k", F.row_number().over(Window.partitionBy("dataset", "rep").orderBy(draw, I))).where(F.col("k") <= most).drop("k")
    sample = save(drawn.select("dataset", "rep", I), "sample")
    cut = squares(grid.join(sample.select(I).distinct(), I))
    got = of_samples(cut, save(of_images(cut), "images"), members, sample, ["dataset", "rep"])
    return got.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in NAMES])
