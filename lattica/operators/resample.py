"""Resizing and perturbing of (image_id, r, c, v) pixels, and the stability of vectors under perturbation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.tables import over


def area_resize(grid: DataFrame, most: int) -> DataFrame:
    """Images with a side over `most` become as much smaller as it takes; a new pixel is the mean of what it covers,
    weighted by area. Each pixel is sent to the few new pixels that it overlaps."""
    w = over("image_id")
    side = grid.withColumns({"h": F.max("r").over(w) + 1, "w": F.max("c").over(w) + 1})
    top = F.greatest("h", "w")
    new = lambda n: F.when(top > most, F.greatest(F.lit(1), F.floor(F.col(n) * most / top + 0.5).cast("int"))).otherwise(F.col(n))
    sized = side.withColumns({"nh": new("h"), "nw": new("w")})

    def spread(df: DataFrame, at: str, n: str, m: str, to: str) -> DataFrame:
        # in units of 1 / (n * m) old pixel `at` covers [at * m, at * m + m), new pixel k covers [k * n, k * n + n)
        begin, end = F.col(at) * F.col(m), (F.col(at) + 1) * F.col(m)
        first, final = (F.floor(x / F.col(n)).cast("int") for x in (begin, end - 1))
        out = df.withColumn(to, F.explode(F.sequence(first, final)))
        k = F.col(to) * F.col(n)
        return out.withColumn(f"by_{to}", F.least(end, k + F.col(n)) - F.greatest(begin, k))

    both = spread(spread(sized, "r", "h", "nh", "i"), "c", "w", "nw", "j")
    area = F.col("by_i") * F.col("by_j")
    return both.groupBy("image_id", F.col("i").alias("r"), F.col("j").alias("c")).agg((F.sum(area * F.col("v")) / F.sum(area)).alias("v"))


def normal(*keys: Column | str) -> Column:
    """A standard normal number that the keys decide alone (Box-Muller on their md5), alike on every run and partition."""
    text = F.md5(F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in keys]))
    part = lambda k: F.conv(F.substring(text, k, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((part(1) + 1) / 4294967297.0)) * F.cos(2 * math.pi * part(9) / 4294967296.0)


def add_noise(grid: DataFrame, sigma: float | Column, seed: int | Column = 42) -> DataFrame:
    """Gaussian noise, clipped to [0, 1]."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    noisy = F.col("v") + col(sigma) * normal(col(seed), "image_id", "r", "c")
    return grid.withColumn("v", F.least(F.greatest(noisy, F.lit(0.0)), F.lit(1.0)))


def rotate(grid: DataFrame, degrees: float) -> DataFrame:
    """Rotation around the middle: each pixel takes the bilinear value at the place it comes from, 0 outside."""
    w, turn = over("image_id"), math.radians(degrees)
    y0, x0 = F.max("r").over(w) / 2, F.max("c").over(w) / 2
    at = grid.select("image_id", "r", "c", (F.col("r") - y0).alias("y"), (F.col("c") - x0).alias("x"), y0.alias("y0"), x0.alias("x0"))
    source = at.select("image_id", "r", "c", (F.col("y") * math.cos(turn) + F.col("x") * math.sin(turn) + F.col("y0")).alias("y"), (F.col("x") * math.cos(turn) - F.col("y") * math.sin(turn) + F.col("x0")).alias("x"))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    near = source.withColumn("k", F.explode(corners))
    weight = lambda v, k: 1 - F.abs(F.floor(v) + F.col(f"k.{k}") - F.col(v))
    place = lambda v, k: (F.floor(v) + F.col(f"k.{k}")).cast("int")
    wanted = near.select("image_id", "r", "c", place("y", "a").alias("sr"), place("x", "b").alias("sc"), (weight("y", "a") * weight("x", "b")).alias("by"))
    pixels = grid.select("image_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    return wanted.join(pixels, ["image_id", "sr", "sc"], "left").groupBy("image_id", "r", "c").agg(F.sum(F.col("by") * F.coalesce("v", F.lit(0.0))).alias("v"))


def stability_report(grid: DataFrame, levels: list[float], trials: int = 5, passing: float = 0.7) -> DataFrame:
    """(level, mean, std, score, passed): cosine of each image with its noisy versions at each level; the score is the
    mean of the levels' means. Each pixel is repeated once for each level and trial, then images are summed."""
    runs = grid.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    noisy = add_noise(runs.withColumn("clean", F.col("v")), F.col("level"), F.col("trial"))
    dot = F.sum(F.col("v") * F.col("clean"))
    size = F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("clean") * F.col("clean")))
    cosine = noisy.groupBy("image_id", "level", "trial").agg(F.when(size > 0, dot / size).otherwise(0.0).alias("cosine"))
    by_level = cosine.groupBy("level").agg(F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"))
    score = F.avg("mean").over(Window.partitionBy(F.lit(1)))  # one row a level
    return by_level.withColumn("score", score).withColumn("passed", F.col("score") > passing)
