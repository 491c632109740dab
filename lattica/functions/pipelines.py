"""Fixed chains from images to vectors, as (image_id, part, pos, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import descriptors
from lattica.functions.tables import save
from lattica.operators import grid as g
from lattica.operators import pixels

I = "image_id"


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.select(I, F.lit(name).alias("part"), F.col("pos").cast("int").alias("pos"), F.col("x").cast("double").alias("x"))


def statistics_pipeline(grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A: the image's bars as statistics, with the share of foreground."""
    share = grid.groupBy(I).agg(F.avg((F.col("v") > threshold).cast("double")).alias("x")).withColumn("pos", F.lit(0))
    return _part(descriptors.extract("topological_features", grid), "statistics").unionByName(_part(share, "foreground_ratio"))


def landscape_pipeline(grid: DataFrame, layers: int = 5, n: int = 50) -> DataFrame:
    """B: the landscapes of the image's bars, those of each dimension after one another."""
    return _part(descriptors.extract("persistence_landscapes", grid, layers=layers, n=n), "landscapes")


def scalars(grid: DataFrame, smooth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Euler number (4 neighbours) of the smooth image's foreground; mean, deviation and foreground of the image itself."""
    chi = g.euler_number(smooth.withColumn("fg", (F.col("v") > threshold).cast("int")), 4).select(I, F.lit("euler").alias("part"), F.col("chi").alias("x"))
    own = grid.groupBy(I).agg(F.avg("v").alias("image_mean"), F.stddev_pop("v").alias("image_std"), F.avg((F.col("v") > threshold).cast("double")).alias("foreground_ratio"))
    own = own.unpivot(I, ["image_mean", "image_std", "foreground_ratio"], "part", "x").withColumn("pos", F.lit(0))
    return _part(chi.withColumn("pos", F.lit(0)), "euler").unionByName(own.select(I, "part", "pos", "x"))


def curves_pipeline(grid: DataFrame, sigma: float = 1.0, n: int = 50, threshold: float = 0.5) -> DataFrame:
    """C: smoothed by a Gaussian, then Betti curves, with the scalars."""
    smooth = save(pixels.convolve(grid, pixels.gaussian(sigma)), "smooth")
    return _part(descriptors.extract("betti_curves", smooth, n=n), "betti_curves").unionByName(scalars(grid, smooth, threshold))
